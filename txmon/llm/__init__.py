"""Training-data operators: quality, de-duplication, scoring, decontamination, licences, HTML, tokens, mixing.

Nothing else in the library imports this subpackage.
"""
