"""Word frequencies of a text column (A22: the data behind a word cloud)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Word pattern (a letter/digit/underscore, then one or more of those or an
# apostrophe, i.e. words of two or more characters) and common English stop words.
WORD_PATTERN = r"[\p{L}\p{N}_][\p{L}\p{N}_']+"
STOPWORDS = (
    "a about above after again against all am an and any are as at be because been before being "
    "below between both but by can could did do does doing down during each few for from further "
    "had has have having he her here hers herself him himself his how i if in into is it its itself "
    "just me more most my myself no nor not of off on once only or other our ours ourselves out over "
    "own same she should so some such than that the their theirs them themselves then there these they "
    "this those through to too under until up very was we were what when where which while who whom "
    "why will with would you your yours yourself yourselves"
).split()


def tokens(df: DataFrame, text: str) -> DataFrame:
    """One row per word of the whole text (lower case)."""
    return df.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD_PATTERN), 0)).alias("word"))


def word_counts(df: DataFrame, text: str, n: int | None = None, stopwords=STOPWORDS) -> DataFrame:
    """Count per word over all rows, stop words removed; with ``n`` the top n by count (ties by word)."""
    words = tokens(df, text)
    if stopwords:
        words = words.filter(~F.col("word").isin(list(stopwords)))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("count"))
    if n:
        counts = counts.orderBy(F.col("count").desc(), F.col("word")).limit(n)
    return counts
