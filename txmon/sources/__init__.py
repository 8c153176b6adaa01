"""Readers, decoders, sinks and SQL entry points."""

from txmon.sources.events import decode_events, read_event_stream  # noqa: F401
