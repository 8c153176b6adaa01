"""txmon: transaction monitoring and analytics on Spark DataFrames, SQL and Structured Streaming.

Sub-packages
------------
functions  column-expression helpers (JSON scalars, safe parsing, money, formatting)
sources    batch/stream readers, sinks and the SQL entry points
operators  flatten/validate, fraud rules, top-k, aggregates, distributions, windows, reconcile
streaming  continuous classify-and-route, windowed totals, dormancy state, stream dedup
plans      fixture views over the test tables, named reports and chart dispatch
"""

from txmon.session import get_spark, scratch_path  # noqa: F401

__all__ = ["get_spark", "scratch_path"]
