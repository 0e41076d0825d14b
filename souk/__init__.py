"""souk: retail review and price analytics as Spark jobs.

Sub-packages
------------
sources    table loading, canonical views, CSV ingest, keyed table changes
functions  column expressions (rounding, discounts, rules, text helpers)
operators  windows, joins, aggregations over prices, reviews, deals, campaigns, text, models
plans      the registry of named queries and their SQL twins
streaming  Structured Streaming jobs (review ingest, price tick monitor)
"""

from souk.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
