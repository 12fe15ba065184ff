"""Change events as a stream.

The batch operators compare two snapshots.  Where changes arrive as events instead, these keep the same
answers up to date with bounded state: windows of event time, closed by a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.operators.diff import priority


def changes_by_kind(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, kind, n_changes per window of ``ts``; events later than the watermark are not counted."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "kind").agg(F.count("*").alias("n_changes")).select(F.col("w.start").alias("start"), "kind", "n_changes")


def strongest_change(events: DataFrame, keys: list[str], window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """keys, start, kind: the change of highest priority per key and window, the earliest among equals."""
    best = F.max_by("kind", F.struct(priority(F.col("kind")), -F.unix_micros("ts")))
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), *keys).agg(best.alias("kind")).select(*keys, F.col("w.start").alias("start"), "kind")
