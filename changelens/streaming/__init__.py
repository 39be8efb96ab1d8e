"""Additional to the batch analyses: churn of a stream of commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_churn(changes: DataFrame, at: str = "ts", late: str = "1 day") -> DataFrame:
    """(day, author, added, deleted) of a stream of changes with an event time.

    Days close once the watermark passes them; rows that are later than ``late`` are
    left out, as state would grow without end otherwise.
    """
    rows = changes.withWatermark(at, late).groupBy(F.window(at, "1 day"), "author")
    sums = rows.agg(F.sum(F.coalesce("added", F.lit(0))).alias("added"), F.sum(F.coalesce("deleted", F.lit(0))).alias("deleted"))
    return sums.select(F.col("window.start").alias("day"), "author", "added", "deleted")
