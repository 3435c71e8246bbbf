"""Order of a user's events and their sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SESSION_GAP_MINUTES
from ..functions.values import seconds


def sessionize(events: DataFrame, gap_minutes: float = SESSION_GAP_MINUTES) -> DataFrame:
    """Add user_event_index, session_index and session_id.

    A user's events are ordered by time, those without one last, then by
    source order. A session ends where more than the gap passes; events
    without a time are sessions of their own. All three windows share one
    partitioning by user, and so do the aggregations by session after them.
    """
    order = Window.partitionBy("uid").orderBy(F.col("ts").asc_nulls_last(), "src")
    before = F.lag("ts").over(order)
    opens = before.isNull() | F.col("ts").isNull() | (
        (seconds(F.col("ts")) - seconds(before)) / 60.0 > gap_minutes)
    return (
        events.withColumn("user_event_index", F.row_number().over(order).cast("long") - 1)
        .withColumn("__opens", opens.cast("long"))
        .withColumn("session_index", F.sum("__opens").over(
            order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1)
        .withColumn("session_id", F.concat_ws("-", "uid", F.col("session_index").cast("string")))
        .drop("__opens"))
