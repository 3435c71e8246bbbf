"""Sessions of a stream of standard events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SESSION_GAP_MINUTES


def session_stream(events: DataFrame, gap_minutes: int = SESSION_GAP_MINUTES, late: str = "10 minutes") -> DataFrame:
    """One row per session, once no event can extend it any more.

    Times count in whole seconds, as in tables; a gap of exactly the limit does
    not end a session.

    Works on a stream and on a table alike. Events without a time are left
    out, as they belong to no window; state is kept per user and open session.
    """
    timed = events.where("ts is not null").withColumn("at", F.date_trunc("second", F.col("ts").cast("timestamp")))
    bought = F.col("event_type") == "purchase"
    return timed.withWatermark("at", late).groupBy("uid", F.session_window("at", f"{gap_minutes} minutes").alias("w")).agg(
        F.count("*").alias("event_count"), F.count_if(bought).alias("purchase_count"), F.max("at").alias("last"),
        F.coalesce(F.sum(F.when(bought, F.col("amount"))), F.lit(0.0)).alias("revenue")).select(
        "uid", F.col("w.start").alias("start"), F.col("last").alias("end"), "event_count", "purchase_count", "revenue")
