"""A synthetic log of any size, and the time an analysis takes over it."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (event, content, product, amount, duration, wait, result) of the cycle.
PATTERNS = (
    ("login", "", "", 0, 0, 0, "success"),
    ("arena_enter", "arena", "", 0, 120, 8, "start"),
    ("arena_match_wait_timeout", "arena", "", 0, 0, 54, "fail"),
    ("arena_win", "arena", "", 0, 210, 0, "success"),
    ("raid_enter", "raid", "", 0, 180, 0, "start"),
    ("raid_clear_fail", "raid", "", 0, 360, 0, "fail"),
    ("raid_clear", "raid", "", 0, 420, 0, "success"),
    ("shop_view", "", "", 0, 30, 0, "view"),
    ("pkg_starter_buy", "", "starter_pack", 9900, 0, 0, "success"),
    ("pkg_raid_buy", "", "raid_pack", 55000, 0, 0, "success"),
    ("reward_claim", "raid", "", 0, 15, 0, "success"),
)


def users_for(rows: int) -> int:
    return min(max(rows // 12, 10), 50_000)


def patterned(ids: DataFrame, users: int) -> DataFrame:
    """A raw row by formula for each ``id``, counted from 0."""
    row = F.element_at(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(
        ("event_name", "content_id", "product_id", "amount", "duration_sec", "wait_time_sec", "result"), p, strict=True)])
        for p in PATTERNS]), (F.col("id") % len(PATTERNS) + 1).cast("int"))
    user, turn = F.col("id") % users, F.floor(F.col("id") / users)
    at = F.timestamp_seconds(F.lit(1_779_926_400) + turn * 7 + user % 5)
    return ids.select(
        F.col("id").alias("_src"), F.format_string("u%06d", user).alias("uid"), F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("event_time"),
        row.alias("r")).select("_src", "uid", "event_time", "r.*")


def synthetic_log(spark: SparkSession, rows: int, users: int | None = None) -> DataFrame:
    """Raw rows by formula, made in parallel."""
    return patterned(spark.range(rows), users or users_for(rows))


def timed(build) -> float:
    start = time.perf_counter()
    build()
    return round(time.perf_counter() - start, 3)
