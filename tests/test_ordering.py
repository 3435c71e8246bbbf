"""Order and sessions by ranges, against the windows of one user."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventlens.operators import ordering
from eventlens.operators.sessions import sessionize

SCHEMA = "src long, uid string, ts timestamp_ntz, `odd``name` string"


def rows_of(n: int) -> list[tuple]:
    """A hot user with a third of all rows, small ones, gaps and null times."""
    start = datetime(2026, 5, 28)
    return [(i, "hot" if i % 3 == 0 else f"u{i * 7919 % 97:02d}", None if i % 50 == 7 else start + timedelta(minutes=(i * 31) % 4000, milliseconds=i % 1000), "x")
            for i in range(n)]


@pytest.mark.parametrize("ranges", [1, 3, 16, 200])
def test_sessions_in_ranges_equal_those_of_windows(spark, ranges):
    e = spark.createDataFrame(rows_of(3000), SCHEMA)
    columns = ["src", "uid", "user_event_index", "session_index", "session_id"]
    want = sessionize(e).select(columns).orderBy("src").collect()
    got = ordering.sessionize_in_ranges(e, ranges=ranges)
    assert got.columns == [*e.columns, *columns[2:]] and got.select(columns).orderBy("src").collect() == want


def test_no_range_holds_much_of_the_hot_user(spark):
    e = spark.createDataFrame(rows_of(20_000), SCHEMA)
    placed = ordering.in_ranges(e, ordering.event_keys(), 40)
    sizes = sorted(r["count"] for r in placed.groupBy("range", "uid").count().groupBy("range").agg(F.sum("count").alias("count")).collect())
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2] and placed.where("uid = 'hot'").select("range").distinct().count() > 10


def test_sessions_of_few_and_of_no_events(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ordering.sessionize_in_ranges(none).count() == 0 and ordering.dense_order(none, ordering.event_keys()).count() == 0
    one = spark.createDataFrame([(1, "u", None, "x"), (2, "u", None, "x"), (3, "u", datetime(2026, 1, 1), "x")], SCHEMA)
    got = ordering.sessionize_in_ranges(one, ranges=7).orderBy("user_event_index").collect()
    assert [(r.src, r.session_id) for r in got] == [(3, "u-0"), (1, "u-1"), (2, "u-2")]


def test_dense_order_needs_no_single_task(spark):
    e = spark.createDataFrame(rows_of(3000), SCHEMA)
    ordered = ordering.dense_order(e, ordering.event_keys(), ranges=9)
    got = [r.src for r in ordered.orderBy("event_order").collect()]
    want = [r.src for r in e.orderBy(*ordering.event_keys()).collect()]
    assert got == want and [r.event_order for r in ordered.orderBy("event_order").collect()] == list(range(3000))
    plan = ordered._jdf.queryExecution().executedPlan().toString()
    # Only counts of ranges come together; the events' scan has no exchange above it but theirs.
    assert "rangepartitioning" not in plan and plan.count("SinglePartition") <= 2 and "BroadcastHashJoin" in plan
