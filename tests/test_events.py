"""Edge cases of the event analyses, worked out by hand."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from eventlens.functions import lexicon
from eventlens.operators import facts, flow, metrics
from eventlens.operators.sessions import sessionize

SCHEMA = ("src long, uid string, ts timestamp_ntz, event_raw string, event_label string, event_type string, `group` string, content_id string, "
          "content_label string, product_id string, product_label string, amount double, duration_sec double, wait_time_sec double, language_source string")


def at(text: str | None) -> datetime | None:
    return None if text is None else datetime.fromisoformat(f"2026-05-28 {text}")


def events(spark, *rows):
    """Rows of (uid, time, type, group, product, amount)."""
    return spark.createDataFrame([
        (i, uid, at(ts), kind, kind, kind, group, group, group, product, product, float(amount), 0.0, 0.0, "dictionary")
        for i, (uid, ts, kind, group, product, amount) in enumerate(rows)], SCHEMA)


def test_session_gap_counts_second_boundaries(spark):
    e = events(spark, ("u", "10:00:00", "a", None, None, 0), ("u", "10:30:00", "a", None, None, 0), ("u", "11:00:01", "a", None, None, 0),
               ("u", None, "a", None, None, 0), ("u", None, "a", None, None, 0), ("v", "10:00:00.900", "a", None, None, 0),
               ("v", "10:30:01.100", "a", None, None, 0))
    got = [(r.uid, r.src, r.session_id) for r in sessionize(e).orderBy("src").collect()]
    assert [s for _, _, s in got] == ["u-0", "u-0", "u-1", "u-2", "u-3", "v-0", "v-1"]


def test_session_facts_keep_nulls_of_first_and_last(spark):
    e = events(spark, ("u", "10:00:00", "login", None, None, 0), ("u", "10:01:00", "content_fail", "raid", None, 0),
               ("u", "10:02:00", "purchase", "shop", "p", 5), ("u", "10:03:00", "content_fail", "raid", None, 0))
    r = facts.session_facts(sessionize(e)).first()
    assert (r.duration_sec, r.content_groups, r.revenue, r.purchase_count, r.ended_after_failure) == (180, ["raid", "shop"], 5.0, 1, True)
    j = facts.user_journeys(sessionize(e)).first()
    assert (j.first_event, j.first_failure, j.first_failure_group, j.first_purchase_product, j.session_count) == ("login", "content_fail", "raid", "p", 1)


def test_retry_is_any_later_event_of_the_group(spark):
    e = events(spark, ("u", "10:00:00", "content_fail", "raid", None, 0), ("u", "10:01:00", "login", None, None, 0), ("u", "10:02:00", "x", "raid", None, 0),
               ("v", "10:00:00", "x", "raid", None, 0), ("v", "10:01:00", "content_fail", "raid", None, 0))
    r = facts.failure_contexts(sessionize(e)).first()
    assert (r.failure_users, r.failure_events, r.retry_users, r.retry_after_failure_rate) == (2, 2, 1, 0.5)


def test_lookback_is_bounded_by_events_and_time(spark):
    rows = [("u", f"10:{i:02d}:00", f"e{i}", None, None, 0) for i in range(7)]
    e = sessionize(events(spark, ("u", "08:00:00", "old", None, None, 0), *rows, ("u", "10:10:00", "purchase", "shop", "p", 9)))
    assert sorted(r.event_label for r in facts.prior_events(e).collect()) == ["e2", "e3", "e4", "e5", "e6"]
    assert sorted(r.event_label for r in facts.prior_events(e, minutes=5).collect()) == ["e5", "e6"]


def test_revenue_is_shared_by_groups_seen_so_far(spark):
    e = sessionize(events(spark, ("u", "10:00:00", "x", "a", None, 0), ("u", "10:01:00", "purchase", "b", "p", 10), ("u", "10:02:00", "x", "c", None, 0)))
    assert {r["group"]: r.revenue_after_content for r in facts.revenue_after_content(e).collect()} == {"a": 5.0, "b": 5.0}


def test_bursts_count_each_start_once(spark):
    e = events(spark, *[("u1", f"10:00:{s:02d}", "ping", None, None, 0) for s in (0, 10, 20)], ("u1", "10:05:00", "move", None, None, 0),
               ("u2", "10:00:00", "login", None, None, 0))
    r = flow.short_interval_repeats(flow.coded(sessionize(e))).collect()
    assert [(x.code, x.user_count, x.max_events_in_window, x.shortest_window_seconds, x.burst_window_count, x.window_seconds) for x in r] == [("ping", 1, 3, 20, 1, 60)]


def test_recent_issues_are_the_last_found(spark):
    from eventlens.operators import diagnosis

    kinds = "part int, issue_type string, subject string, severity string, impact double, evidence double, sufficiency double, confidence double"
    rows = [(1, "content_failure", "a", "주의", 0.5, 0.5, 0.5, 0.7), (0, "log_mapping_needed", "log", "주의", 1.0, 0.8, 0.7, 0.86), (2, "revenue_missing", "r", "위험", 0.8, 0.8, 0.5, 0.74),
            (1, "content_friction", "b", "위험", 0.5, 0.5, 0.5, 0.9)]
    board = lambda by: [r.subject for r in diagnosis.sorted_issues(spark.createDataFrame(rows, kinds), by).collect()]
    assert board("recent") == ["r", "a", "b", "log"] and board("severity") == ["r", "b", "log", "a"] and board("impact") == ["log", "r", "b", "a"]


def test_paths_are_over_runs(spark):
    e = events(spark, *[("u", f"10:00:{i:02d}", c, None, None, 0) for i, c in enumerate("aabbc")])
    got = {(r.path_text, r.occurrence_count) for r in flow.common_paths(flow.coded(sessionize(e))).collect()}
    assert got == {("a -> b", 1), ("b -> c", 1), ("a -> b -> c", 1)}
    assert flow.sequences(flow.coded(sessionize(e)), steps=2).first().sequence == "a x2 -> b x2 -> ... +1 more"


def test_common_paths_by_levels_equal_all_paths(spark):
    import random

    rng = random.Random(4)
    codes = [f"c{i}" for i in range(12)]
    rows = [(f"u{u}", f"{10 + i // 60:02d}:{i % 60:02d}:00", rng.choice(codes[:3] if rng.random() < 0.6 else codes), None, None, 0) for u in range(40) for i in range(60)]
    coded = flow.coded(sessionize(events(spark, *rows)))
    columns = ("user_count", "length", "occurrence_count", "path_text")
    every = sorted((tuple(r[c] for c in columns) for r in flow.common_paths(coded, limit=None).collect()), key=lambda r: (-r[0], -r[1], -r[2], r[3]))
    for limit in (1, 5, 12, 100_000):
        assert [tuple(r[c] for c in columns) for r in flow.common_paths(coded, limit).collect()] == every[:limit]
    ahead = flow._steps_ahead(coded)
    pairs = flow._counted(ahead.where("c1 is not null").select("uid", F.array("c0", "c1").alias("path")))
    best = pairs.orderBy(F.desc("user_count")).limit(12).agg(F.min("user_count")).first()[0]
    assert flow.longer_paths(ahead, pairs.where(F.col("user_count") >= best)).count() * 3 < flow.longer_paths(ahead, None).count()


def test_empty_events_give_zeros(spark):
    e = sessionize(events(spark, ("u", "10:00:00", "a", None, None, 0)).where("false"))
    r = metrics.run_summary(e, facts.session_facts(e)).first()
    assert (r.active_users, r.sessions, r.revenue, r.conversion_rate, r.arppu) == (0, 0, 0.0, 0.0, 0.0)
    assert metrics.revenue_concentration(e).first().asDict() == {"top_1_user_share": 0.0, "top_5pct_share": 0.0}
    assert metrics.content_facts(e).count() == flow.common_paths(flow.coded(e)).count() == 0


@pytest.mark.parametrize(("raw", "kind", "group", "label"), [
    ("pkg_raid_buy", "purchase", "레이드", "패키지 레이드 구매"), ("arenaEnter", "content_enter", "아레나", "아레나 입장"),
    ("arena_match_wait_timeout", "match_issue", "아레나", "아레나 매칭 대기 시간 초과"), ("login", "event", None, "login"),
    ("start", "session_start", None, "시작"), ("shop_view", "product_view", "상점", "상점 노출"), ("evt", "event", None, "evt"),
    ("postgame", "event", "스테이지", "postgame"), ("reward_claim", "reward_claim", None, "보상 수령")])
def test_lexicon(spark, raw, kind, group, label):
    c = F.lit(raw)
    r = spark.range(1).select(lexicon.event_type_of(c).alias("t"), lexicon.group_of(c).alias("g"), lexicon.readable(c).alias("l")).first()
    assert (r.t, r.g, r.l) == (kind, group, label)


def test_windows_of_a_user_share_one_shuffle(spark):
    e = events(spark, ("u", "10:00:00", "a", None, None, 0))
    plan = facts.user_journeys(sessionize(e))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_concentration_of_many_payers_needs_no_whole_sort(spark):
    paid = spark.range(3000).select(
        F.col("id").cast("string").alias("uid"), ((F.col("id") * 7919) % 3001).cast("double").alias("amount"), F.lit("purchase").alias("event_type"))
    assert metrics.revenue_concentration(paid, at_once=100).collect() == metrics.revenue_concentration(paid).collect()


def test_stream_closes_sessions_behind_the_watermark(spark, tmp_path):
    from eventlens.streaming.sessions import session_stream

    e = events(spark, ("u", "10:00:00", "login", None, None, 0), ("u", "10:10:00", "purchase", "shop", "p", 7), ("u", "11:00:00", "login", None, None, 0),
               ("v", "14:00:00", "login", None, None, 0), ("v", None, "login", None, None, 0))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    run = session_stream(stream).writeStream.format("memory").queryName("closed").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = sorted((r.uid, str(r.start.time()), r.event_count, r.revenue) for r in spark.table("closed").collect())
    assert got == [("u", "10:00:00", 2, 7.0), ("u", "11:00:00", 1, 0.0)]
    assert session_stream(e).count() == 3


def test_stream_and_table_agree_below_a_second(spark):
    from eventlens.streaming.sessions import session_stream

    e = events(spark, ("u", "10:00:00.100", "a", None, None, 0), ("u", "10:30:00.900", "a", None, None, 0), ("v", "10:00:00.900", "a", None, None, 0),
               ("v", "10:30:01.100", "a", None, None, 0), ("w", "10:00:00", "a", None, None, 0), ("w", "10:30:00", "a", None, None, 0))
    table = {r.uid: r.n for r in sessionize(e).groupBy("uid").agg(F.count_distinct("session_id").alias("n")).collect()}
    stream = {r.uid: r.n for r in session_stream(e).groupBy("uid").agg(F.count("*").alias("n")).collect()}
    assert stream == table == {"u": 1, "v": 2, "w": 1}


def test_stream_of_bursts_equals_windows_of_the_table(spark, tmp_path):
    """Files one at a time, a restart between them, rows within the delay and
    one behind it; a late heartbeat closes what is open."""
    import random

    from pyspark.sql.window import Window

    from eventlens.streaming.bursts import burst_stream

    rng = random.Random(8)
    kinds, session = "uid string, code string, ts timestamp_ntz", spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    session.conf.set("spark.sql.session.timeZone", "UTC")
    rows = sorted((at(f"10:{rng.randint(0, 29):02d}:{rng.randint(0, 59):02d}.{rng.randint(0, 9)}"), f"u{rng.randint(0, 3)}", f"c{rng.randint(0, 2)}") for _ in range(400))
    rows = [(u, c, t) for t, u, c in rows]
    swapped = [*rows[:90], *rows[110:200], *rows[90:110], *rows[200:], (None, "c1", at("10:00:00"))]
    dropped = ("u1", "c1", at("09:00:00"))

    def put(part: list) -> None:
        spark.createDataFrame(part, kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run() -> None:
        stream = session.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        burst_stream(stream, 60, 3, "15 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(300)

    put(swapped[:200])
    run()
    put(swapped[200:])
    put([("beat", "beat", at("12:00:00"))])
    run()
    put([dropped])
    put([("beat", "beat", at("14:00:00"))])
    run()
    table = spark.createDataFrame(swapped, kinds).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    frame = Window.partitionBy("uid", "code").orderBy("us").rangeBetween(0, 60_000_000)
    want = table.withColumns({"n": F.count("*").over(frame), "last": F.max("us").over(frame)}).where("n >= 3").select(
        "uid", "code", "us", "n", ((F.col("last") - F.col("us")) / 1_000_000).alias("span")).distinct()
    got = spark.read.parquet(str(tmp_path / "out")).select("uid", "code", F.unix_micros("start"), "events", "span_seconds")
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key) and got.count() > 50


def test_users_of_one_slice_have_their_own_windows(spark, tmp_path):
    """State is kept by slices of users, here one for all."""
    from eventlens.streaming.bursts import burst_stream

    kinds, session = "uid string, code string, ts timestamp_ntz", spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    session.conf.set("spark.sql.session.timeZone", "UTC")
    parts = [[("u", "a", "10:00:00"), ("v", "a", "10:00:01"), ("u", "b", "10:00:02"), (None, "a", "10:00:05")],
             [("u", "a", "10:00:10"), ("u", "a", "10:01:00"), ("v", "a", "10:01:02"), (None, "a", "10:00:06"), (None, "a", "10:00:06")],
             [("beat", "beat", "12:00:00")], [("v", "a", "12:30:00"), ("v", "a", "12:30:01"), ("v", "a", "12:30:01")], [("beat", "beat", "14:00:00")]]
    for part in parts:
        spark.createDataFrame([(u, c, at(t)) for u, c, t in part], kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = session.readStream.schema(kinds).parquet(str(tmp_path / "in"))
        burst_stream(stream, 60, 3, "15 minutes", slices=1).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(300)
    got = spark.read.parquet(str(tmp_path / "out")).select("uid", "code", F.date_format("start", "HH:mm:ss"), "events", "span_seconds")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("u", "a", "10:00:00", 3, 60.0), (None, "a", "10:00:05", 3, 1.0), ("v", "a", "12:30:00", 3, 1.0)], key=str)
