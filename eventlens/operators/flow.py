"""How users move through event codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BURST_EVENTS, BURST_SECONDS
from ..functions.values import filled, ratio, seconds

AT = "user_event_index"
#: Codes listed for each sampled user or session.
TOP_CODES = 5


def coded(ordered: DataFrame) -> DataFrame:
    """Events with the code, label, type and group the flow is told in."""
    raw, label, kind = (filled(F.trim(c)) for c in ("event_raw", "event_label", "event_type"))
    return ordered.select(
        "uid", "session_id", "ts", AT, F.coalesce(raw, label, kind, F.lit("unknown")).alias("code"),
        F.coalesce(label, raw, kind, F.lit("unknown")).alias("label"), F.coalesce(kind, F.lit("event")).alias("event_type"),
        F.coalesce(*[filled(F.trim(c)) for c in ("group", "content_label", "content_id")], F.lit("")).alias("group"))


def _users(flow: DataFrame) -> DataFrame:
    return flow.agg(F.count_distinct("uid").alias("total_users"))


def _participation(flow: DataFrame, by: str, *least: str) -> DataFrame:
    """Events, users and sessions of each code or group, and when it was seen.

    Sessions are counted within users and users within codes, step by step, so
    that events aren't repeated for each thing that is counted.
    """
    least_of = [F.min(c).alias(c) for c in (*least, "first_seen")]
    sums = lambda **counts: [*(e.alias(n) for n, e in counts.items()), *least_of, F.max("last_seen").alias("last_seen")]
    by_session = flow.withColumns({"first_seen": F.col("ts"), "last_seen": F.col("ts")}).groupBy(by, "uid", "session_id").agg(*sums(count=F.count("*")))
    by_user = by_session.groupBy(by, "uid").agg(*sums(count=F.sum("count"), session_count=F.count("session_id")))
    found = by_user.groupBy(by).agg(*sums(count=F.sum("count"), user_count=F.count("uid"), session_count=F.sum("session_count"))).crossJoin(_users(flow))
    return found.withColumn("user_rate", ratio(F.col("user_count"), F.col("total_users"), 4)).withColumn(
        "events_per_user", ratio(F.col("count"), F.col("user_count"), 2)).drop("total_users")


def code_participation(flow: DataFrame, limit: int | None = 20) -> DataFrame:
    """Who takes part in each code, and how often."""
    found = _participation(flow, "code", "label", "event_type", "group")
    return found if limit is None else found.orderBy(F.col("count").desc(), F.col("user_count").desc(), "code").limit(limit)


def content_participation(flow: DataFrame, limit: int | None = 12) -> DataFrame:
    """The same by content group, with the different codes of each."""
    grouped = flow.where("group <> ''")
    codes = grouped.select("group", "code").distinct().groupBy("group").agg(F.count("*").alias("code_count"))
    found = _participation(grouped, "group").drop("user_rate").crossJoin(_users(flow)).withColumn(
        "user_rate", ratio(F.col("user_count"), F.col("total_users"), 4)).drop("total_users").join(codes, "group")
    return found if limit is None else found.orderBy(F.col("count").desc(), F.col("user_count").desc(), "group").limit(limit)


def transition_rates(flow: DataFrame, limit: int | None = 30) -> DataFrame:
    """Steps from one code to the next, across sessions."""
    after = F.lead("code").over(Window.partitionBy("uid").orderBy(AT))
    steps = flow.withColumn("to_code", after).where("to_code is not null").groupBy(F.col("code").alias("from_code"), "to_code").agg(
        F.count("*").alias("count"), F.count_distinct("uid").alias("user_count"))
    sources = flow.groupBy(F.col("code").alias("from_code")).agg(F.count_distinct("uid").alias("from_user_count"))
    found = steps.join(sources, "from_code").crossJoin(_users(flow)).select(
        "from_code", "to_code", "count", "user_count", "from_user_count", ratio(F.col("user_count"), F.col("total_users"), 4).alias("user_rate"),
        ratio(F.col("user_count"), F.col("from_user_count"), 4).alias("transition_rate"))
    return found if limit is None else found.orderBy(F.col("count").desc(), F.col("user_count").desc(), "from_code", "to_code").limit(limit)


def loop_patterns(flow: DataFrame, limit: int = 8) -> DataFrame:
    """Codes that follow themselves, among the leading transitions."""
    return transition_rates(flow).where("from_code = to_code").orderBy(F.col("user_count").desc(), F.col("count").desc(), "from_code").limit(limit)


def short_interval_repeats(flow: DataFrame, window_seconds: int = BURST_SECONDS, min_events: int = BURST_EVENTS,
                           limit: int | None = 12) -> DataFrame:
    """Codes that users repeat within a short time.

    A window starts at each different time of a user's code and counts what
    follows within its length, by a range frame; the events are never joined.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    frame = Window.partitionBy("uid", "code").orderBy("us").rangeBetween(Window.currentRow, window_seconds * 1_000_000)
    every = Window.partitionBy("uid", "code")
    starts = flow.where("ts is not null").withColumn("us", at).withColumns({
        "n": F.count("*").over(frame), "until": F.max("ts").over(frame), "events": F.count("*").over(every)})
    found = starts.where(F.col("n") >= min_events).groupBy("uid", "code", "us").agg(
        F.max("n").alias("n"), F.max(seconds(F.col("until")) - seconds(F.col("ts"))).alias("span"), F.max("events").alias("events"))
    by_user = found.groupBy("uid", "code").agg(F.count("*").alias("windows"), F.max("n").alias("most"),
                                               F.min("span").alias("least_span"), F.max("events").alias("events"))
    by_code = by_user.groupBy("code").agg(
        F.count("*").alias("user_count"), F.sum("windows").alias("burst_window_count"), F.max("most").alias("max_events_in_window"),
        F.min("least_span").alias("shortest_window_seconds"), F.sum("events").alias("total_events")).crossJoin(_users(flow))
    result = by_code.withColumn("user_rate", ratio(F.col("user_count"), F.col("total_users"), 4)).drop("total_users").withColumn(
        "window_seconds", F.lit(window_seconds).cast("long"))
    return result if limit is None else result.orderBy(
        F.col("user_count").desc(), F.col("burst_window_count").desc(), F.col("max_events_in_window").desc(), "code").limit(limit)


def collapsed_runs(flow: DataFrame, key: str = "uid") -> DataFrame:
    """Runs of equal codes that follow one another."""
    order = Window.partitionBy(key).orderBy(AT)
    before = F.lag("code").over(order)
    opens = F.when(before.isNull() | (before != F.col("code")), 1).otherwise(0).cast("long")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return flow.withColumn("opens", opens).withColumn("run", F.sum("opens").over(so_far) - 1).groupBy(key, "run").agg(
        F.min("code").alias("code"), F.min_by("label", AT).alias("label"), F.count("*").alias("count"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def _steps_ahead(flow: DataFrame) -> DataFrame:
    """(uid, run, c0 to c3): each run's code and those of the next three."""
    order = Window.partitionBy("uid").orderBy("run")
    return collapsed_runs(flow).select("uid", "run", F.col("code").alias("c0"), *[F.lead("code", i).over(order).alias(f"c{i}") for i in (1, 2, 3)])


def _leading(counted: DataFrame) -> list[Column]:
    return [F.col("user_count").desc(), F.size("path").desc(), F.col("occurrence_count").desc(), F.array_join("path", " -> ")]


def _counted(paths: DataFrame) -> DataFrame:
    """Occurrences and users of each path of (uid, path); users before paths."""
    return paths.groupBy("path", "uid").agg(F.count("*").alias("n")).groupBy("path").agg(
        F.sum("n").alias("occurrence_count"), F.count("uid").alias("user_count"))


def longer_paths(ahead: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """(uid, path) of three and four steps; if ``pairs`` are given, only of
    those whose every two steps are among them."""
    there = [F.col(f"c{i}").isNotNull() for i in range(4)]
    if pairs is not None:
        good = pairs.select(F.get("path", F.lit(0)).alias("p0"), F.get("path", F.lit(1)).alias("p1"), F.lit(True).alias("good"))
        order = Window.partitionBy("uid").orderBy("run")
        marked = ahead.join(good, (F.col("c0") == F.col("p0")) & (F.col("c1") == F.col("p1")), "left")
        ahead = marked.withColumns({f"g{i}": F.coalesce(F.lead("good", i).over(order), F.lit(False)) for i in (0, 1, 2)})
        there[2] &= F.col("g0") & F.col("g1")
        there[3] &= F.col("g0") & F.col("g1") & F.col("g2")
    paths = F.array_compact(F.array(*[F.when(there[n - 1], F.array(*[F.col(f"c{i}") for i in range(n)])) for n in (3, 4)]))
    return ahead.where(there[2]).select("uid", F.explode(paths).alias("path"))


def common_paths(flow: DataFrame, limit: int | None = 12) -> DataFrame:
    """Paths of two to four different steps, by how many users take them.

    A path has no more users than any two of its steps. Pairs are counted
    first; the last place in demand among them is a bound, and longer paths are
    only counted where all their pairs reach it.
    """
    ahead = _steps_ahead(flow)
    pairs = _counted(ahead.where("c1 is not null").select("uid", F.array("c0", "c1").alias("path")))
    if limit is None:
        leading = None
    else:
        bound = pairs.orderBy(*_leading(pairs)).limit(limit).agg(F.when(F.count("*") == limit, F.min("user_count")).otherwise(0).alias("bound"))
        leading = pairs.crossJoin(F.broadcast(bound)).where("user_count >= bound")
    found = pairs.unionByName(_counted(longer_paths(ahead, leading)))
    if limit is not None:
        found = found.orderBy(*_leading(found)).limit(limit)
    result = found.crossJoin(_users(flow)).select(
        F.array_join("path", " -> ").alias("path_text"), F.size("path").cast("long").alias("length"), "occurrence_count", "user_count",
        ratio(F.col("user_count"), F.col("total_users"), 4).alias("user_rate"))
    return result if limit is None else result.orderBy(F.col("user_count").desc(), F.col("length").desc(), F.col("occurrence_count").desc(), "path_text")


def end_codes(flow: DataFrame, last: bool, limit: int | None = 8) -> DataFrame:
    """Codes of users' first or last events."""
    pick = F.max_by if last else F.min_by
    ends = flow.groupBy("uid").agg(pick(F.struct("code"), F.col(AT))["code"].alias("code"), pick(F.struct("label"), F.col(AT))["label"].alias("label"))
    found = ends.groupBy("code").agg(F.min("label").alias("label"), F.count("*").alias("user_count")).crossJoin(_users(flow)).select(
        "code", "label", "user_count", ratio(F.col("user_count"), F.col("total_users"), 4).alias("user_rate"))
    return found if limit is None else found.orderBy(F.col("user_count").desc(), "code").limit(limit)


def sequences(flow: DataFrame, key: str = "uid", users: int = 8, steps: int = 24) -> DataFrame:
    """What the busiest users (or sessions) did, as a text of runs."""
    top = flow.groupBy(key).agg(F.count("*").alias("event_count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).orderBy(
        F.col("event_count").desc(), key).limit(users)
    runs = collapsed_runs(flow.join(F.broadcast(top.select(key)), key, "left_semi"), key)
    # The busiest have the most runs; only those that are told are gathered.
    told = F.when(F.col("run") < steps, F.struct("run", "label", "count"))
    listed = runs.groupBy(key).agg((F.max("run") + 1).alias("run_count"), F.array_sort(F.collect_list(told)).alias("runs"))
    words = F.transform("runs", lambda r: F.when(
        r["count"] > 1, F.concat(r["label"], F.lit(" x"), r["count"].cast("string"))).otherwise(r["label"]))
    more = F.when(F.col("run_count") > steps, F.concat(F.lit(" -> ... +"), (F.col("run_count") - steps).cast("string"), F.lit(" more"))).otherwise("")
    kinds = flow.join(F.broadcast(top.select(key)), key, "left_semi").groupBy(key, "code").agg(F.min("label").alias("label"), F.count("*").alias("count"))
    codes = kinds.groupBy(key).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "code", "label", "count"))), 1, TOP_CODES),
                                               lambda x: F.struct(x["code"].alias("code"), x["label"].alias("label"), x["count"].alias("count"))).alias("top_codes"))
    return top.join(listed, key).join(codes, key).select(
        key, "event_count", F.coalesce(seconds(F.col("last_ts")) - seconds(F.col("first_ts")), F.lit(0)).alias("duration_sec"),
        "run_count", F.concat(F.array_join(words, " -> "), more).alias("sequence"), "top_codes").orderBy(F.col("event_count").desc(), key)


def outliers(flow: DataFrame, limit: int = 12, **burst: int) -> DataFrame:
    """Codes and steps that stand out, by rules over the leading rows."""
    none, total = F.lit(None).cast("string"), _users(flow)
    common, steps = code_participation(flow), transition_rates(flow)

    def rows(df: DataFrame, kind: str, code, to, metric) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), code.alias("code"), to.alias("to_code"), "user_rate", metric.cast("double").alias("metric"))

    many = F.col("count") >= F.greatest(F.lit(5), F.col("user_count"))
    parts = [
        rows(common.where("user_rate >= 0.7 and events_per_user >= 8"), "high_repeat_common", F.col("code"), none, F.col("events_per_user")),
        rows(common.where((F.col("user_rate") <= 0.35) & many), "minority_heavy", F.col("code"), none, F.col("count")),
        rows(loop_patterns(flow).where((F.col("user_rate") >= 0.4) | many), "loop_pattern", F.col("from_code"), F.col("to_code"), F.col("count")),
        rows(short_interval_repeats(flow, **burst), "short_interval_repeat", F.col("code"), none, F.col("max_events_in_window")),
        rows(end_codes(flow, last=True).where("user_rate >= 0.6"), "stop_point", F.col("code"), none, F.col("user_count")),
        rows(steps.crossJoin(total).where("from_user_count >= greatest(2, total_users div 2) and transition_rate >= 0.8"),
             "dominant_transition", F.col("from_code"), F.col("to_code"), F.col("transition_rate"))]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.orderBy(F.col("user_rate").desc(), F.col("metric").desc(), "kind", "code", F.col("to_code").asc_nulls_first()).limit(limit)
