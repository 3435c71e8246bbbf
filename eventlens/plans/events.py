"""Queries over standard events, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon
from ..operators import diagnosis, facts, flow, metrics
from .standardize import row_shape_type
from .testbed import STD, ordered_events, ordered_sql, std_events

DAY = 24 * 60
Q, O = {}, {}


def query(name: str, sql: str | None = None):
    """Register a query and its SQL under one name."""
    def add(build):
        Q[name] = build
        if sql is not None:
            O[name] = sql
        return build
    return add


WITH = f"WITH {ordered_sql()}"
EV = ordered_events


def _day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.prior_events(EV(spark, sf_dir), minutes=DAY)


@query("run_summary", WITH + """,
e AS (SELECT count(*) AS events, count(DISTINCT uid) AS active_users,
  count(DISTINCT CASE WHEN event_type = 'purchase' THEN uid END) AS paying_users, sum(amount) AS revenue FROM ev)
SELECT active_users, events, (SELECT count(*) FROM ses) AS sessions,
  round((SELECT avg(duration_sec) FROM ses), 2) AS avg_session_duration_sec, round(round(revenue, 6), 2) AS revenue, paying_users,
  round(paying_users / active_users, 4) AS conversion_rate, round(round(revenue, 6) / paying_users, 2) AS arppu FROM e""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = EV(spark, sf_dir)
    return metrics.run_summary(ordered, facts.session_facts(ordered))


@query("daily_summary", WITH + """,
e AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) AS events, count(DISTINCT uid) AS active_users,
  count(DISTINCT CASE WHEN event_type = 'purchase' THEN uid END) AS paying_users, sum(amount) AS revenue FROM ev GROUP BY 1),
s AS (SELECT CAST(CAST(start AS DATE) AS VARCHAR) AS date, count(*) AS sessions, avg(duration_sec) AS d FROM ses GROUP BY 1)
SELECT date, active_users, events, coalesce(sessions, 0) AS sessions, round(coalesce(d, 0), 2) AS avg_session_duration_sec,
  round(round(revenue, 6), 2) AS revenue, paying_users, round(paying_users / active_users, 4) AS conversion_rate,
  CASE WHEN paying_users = 0 THEN 0 ELSE round(round(revenue, 6) / paying_users, 2) END AS arppu FROM e LEFT JOIN s USING (date)""")
def daily_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = EV(spark, sf_dir)
    return metrics.daily_summary(ordered, facts.session_facts(ordered))


@query("standardize_events", f"""WITH {STD} SELECT src, uid, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_raw, event_label, event_type,
  grp AS "group", product AS product_id, amount, duration_sec, wait_time_sec, language_source FROM std""")
def standardize_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return std_events(spark, sf_dir).select(
        "src", "uid", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "event_raw", "event_label", "event_type", "group",
        "product_id", "amount", "duration_sec", "wait_time_sec", "language_source")


@query("row_shape_event_type", f"""WITH {STD} SELECT event_type, count(*) AS events FROM (SELECT CASE
  WHEN product IS NOT NULL AND amount > 0 THEN 'purchase' WHEN wait_time_sec > 0 THEN 'match_issue'
  WHEN product IS NOT NULL THEN 'product_view' WHEN grp IS NOT NULL THEN 'content_enter' ELSE 'event' END AS event_type FROM std)
GROUP BY event_type""")
def row_shape_event_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = std_events(spark, sf_dir).withColumn("event_type", F.lit("event"))
    return plain.groupBy(row_shape_type().alias("event_type")).agg(F.count("*").alias("events"))


@query("sessionize_events", WITH + " SELECT src, uid, ix AS user_event_index, session_index, session_id FROM ev")
def sessionize_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EV(spark, sf_dir).select("src", "uid", "user_event_index", "session_index", "session_id")


@query("session_facts", WITH + """ SELECT session_id, uid, strftime(start, '%Y-%m-%d %H:%M:%S') AS start,
  strftime(stop, '%Y-%m-%d %H:%M:%S') AS "end", duration_sec, event_count, first_event, last_event, last_event_type, purchase_count,
  round(revenue, 4) AS revenue, last_event_type IN ('content_fail', 'match_issue') AS ended_after_failure FROM ses""")
def session_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("start", "end")}
    return facts.session_facts(EV(spark, sf_dir)).withColumns(shown | {"revenue": F.round("revenue", 4)}).drop("content_groups")


@query("session_durations", f"""WITH {ordered_sql(DAY // 2)} SELECT duration, count(*) AS sessions, CAST(sum(event_count) AS BIGINT) AS events FROM (SELECT event_count,
  CASE WHEN duration_sec >= 3600 THEN (duration_sec // 3600) || 'h ' || (duration_sec % 3600 // 60) || 'm'
    WHEN duration_sec >= 60 THEN (duration_sec // 60) || 'm ' || (duration_sec % 60) || 's' ELSE duration_sec || 's' END AS duration FROM ses) GROUP BY duration""")
def session_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by their length, as a board tells it."""
    found = facts.session_facts(EV(spark, sf_dir, DAY // 2))
    return found.groupBy(diagnosis.duration_label(F.col("duration_sec")).alias("duration")).agg(F.count("*").alias("sessions"), F.sum("event_count").alias("events"))


@query("session_content_path", f"""WITH {ordered_sql(DAY // 2)}, g AS (SELECT session_id, grp, min(ix) AS first FROM ev WHERE grp <> '' GROUP BY ALL)
SELECT session_id, coalesce(p.path, '') AS path FROM (SELECT DISTINCT session_id FROM ev)
LEFT JOIN (SELECT session_id, string_agg(grp, ' > ' ORDER BY first) AS path FROM g GROUP BY session_id) p USING (session_id)""")
def session_content_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.session_facts(EV(spark, sf_dir, DAY // 2)).select("session_id", F.array_join("content_groups", " > ").alias("path"))


_JOURNEY = WITH + """, j AS (SELECT uid, strftime(arg_min(ts, ix), '%Y-%m-%d %H:%M:%S') AS first_seen,
  strftime(arg_max(ts, ix), '%Y-%m-%d %H:%M:%S') AS last_seen, count(*) AS event_count, count(DISTINCT session_id) AS session_count,
  arg_min(event_label, ix) AS first_event, count(*) FILTER (WHERE event_type = 'purchase') AS purchase_count, round(sum(amount), 4) AS revenue,
  arg_max(event_label, ix) AS last_event, arg_max(event_type, ix) AS last_event_type FROM ev GROUP BY uid),
r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY ix DESC) AS back FROM ev),
c AS (SELECT uid, grp AS first_content FROM ev WHERE grp IS NOT NULL AND event_type IN ('content_enter', 'session_start', 'content_fail', 'match_issue')
  QUALIFY row_number() OVER (PARTITION BY uid ORDER BY ix) = 1),
f AS (SELECT uid, event_label AS first_failure, grp AS first_failure_group FROM ev WHERE event_type IN ('content_fail', 'match_issue')
  QUALIFY row_number() OVER (PARTITION BY uid ORDER BY ix) = 1),
p AS (SELECT uid, product AS first_purchase_product FROM ev WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY uid ORDER BY ix) = 1)
"""


@query("user_journeys", _JOURNEY + """SELECT j.*, first_content, first_failure, first_failure_group, first_purchase_product, r.grp AS last_group
FROM j LEFT JOIN c USING (uid) LEFT JOIN f USING (uid) LEFT JOIN p USING (uid) LEFT JOIN r ON r.uid = j.uid AND r.back = 1""")
def user_journeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_seen", "last_seen")}
    return facts.user_journeys(EV(spark, sf_dir)).withColumns(shown | {"revenue": F.round("revenue", 4)})


@query("first_touch", _JOURNEY + """SELECT first_content, first_purchase_product, count(*) AS users
FROM j LEFT JOIN c USING (uid) LEFT JOIN p USING (uid) GROUP BY ALL""")
def first_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.user_journeys(EV(spark, sf_dir)).groupBy("first_content", "first_purchase_product").agg(F.count("*").alias("users"))


_RETRY = WITH + """, fl AS (SELECT uid, ix, coalesce(nullif(grp, ''), 'unknown') AS g FROM ev WHERE event_type IN ('content_fail', 'match_issue')),
rt AS (SELECT DISTINCT fl.uid, fl.g FROM fl JOIN ev later ON later.uid = fl.uid AND later.ix > fl.ix AND later.grp = fl.g),
fc AS (SELECT fl.g AS "group", count(DISTINCT fl.uid) AS failure_users, count(*) AS failure_events, count(DISTINCT rt.uid) AS retry_users
  FROM fl LEFT JOIN rt ON rt.uid = fl.uid AND rt.g = fl.g GROUP BY fl.g)
"""


@query("failure_retry", _RETRY + """SELECT *, round(retry_users / failure_users, 6) AS retry_after_failure_rate FROM fc""")
def failure_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.failure_contexts(EV(spark, sf_dir)).withColumn("retry_after_failure_rate", F.round("retry_after_failure_rate", 6))


_PRIOR = WITH + """, pr AS (SELECT b.uid, b.ix AS purchase_index, b.product, b.amount, a.event_label, a.grp AS content_group, a.ix AS prior_index
  FROM ev b JOIN ev a ON a.uid = b.uid AND a.ix >= b.ix - 5 AND a.ix < b.ix AND a.ts >= b.ts - INTERVAL 1 DAY WHERE b.event_type = 'purchase')
"""


@query("purchase_lookback_pairs", _PRIOR + "SELECT * FROM pr")
def purchase_lookback_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day(spark, sf_dir)


@query("top_preceding_events", _PRIOR + "SELECT event_label AS value, count(*) AS count FROM pr GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_preceding_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.top_prior(_day(spark, sf_dir), "event_label")


@query("top_preceding_groups", _PRIOR + "SELECT content_group AS value, count(*) AS count FROM pr WHERE content_group <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_preceding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.top_prior(_day(spark, sf_dir), "content_group")


_CONTEXT = _PRIOR + """, cx AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY count DESC, content_group) AS place FROM (
  SELECT product, content_group, count(*) AS count FROM pr WHERE content_group <> '' GROUP BY ALL))
"""


@query("product_context_top5", _CONTEXT + "SELECT * FROM cx WHERE place <= 5")
def product_context_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.product_contexts(_day(spark, sf_dir))


@query("purchase_examples", _PRIOR + """, px AS (SELECT uid, ix AS purchase_index, product, amount FROM ev WHERE event_type = 'purchase' ORDER BY uid, ix LIMIT 10)
SELECT px.uid, px.purchase_index, px.product, px.amount, coalesce(string_agg(pr.event_label, '|' ORDER BY prior_index), '') AS previous_events
FROM px LEFT JOIN pr ON pr.uid = px.uid AND pr.purchase_index = px.purchase_index GROUP BY ALL""")
def purchase_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.purchase_examples(EV(spark, sf_dir), minutes=DAY).withColumn("previous_events", F.array_join("previous_events", "|"))


_SHARE = """, gs AS (SELECT session_id, grp, min(ix) AS first FROM ev WHERE grp <> '' GROUP BY ALL),
pg AS (SELECT b.uid, b.ix, gs.grp, b.amount FROM ev b JOIN gs ON gs.session_id = b.session_id AND gs.first <= b.ix WHERE b.event_type = 'purchase'),
ra AS (SELECT grp, sum(share) AS revenue FROM (SELECT grp, amount / count(*) OVER (PARTITION BY uid, ix) AS share FROM pg) GROUP BY grp)
"""


@query("revenue_attribution", f"WITH {ordered_sql(DAY)}" + _SHARE + "SELECT grp AS \"group\", CAST(round(CAST(revenue AS DECIMAL(18, 6)), 2) AS DOUBLE) AS revenue_after_content FROM ra")
def revenue_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.revenue_after_content(EV(spark, sf_dir, DAY)).withColumn("revenue_after_content", F.round(F.round("revenue_after_content", 6), 2))


_CONTENT = _RETRY + _SHARE + """, cb AS (SELECT grp AS "group", count(DISTINCT uid) AS participant_users, count(*) AS event_count,
  avg(nullif(duration_sec, 0)) AS d, count(*) FILTER (WHERE event_type = 'content_success') AS success_events,
  count(*) FILTER (WHERE event_type IN ('content_fail', 'match_issue')) AS fail_events,
  count(DISTINCT CASE WHEN event_type = 'reward_claim' THEN uid END) AS ru, count(DISTINCT CASE WHEN event_type = 'content_success' THEN uid END) AS su,
  count(*) FILTER (WHERE event_type = 'match_issue' OR wait_time_sec > 0) AS wait_rows, count(*) FILTER (WHERE wait_time_sec > 0) AS waited,
  avg(nullif(wait_time_sec, 0)) FILTER (WHERE event_type = 'match_issue' OR wait_time_sec > 0) AS w,
  avg(nullif(duration_sec, 0)) FILTER (WHERE event_type = 'match_issue' OR wait_time_sec > 0) AS wd
  FROM ev WHERE grp IS NOT NULL GROUP BY grp),
ct AS (SELECT cb."group", participant_users, round(participant_users / (SELECT count(DISTINCT uid) FROM ev), 4) AS participant_rate, event_count,
  CAST(round(CAST(d AS DECIMAL(18, 6)), 2) AS DOUBLE) AS avg_duration_sec, success_events, fail_events,
  CASE WHEN success_events + fail_events = 0 THEN 0 ELSE round(fail_events / (success_events + fail_events), 4) END AS failure_rate,
  CASE WHEN su = 0 THEN 0 ELSE round(ru / su, 4) END AS reward_claim_rate,
  CAST(round(CAST(CASE WHEN wait_rows = 0 THEN NULL WHEN waited > 0 THEN w ELSE wd END AS DECIMAL(18, 6)), 2) AS DOUBLE) AS avg_wait_sec,
  round(coalesce(fc.retry_users / fc.failure_users, 0), 4) AS retry_after_failure_rate, CAST(round(CAST(coalesce(ra.revenue, 0) AS DECIMAL(18, 6)), 2) AS DOUBLE) AS revenue_after_content
  FROM cb LEFT JOIN ra ON ra.grp = cb."group" LEFT JOIN fc ON fc."group" = cb."group")
"""


@query("content_health", _CONTENT + "SELECT * FROM ct")
def content_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.content_facts(EV(spark, sf_dir))


@query("wait_stats", _CONTENT + "SELECT \"group\", avg_wait_sec, avg_duration_sec FROM ct WHERE avg_wait_sec IS NOT NULL")
def wait_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.content_facts(EV(spark, sf_dir)).where("avg_wait_sec is not null").select("group", "avg_wait_sec", "avg_duration_sec")


_PRODUCT = """, pf AS (SELECT product, count(DISTINCT uid) AS buyers, count(*) AS purchase_count, round(sum(amount), 2) AS revenue,
  CAST(round(CAST(avg(amount) AS DECIMAL(18, 6)), 2) AS DOUBLE) AS avg_amount FROM ev WHERE event_type = 'purchase' AND product IS NOT NULL GROUP BY product)
"""


@query("product_performance", _CONTEXT + _PRODUCT + """SELECT pf.*, coalesce(t.top_context_groups, '') AS top_context_groups FROM pf LEFT JOIN (
  SELECT product, string_agg(content_group || ':' || count, '|' ORDER BY place) AS top_context_groups FROM cx WHERE place <= 5 GROUP BY product) t USING (product)""")
def product_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = EV(spark, sf_dir)
    found = metrics.product_performance(ordered, facts.prior_events(ordered, minutes=DAY))
    return found.withColumn("top_context_groups", F.array_join(F.transform(
        "top_context_groups", lambda g: F.concat_ws(":", g["group"], g["count"].cast("string"))), "|"))


_SEG = WITH + """, u AS (SELECT uid, bool_or(event_type = 'purchase') AS buyer FROM ev GROUP BY uid),
sz AS (SELECT CASE WHEN buyer THEN 'buyer' ELSE 'non_buyer' END AS segment, count(*) AS users FROM u GROUP BY 1)
"""


@query("segment_group_rates", _SEG + """SELECT segment, "group", count, round(count / users, 4) AS rate, place FROM (
  SELECT *, row_number() OVER (PARTITION BY segment ORDER BY count DESC, "group") AS place FROM (
    SELECT CASE WHEN buyer THEN 'buyer' ELSE 'non_buyer' END AS segment, grp AS "group", count(*) AS count
    FROM ev JOIN u USING (uid) WHERE grp IS NOT NULL GROUP BY ALL)) JOIN sz USING (segment) WHERE place <= 10""")
def segment_group_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.segment_group_rates(EV(spark, sf_dir))


@query("segment_sizes", _SEG + "SELECT * FROM sz")
def segment_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.segment_sizes(EV(spark, sf_dir))


@query("buyer_users_semi", _SEG + "SELECT count(*) AS events, count(DISTINCT uid) AS users FROM ev WHERE uid IN (SELECT uid FROM u WHERE buyer)")
def buyer_users_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = EV(spark, sf_dir)
    return ordered.join(metrics.buyers(ordered), "uid", "left_semi").agg(F.count("*").alias("events"), F.count_distinct("uid").alias("users"))


@query("non_buyer_users_anti", _SEG + "SELECT count(*) AS events, count(DISTINCT uid) AS users FROM ev WHERE uid NOT IN (SELECT uid FROM u WHERE buyer)")
def non_buyer_users_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = EV(spark, sf_dir)
    return ordered.join(metrics.buyers(ordered), "uid", "left_anti").agg(F.count("*").alias("events"), F.count_distinct("uid").alias("users"))


_PAID = WITH + """, pd AS (SELECT uid, sum(amount) AS revenue, row_number() OVER (ORDER BY sum(amount) DESC, uid) AS place FROM ev
  WHERE event_type = 'purchase' GROUP BY uid)
"""


@query("revenue_concentration", _PAID + """SELECT round(max(revenue) / sum(revenue), 4) AS top_1_user_share,
  round(sum(revenue) FILTER (WHERE place <= greatest(1, CAST(floor((SELECT count(*) FROM pd) * 0.05) AS BIGINT))) / sum(revenue), 4) AS top_5pct_share FROM pd""")
def revenue_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.revenue_concentration(EV(spark, sf_dir))


@query("top_spenders", _PAID + "SELECT uid, round(revenue, 2) AS revenue FROM pd WHERE place <= 5")
def top_spenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.top_spenders(EV(spark, sf_dir))


_DUP = f"""WITH {STD}, dp AS (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_events FROM (
  SELECT count(*) AS n FROM std GROUP BY uid, ts, event_raw, grp, product, amount))
"""


@query("duplicate_events", _DUP + "SELECT * FROM dp")
def duplicate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.duplicate_events(std_events(spark, sf_dir))


@query("data_quality", _DUP + """, q AS (SELECT count(*) AS input_rows, count(*) AS normalized_rows, CAST(0 AS BIGINT) AS missing_uid_rows,
  count(*) FILTER (WHERE ts IS NULL) AS missing_timestamp_rows, (SELECT duplicate_events FROM dp) AS duplicate_events,
  count(*) FILTER (WHERE language_source = 'inferred') AS inferred_rows FROM std)
SELECT *, greatest(0, round(1 - (missing_uid_rows * 0.35::DOUBLE + missing_timestamp_rows * 0.25::DOUBLE + duplicate_events * 0.2::DOUBLE
  + inferred_rows * 0.2::DOUBLE) / input_rows, 3)) AS quality_score FROM q""")
def data_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = std_events(spark, sf_dir)
    raw, missing = events.agg(F.count("*"), F.count_if(F.coalesce(F.trim("uid"), F.lit("")) == "")).first()
    return metrics.data_quality(raw, missing, events)


_FLOW = WITH + """, fw AS (SELECT uid, session_id, ts, ix, event_raw AS code, event_label AS label, event_type, coalesce(grp, '') AS grp FROM ev),
tu AS (SELECT count(DISTINCT uid) AS n FROM fw)
"""


def _flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.coded(EV(spark, sf_dir))


_SEEN = ("strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, "
         "round(count(DISTINCT uid) / (SELECT n FROM tu), 4) AS user_rate, round(count(*) / count(DISTINCT uid), 2) AS events_per_user")


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_seen", "last_seen")})


@query("code_participation", _FLOW + f"""SELECT code, min(label) AS label, min(event_type) AS event_type, min(grp) AS "group", count(*) AS count,
  count(DISTINCT uid) AS user_count, count(DISTINCT session_id) AS session_count, {_SEEN} FROM fw GROUP BY code ORDER BY count DESC, user_count DESC, code LIMIT 20""")
def code_participation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(flow.code_participation(_flow(spark, sf_dir)))


@query("content_participation", _FLOW + f"""SELECT grp AS "group", count(*) AS count, count(DISTINCT uid) AS user_count, count(DISTINCT session_id) AS session_count,
  count(DISTINCT code) AS code_count, {_SEEN} FROM fw WHERE grp <> '' GROUP BY grp ORDER BY count DESC, user_count DESC, grp LIMIT 12""")
def content_participation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(flow.content_participation(_flow(spark, sf_dir)))


_STEPS = _FLOW + """, nx AS (SELECT uid, code, lead(code) OVER (PARTITION BY uid ORDER BY ix) AS to_code FROM fw),
st AS (SELECT code AS from_code, to_code, count(*) AS count, count(DISTINCT uid) AS user_count FROM nx WHERE to_code IS NOT NULL GROUP BY ALL),
tr AS (SELECT st.*, f.n AS from_user_count, round(user_count / (SELECT n FROM tu), 4) AS user_rate, round(user_count / f.n, 4) AS transition_rate
  FROM st JOIN (SELECT code, count(DISTINCT uid) AS n FROM fw GROUP BY code) f ON f.code = st.from_code
  ORDER BY count DESC, user_count DESC, from_code, to_code LIMIT 30)
"""


@query("transition_rates", _STEPS + "SELECT * FROM tr")
def transition_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.transition_rates(_flow(spark, sf_dir))


@query("loop_patterns", _STEPS + "SELECT * FROM tr WHERE from_code = to_code ORDER BY user_count DESC, count DESC, from_code LIMIT 8")
def loop_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.loop_patterns(_flow(spark, sf_dir))


@query("short_interval_repeats", _FLOW + """, wn AS (SELECT a.uid, a.event_type AS code, a.ts, count(*) AS n, max(date_diff('second', a.ts, b.ts)) AS span
  FROM (SELECT DISTINCT uid, event_type, ts FROM fw) a JOIN fw b ON b.uid = a.uid AND b.event_type = a.event_type AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 DAY
  GROUP BY a.uid, a.event_type, a.ts HAVING count(*) >= 3),
al AS (SELECT uid, event_type AS code, count(*) AS total FROM fw GROUP BY ALL),
us AS (SELECT uid, code, count(*) AS w, max(n) AS most, min(span) AS least, min(total) AS total FROM wn JOIN al USING (uid, code) GROUP BY uid, code)
SELECT code, count(*) AS user_count, CAST(sum(w) AS BIGINT) AS burst_window_count, max(most) AS max_events_in_window, min(least) AS shortest_window_seconds,
  CAST(sum(total) AS BIGINT) AS total_events,
  round(count(*) / (SELECT n FROM tu), 4) AS user_rate, CAST(86400 AS BIGINT) AS window_seconds FROM us GROUP BY code
ORDER BY user_count DESC, burst_window_count DESC, max_events_in_window DESC, code LIMIT 12""")
def short_interval_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_type = _flow(spark, sf_dir).withColumn("code", F.col("event_type"))
    return flow.short_interval_repeats(by_type, window_seconds=86_400)


_RUNS = _FLOW + """, lg AS (SELECT *, CASE WHEN lag(code) OVER (PARTITION BY uid ORDER BY ix) = code THEN 0 ELSE 1 END AS opens FROM fw),
rn AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY uid ORDER BY ix) - 1 AS BIGINT) AS run FROM lg),
cr AS (SELECT uid, run, min(code) AS code, arg_min(label, ix) AS label, count(*) AS count, min(ts) AS first_ts, max(ts) AS last_ts FROM rn GROUP BY uid, run)
"""


@query("collapsed_runs", _RUNS + "SELECT uid, run, code, label, count FROM cr")
def collapsed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.collapsed_runs(_flow(spark, sf_dir)).select("uid", "run", "code", "label", "count")


@query("common_paths", _RUNS + """, ah AS (SELECT uid, code, lead(code, 1) OVER w AS c1, lead(code, 2) OVER w AS c2, lead(code, 3) OVER w AS c3 FROM cr
  WINDOW w AS (PARTITION BY uid ORDER BY run)),
gr AS (SELECT uid, code || ' -> ' || c1 AS path_text, 2 AS length FROM ah WHERE c1 IS NOT NULL
  UNION ALL SELECT uid, code || ' -> ' || c1 || ' -> ' || c2, 3 FROM ah WHERE c2 IS NOT NULL
  UNION ALL SELECT uid, code || ' -> ' || c1 || ' -> ' || c2 || ' -> ' || c3, 4 FROM ah WHERE c3 IS NOT NULL)
SELECT path_text, CAST(length AS BIGINT) AS length, count(*) AS occurrence_count, count(DISTINCT uid) AS user_count,
  round(count(DISTINCT uid) / (SELECT n FROM tu), 4) AS user_rate FROM gr GROUP BY ALL ORDER BY user_count DESC, length DESC, occurrence_count DESC, path_text LIMIT 12""")
def common_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.common_paths(_flow(spark, sf_dir))


def _ends(pick: str) -> str:
    return _FLOW + f"""SELECT code, min(label) AS label, count(*) AS user_count, round(count(*) / (SELECT n FROM tu), 4) AS user_rate FROM (
  SELECT uid, {pick}(code, ix) AS code, {pick}(label, ix) AS label FROM fw GROUP BY uid) GROUP BY code ORDER BY user_count DESC, code LIMIT 8"""


@query("entry_events", _ends("arg_min"))
def entry_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.end_codes(_flow(spark, sf_dir), last=False)


@query("exit_events", _ends("arg_max"))
def exit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.end_codes(_flow(spark, sf_dir), last=True)


@query("behavior_outliers", _STEPS + """, cp AS (SELECT code, count(*) AS n, count(DISTINCT uid) AS users, round(count(DISTINCT uid) / (SELECT n FROM tu), 4) AS user_rate,
  round(count(*) / count(DISTINCT uid), 2) AS epu FROM fw GROUP BY code ORDER BY n DESC, users DESC, code LIMIT 20),
lp AS (SELECT * FROM tr WHERE from_code = to_code ORDER BY user_count DESC, count DESC, from_code LIMIT 8),
wn AS (SELECT a.uid, a.code, a.ts, count(*) AS n FROM (SELECT DISTINCT uid, code, ts FROM fw) a JOIN fw b ON b.uid = a.uid AND b.code = a.code
  AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 DAY GROUP BY a.uid, a.code, a.ts HAVING count(*) >= 3),
sr AS (SELECT code, count(DISTINCT uid) AS users, count(*) AS w, max(n) AS most FROM wn GROUP BY code ORDER BY users DESC, w DESC, most DESC, code LIMIT 12),
ex AS (SELECT code, count(*) AS users, round(count(*) / (SELECT n FROM tu), 4) AS user_rate FROM (SELECT uid, arg_max(code, ix) AS code FROM fw GROUP BY uid)
  GROUP BY code ORDER BY users DESC, code LIMIT 8),
ot AS (
  SELECT 'high_repeat_common' AS kind, code, NULL AS to_code, user_rate, CAST(epu AS DOUBLE) AS metric FROM cp WHERE user_rate >= 0.7::DOUBLE AND epu >= 8
  UNION ALL SELECT 'minority_heavy', code, NULL, user_rate, n FROM cp WHERE user_rate <= 0.35::DOUBLE AND n >= greatest(5, users)
  UNION ALL SELECT 'loop_pattern', from_code, to_code, user_rate, count FROM lp WHERE user_rate >= 0.4::DOUBLE OR count >= greatest(5, user_count)
  UNION ALL SELECT 'short_interval_repeat', code, NULL, round(users / (SELECT n FROM tu), 4), most FROM sr
  UNION ALL SELECT 'stop_point', code, NULL, user_rate, users FROM ex WHERE user_rate >= 0.6::DOUBLE
  UNION ALL SELECT 'dominant_transition', from_code, to_code, user_rate, transition_rate FROM tr
    WHERE from_user_count >= greatest(2, (SELECT n FROM tu) // 2) AND transition_rate >= 0.8::DOUBLE)
SELECT * FROM ot ORDER BY user_rate DESC, metric DESC, kind, code, to_code NULLS FIRST LIMIT 12""")
def behavior_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.outliers(_flow(spark, sf_dir), window_seconds=86_400)


def _sequence_sql(key: str) -> str:
    return _FLOW + f""", tp AS (SELECT {key}, count(*) AS event_count, date_diff('second', min(ts), max(ts)) AS duration_sec FROM fw GROUP BY {key}
  ORDER BY event_count DESC, {key} LIMIT 8),
lg AS (SELECT *, CASE WHEN lag(code) OVER (PARTITION BY {key} ORDER BY ix) = code THEN 0 ELSE 1 END AS opens FROM fw WHERE {key} IN (SELECT {key} FROM tp)),
rn AS (SELECT *, sum(opens) OVER (PARTITION BY {key} ORDER BY ix) - 1 AS run FROM lg),
cr AS (SELECT {key}, run, arg_min(label, ix) AS label, count(*) AS n FROM rn GROUP BY {key}, run),
kc AS (SELECT {key}, string_agg(code || ':' || n, '|' ORDER BY n DESC, code) AS top_codes FROM (
  SELECT {key}, code, count(*) AS n, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, code) AS place FROM fw GROUP BY {key}, code) WHERE place <= 5 GROUP BY {key})
SELECT {key}, top_codes, event_count, duration_sec, count(*) AS run_count, string_agg(label || CASE WHEN n > 1 THEN ' x' || n ELSE '' END, ' -> ' ORDER BY run) FILTER (WHERE run < 24)
  || CASE WHEN count(*) > 24 THEN ' -> ... +' || (count(*) - 24) || ' more' ELSE '' END AS sequence FROM tp JOIN cr USING ({key}) JOIN kc USING ({key}) GROUP BY ALL"""


def _told(df: DataFrame) -> DataFrame:
    return df.withColumn("top_codes", F.array_join(F.transform("top_codes", lambda c: F.concat_ws(":", c["code"], c["count"].cast("string"))), "|"))


@query("user_sequence_samples", _sequence_sql("uid"))
def user_sequence_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(flow.sequences(_flow(spark, sf_dir)))


@query("session_sequence_samples", _sequence_sql("session_id"))
def session_sequence_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(flow.sequences(_flow(spark, sf_dir), key="session_id"))


@query("language_suggestions", f"""WITH {STD} SELECT event_raw, event_label, event_type, coalesce(grp, '') AS "group", language_source, count(*) AS count,
  language_source <> 'dictionary' OR event_type = 'event' AS needs_confirmation FROM std GROUP BY ALL""")
def language_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnosis.language_suggestions(std_events(spark, sf_dir)).withColumn("group", F.coalesce("group", F.lit("")))


@query("event_classification", """WITH d AS (SELECT DISTINCT event_type || '_enter_' || props AS raw FROM events),
t AS (SELECT raw, list_filter(list_transform(regexp_split_to_array(regexp_replace(raw, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[^A-Za-z0-9가-힣]+'),
  lambda x: lower(x)), lambda x: x <> '') AS ts FROM d)
SELECT raw, array_to_string(ts, ' ') AS tokens, CASE WHEN list_has_any(ts, ['purchase', 'buy', 'pay', 'iap']) THEN 'purchase'
  WHEN list_contains(ts, 'click') THEN 'click' WHEN list_contains(ts, 'view') THEN 'view' ELSE 'session_start' END AS event_type,
  array_to_string(list_transform(ts, lambda x: CASE x WHEN 'enter' THEN '입장' WHEN 'click' THEN '클릭' WHEN 'view' THEN '노출' WHEN 'purchase' THEN '구매' ELSE x END), ' ') AS label FROM t""")
def event_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat("event_type", F.lit("_enter_"), "props").alias("raw")).distinct()
    return raw.select("raw", F.array_join(lexicon.tokens(F.col("raw")), " ").alias("tokens"),
                      lexicon.event_type_of(F.col("raw")).alias("event_type"), lexicon.readable(F.col("raw")).alias("label"))


@query("token_label", """SELECT DISTINCT p_name, coalesce(nullif(array_to_string(list_filter(list_transform(regexp_split_to_array(
  regexp_replace(p_name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[^A-Za-z0-9가-힣]+'), lambda x: lower(x)), lambda x: x <> ''), ' '), ''), p_name) AS label FROM part""")
def token_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_name", lexicon.readable(F.col("p_name")).alias("label")).distinct()


_ISSUES = _CONTENT + """, md AS (SELECT median(participant_rate) AS m FROM ct),
iss AS (
  SELECT 'content_friction' AS issue_type, "group" AS subject, CASE WHEN avg_wait_sec >= 45 THEN '위험' ELSE '주의' END AS severity,
    least(1.0::DOUBLE, avg_wait_sec / 60) AS impact, CASE WHEN retry_after_failure_rate < 0.35 THEN 0.75::DOUBLE ELSE 0.55::DOUBLE END AS evidence, 0.75::DOUBLE AS sufficiency
  FROM ct WHERE avg_wait_sec >= 30
  UNION ALL SELECT 'content_failure', "group", CASE WHEN failure_rate >= 0.6 THEN '위험' ELSE '주의' END, failure_rate,
    CASE WHEN retry_after_failure_rate < 0.35 THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END, 0.8::DOUBLE FROM ct WHERE failure_rate >= 0.4
  UNION ALL SELECT 'content_usage_revenue_gap', "group", '주의', 0.6::DOUBLE, 0.6::DOUBLE, 0.65::DOUBLE FROM ct, md
    WHERE participant_rate < md.m * 0.55::DOUBLE AND revenue_after_content > 0)
"""


@query("content_diagnosis", _ISSUES + "SELECT issue_type, subject, severity, round(impact, 4) AS impact, evidence, sufficiency, round(0.4::DOUBLE * impact + 0.4::DOUBLE * evidence + 0.2::DOUBLE * sufficiency, 3) AS confidence FROM iss")
def content_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = diagnosis.content_issues(metrics.content_facts(EV(spark, sf_dir)))
    return found.withColumn("impact", F.round("impact", 4))


@query("issue_board_totals", _ISSUES + "SELECT count(*) AS issues, count(*) FILTER (WHERE severity = '위험') AS dangers, round(coalesce(sum(impact), 0) * 100, 2) AS impact FROM iss")
def issue_board_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnosis.board_totals(diagnosis.content_issues(metrics.content_facts(EV(spark, sf_dir))))


_REVENUE = _PRIOR[len(WITH):] + _PAID[len(WITH):] + """, tt AS (SELECT coalesce(sum(amount) FILTER (WHERE event_type = 'purchase'), 0) AS total FROM ev),
bp AS (SELECT product, round(sum(amount), 2) AS revenue FROM ev WHERE event_type = 'purchase' AND product IS NOT NULL GROUP BY product ORDER BY 2 DESC, 1 LIMIT 1),
tg AS (SELECT content_group FROM pr WHERE content_group <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
wh AS (SELECT round(max(revenue) / sum(revenue), 4) AS share FROM pd),
rv AS (
  SELECT 'revenue_missing' AS issue_type, 'revenue' AS subject, '주의' AS severity, 0.8::DOUBLE AS impact, 0.8::DOUBLE AS evidence, 0.5::DOUBLE AS sufficiency FROM tt WHERE total <= 0
  UNION ALL SELECT 'whale_concentration', 'users', '주의', share, 0.7::DOUBLE, 0.75::DOUBLE FROM wh, tt WHERE share >= 0.35::DOUBLE AND total > 0
  UNION ALL SELECT 'product_concentration', product, '주의', revenue / total, 0.75::DOUBLE, 0.75::DOUBLE FROM bp, tt WHERE total > 0 AND revenue / total >= 0.5::DOUBLE
  UNION ALL SELECT 'content_to_purchase_context', content_group, '정보', 0.55::DOUBLE, 0.65::DOUBLE, 0.65::DOUBLE FROM tg, tt WHERE total > 0)
"""
_CONFIDENT = "round(impact, 4) AS impact, evidence, sufficiency, round(impact * 0.4::DOUBLE + evidence * 0.4::DOUBLE + sufficiency * 0.2::DOUBLE, 3) AS confidence"


@query("revenue_diagnosis", WITH + _REVENUE + f"SELECT issue_type, subject, severity, {_CONFIDENT} FROM rv")
def revenue_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = EV(spark, sf_dir)
    return diagnosis.revenue_issues(ordered, facts.prior_events(ordered, minutes=DAY)).withColumn("impact", F.round("impact", 4))


@query("alerts", _ISSUES + _REVENUE + f""", al AS (SELECT issue_type, subject, severity, {_CONFIDENT} FROM (SELECT * FROM iss UNION ALL SELECT * FROM rv))
SELECT * FROM al ORDER BY CASE severity WHEN '위험' THEN 0 WHEN '주의' THEN 1 ELSE 2 END, confidence DESC, issue_type, subject LIMIT 5""")
def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = EV(spark, sf_dir)
    found = diagnosis.content_issues(metrics.content_facts(ordered)).unionByName(
        diagnosis.revenue_issues(ordered, facts.prior_events(ordered, minutes=DAY)))
    return diagnosis.alerts(found).withColumn("impact", F.round("impact", 4))


_PERCENT = "printf('%.1f%%', round({} * 100, 1))"
_RETRIED = f"'실패 후 재도전율 ' || {_PERCENT.format('retry_after_failure_rate')}"


@query("issue_texts", _CONTENT + f""", md AS (SELECT median(participant_rate) AS m FROM ct)
SELECT "group" || ' 대기/매칭 지연 의심' AS title, concat_ws('|', '평균 대기시간 ' || printf('%.1f', round(avg_wait_sec, 1)) || '초', {_RETRIED},
  '참여율 ' || {_PERCENT.format('participant_rate')}) AS evidence FROM ct WHERE avg_wait_sec >= 30
UNION ALL SELECT "group" || ' 실패율 높음', concat_ws('|', '실패율 ' || {_PERCENT.format('failure_rate')}, {_RETRIED}, '참여 유저 ' || participant_users || '명')
  FROM ct WHERE failure_rate >= 0.4
UNION ALL SELECT "group" || ' 이용률 낮지만 매출 연결 있음', concat_ws('|', '참여율 ' || {_PERCENT.format('participant_rate')},
  '콘텐츠 이후 연결 매출 ' || format('{{:,}}', CAST(round(revenue_after_content, 0) AS BIGINT)), '전체 콘텐츠 참여율 중앙값 ' || {_PERCENT.format('md.m')})
  FROM ct, md WHERE participant_rate < md.m * 0.55::DOUBLE AND revenue_after_content > 0""")
def issue_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = diagnosis.described_content(metrics.content_facts(EV(spark, sf_dir)))
    return found.select("title", F.array_join("said", "|").alias("evidence"))


@query("issue_board", _ISSUES + "SELECT issue_type, subject, severity, round(impact, 4) AS impact FROM iss WHERE severity = '위험'")
def issue_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = diagnosis.content_issues(metrics.content_facts(EV(spark, sf_dir)))
    return diagnosis.sorted_issues(found, "severity", dangers_only=True).select("issue_type", "subject", "severity", F.round("impact", 4).alias("impact"))


@query("log_mapping_issue", f"""WITH {STD}, g AS (SELECT event_raw, count(*) AS n FROM std GROUP BY event_raw, event_label, event_type, grp)
SELECT '추론 처리 행 ' || format('{{:,}}', (SELECT count(*) FROM std)) || '건' AS inferred, '미확인 로그 ' || (SELECT count(*) FROM g) || '개' AS codes""")
def log_mapping_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = std_events(spark, sf_dir).withColumn("language_source", F.lit("inferred"))
    rows = events.count()
    found = diagnosis.mapping_issues(metrics.data_quality(rows, 0, events), diagnosis.language_suggestions(events))
    return found.select(F.get("said", F.lit(1)).alias("inferred"), F.get("said", F.lit(0)).alias("codes"))


@query("language_rows", f"""WITH {STD} SELECT event_raw, event_type, coalesce(grp, '') AS "group", count(*) AS count, language_source <> 'dictionary' OR event_type = 'event' AS needs_confirmation
FROM std GROUP BY event_raw, event_label, event_type, grp, language_source ORDER BY needs_confirmation DESC, count DESC, event_raw, event_type, grp NULLS FIRST LIMIT 40""")
def language_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnosis.language_rows(diagnosis.language_suggestions(std_events(spark, sf_dir))).select(
        "event_raw", "event_type", F.coalesce("group", F.lit("")).alias("group"), "count", "needs_confirmation")


@query("codes_in_texts", """WITH k AS (SELECT list(DISTINCT event_type || '_' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 4)) AS known FROM events),
t AS (SELECT event_id, event_type || '_1 then view_2, seen 2024-01-02 by ' || event_type || '_3 and u_9' AS said FROM events)
SELECT event_id, array_to_string(list_filter(regexp_extract_all(said, '[A-Za-z0-9_:-]{3,}'), lambda x, i: list_contains(known, x)
  AND list_position(regexp_extract_all(said, '[A-Za-z0-9_:-]{3,}'), x) = i), ',') AS codes FROM t, k""")
def codes_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    code = F.concat_ws("_", "event_type", (F.get_json_object("props", "$.k").cast("int") % 4).cast("string"))
    said = F.concat("event_type", F.lit("_1 then view_2, seen 2024-01-02 by "), "event_type", F.lit("_3 and u_9"))
    found = diagnosis.codes_in(events.select(F.col("event_id").alias("id"), said.alias("said")), events.select(code.alias("code")).distinct())
    return found.select(F.col("id").alias("event_id"), F.array_join("codes", ",").alias("codes"))


@query("content_risk", _CONTENT + """, rk AS (SELECT "group", failure_rate * 0.5::DOUBLE + least(coalesce(avg_wait_sec, 0) / 60, 1.0::DOUBLE) * 0.32::DOUBLE
  + (1 - retry_after_failure_rate) * 0.18::DOUBLE AS r, revenue_after_content AS v, max(revenue_after_content) OVER () AS mx FROM ct WHERE "group" <> '상품')
SELECT "group", round(r, 4) AS risk, CASE WHEN r >= 0.62::DOUBLE THEN 'danger' WHEN r >= 0.4::DOUBLE THEN 'warning' ELSE 'normal' END AS level,
  round(CASE WHEN mx > 0 THEN v / mx ELSE 0 END, 4) AS revenue_scale FROM rk""")
def content_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.content_risk(metrics.content_facts(EV(spark, sf_dir)))


@query("conversation_role_paths", """WITH o AS (SELECT conv_id, turn, role, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS opens FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT conv_id, run, min(role) AS role FROM (SELECT *, sum(opens) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM o) GROUP BY ALL),
a AS (SELECT conv_id, role, lead(role, 1) OVER w AS c1, lead(role, 2) OVER w AS c2, lead(role, 3) OVER w AS c3 FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY run)),
g AS (SELECT conv_id, role || ' -> ' || c1 AS path_text, 2 AS length FROM a WHERE c1 IS NOT NULL UNION ALL SELECT conv_id, role || ' -> ' || c1 || ' -> ' || c2, 3 FROM a WHERE c2 IS NOT NULL
  UNION ALL SELECT conv_id, role || ' -> ' || c1 || ' -> ' || c2 || ' -> ' || c3, 4 FROM a WHERE c3 IS NOT NULL)
SELECT path_text, CAST(length AS BIGINT) AS length, count(*) AS occurrence_count, count(DISTINCT conv_id) AS user_count,
  round(count(DISTINCT conv_id) / (SELECT count(DISTINCT conv_id) FROM conversations), 4) AS user_rate FROM g GROUP BY ALL""")
def conversation_role_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.sessions import sessionize
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.col("turn").alias("src"), F.col("conv_id").cast("string").alias("uid"), F.lit(None).cast("timestamp_ntz").alias("ts"),
        F.col("role").alias("event_raw"), F.col("role").alias("event_label"), F.col("role").alias("event_type"),
        *[F.lit(None).cast("string").alias(c) for c in ("group", "content_label", "content_id")])
    return flow.common_paths(flow.coded(sessionize(rows)), limit=None)
