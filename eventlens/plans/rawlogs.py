"""Queries over raw log files, written from the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Language
from ..operators import diagnosis, facts, metrics
from ..operators.sessions import sessionize
from ..sources import files, roles
from ..sources.scratch import new_folder, written
from . import events, pipeline
from .standardize import code_dictionary, meant, with_user
from .testbed import STD, std_events

QUERIES, ORACLES = {}, {}


#: What the raw log's dictionary says.
RAW_WORDS = Language({
    "event_labels": {"login": {"label": "접속", "event_type": "session_start", "group": None}},
    "content_labels": {"arena": {"label": "투기장", "type": "pvp"}},
    "product_labels": {"starter_pack": {"label": "초보자 패키지", "category": "pack"}}})


def raw_log(spark: SparkSession, sf_dir: str) -> str:
    """The table of events as raw CSV files, under codes of a game's log."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    code = (F.when(kind == "signup", "login").when(kind == "view", "shop_view").when(kind == "purchase", "pkg_starter_buy")
            .when(kind == "click", F.when(k % 2 == 0, "arena_enter").otherwise("raid_clear"))
            .otherwise(F.when(k % 4 == 1, "mystery_signal").otherwise("raid_clear_fail")))
    content = F.when(code == "arena_enter", "arena").when(code.isin("raid_clear", "mystery_signal", "raid_clear_fail"), "raid").otherwise("")
    lost = code == "mystery_signal"
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", F.when(k == 7, "").otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("uid"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("event_time"), code.alias("event_name"), content.alias("content_id"),
        F.when(kind == "purchase", "starter_pack").otherwise("").alias("product_id"),
        F.when(kind == "purchase", F.col("value").cast("string")).otherwise("").alias("amount"),
        F.when(lost, "45").otherwise("").alias("wait_time_sec"), F.when(lost, "timeout").otherwise("").alias("result"))
    folder = new_folder(spark)
    in_order(raw, 2).drop("event_id").write.csv(folder, header=True, emptyValue="")
    return folder


#: Rows to a raw file, which one task has to sort and write.
FILE_ROWS = 500_000


def in_order(raw: DataFrame, files: int) -> DataFrame:
    """Rows in the order of events, dealt out to files in that order: as many
    as given, or more where they would be too large."""
    return raw.repartitionByRange(max(files, -(-raw.count() // FILE_ROWS)), "event_id").sortWithinPartitions("event_id")


def raw_standard_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw files read, understood and brought to standard events."""
    found = pipeline.standard_events(spark, [raw_log(spark, sf_dir)], RAW_WORDS)
    return with_user(found).select(
        "uid", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "event_raw", "event_label", "event_type", "group", "content_label",
        "product_label", "amount", "wait_time_sec", "language_source")


def raw_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the raw files lack, and how much of them was inferred."""
    found = pipeline.standard_events(spark, [raw_log(spark, sf_dir)], RAW_WORDS)
    return found.agg(F.count("*").alias("input_rows"), F.count_if(F.trim("uid") == "").alias("missing_uid_rows"),
                     F.count_if((F.trim("uid") != "") & (F.col("language_source") == "inferred")).alias("inferred_rows"))


def raw_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw files without event names, under other columns: types by shape."""
    log = spark.read.csv(raw_log(spark, sf_dir), header=True)
    folder = new_folder(spark)
    log.select(F.col("uid").alias("acct"), F.col("event_time").alias("log_at"), F.col("content_id").alias("content"), F.col("product_id").alias("sku"),
               F.col("amount").alias("krw"), F.col("wait_time_sec").alias("queue_seconds"), F.col("result").alias("state")).coalesce(2).write.csv(folder, header=True, emptyValue="")
    found = pipeline.standard_events(spark, [folder], Language())
    return with_user(found).groupBy("event_type").agg(F.count("*").alias("events"), F.count_distinct("uid").alias("users"),
                                                      F.round(F.sum("amount"), 2).alias("amount"))


def _understood(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ordered events, quality, issues) of the raw log."""
    raw = pipeline.understand(spark, [raw_log(spark, sf_dir)], RAW_WORDS, new_folder(spark, "raw"))
    rows, missing = raw.rows.agg(F.count("*"), F.count_if(F.trim("uid") == "")).first()
    # What several others read is worked out once.
    ordered = written(sessionize(with_user(meant(raw.rows, RAW_WORDS))), "ordered")
    quality, prior = written(metrics.data_quality(rows, missing, ordered), "quality"), written(facts.prior_events(ordered, minutes=events.DAY), "prior")
    content, suggestions = written(metrics.content_facts(ordered), "content"), written(diagnosis.language_suggestions(ordered), "suggestions")
    return ordered, quality, diagnosis.found_issues(content, ordered, prior, quality, suggestions)


_ISSUE = ["part", *diagnosis.ISSUE]


def raw_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All issues of the raw log, codes to be mapped among them."""
    return _understood(spark, sf_dir)[2].select(*_ISSUE).withColumn("impact", F.round("impact", 4))


def raw_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alerts of the raw log, in their order."""
    found = diagnosis.alerts(_understood(spark, sf_dir)[2].select(*_ISSUE))
    return found.withColumn("impact", F.round("impact", 4))


def raw_file_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw log as many files of three layouts, read by one scan for each."""
    folder = new_folder(spark)
    log = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("uid"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("event_time"),
        F.concat(F.col("event_type"), F.lit('_"1;2"\t')).alias("event_name"), F.col("value").cast("string").alias("amount"))
    layouts = ((",", "csv", {}), ("\t", "tsv", {"uid": "acct", "event_time": "log_at", "event_name": "code", "amount": "krw"}),
               (";", "txt", {"uid": "user_no", "event_time": "log_dt", "event_name": "behavior", "amount": "won"}))
    for i, (sep, kind, names) in enumerate(layouts):
        part = in_order(log.where(F.col("event_id") % 3 == i), 12).withColumnsRenamed(names)
        # Columns in another order, so that only names tell them.
        part.select(*(part.columns[:0:-1] if i else part.columns[1:])).write.option("extension", kind).csv(f"{folder}/{kind}", header=True, sep=sep, escape='"')
    found = pipeline.understand(spark, [folder], Language())
    return found.rows.groupBy(F.col("table").alias("layout"), "event_raw").agg(
        F.count("*").alias("events"), F.count_distinct("uid").alias("users"),
        F.round(F.sum("amount"), 2).alias("amount"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


def raw_unnamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log whose header says nothing: roles come from the values alone."""
    folder = new_folder(spark)
    log = spark.read.parquet(f"{sf_dir}/events.parquet")
    log.select(
        F.concat(F.lit("player-"), (F.col("event_id") % 5000).cast("string")).alias("c1"), F.date_format("ts", "yyyy/M/d H:mm:ss").alias("c2"),
        F.col("event_type").alias("c3"), F.when(F.col("event_type") == "error", "fail").otherwise("success").alias("c4"),
        F.col("value").cast("string").alias("c5")).write.csv(folder, header=True)
    (table,) = files.ingest(spark, [folder])
    raw = table.drop(*files.OWN)
    of = roles.infer(roles.profile(raw))
    return raw.groupBy(F.col(of["event"]).alias("event")).agg(
        F.count("*").alias("events"), F.count_distinct(of["uid"]).alias("users"), F.min(of["result"]).alias("result"),
        F.round(F.sum(F.col(of["amount"]).cast("double")), 2).alias("amount"), F.max(of["timestamp"]).alias("last_text"))


def role_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every column of several tables looks like, over all their rows."""
    found = None
    for name in ("events", "orders", "customer", "nation"):
        part = roles.profile(spark.read.parquet(f"{sf_dir}/{name}.parquet"), rows=None).select(
            F.lit(name).alias("table_name"), "name", "filled", *[F.round(c, 6).alias(c) for c in ("distinct", "numeric", "positive", "worded", "dated", "result")])
        found = part if found is None else found.unionByName(part)
    return found


#: Some codes of the adapted events, with and without a sureness set by hand.
CODE_WORDS = Language({"event_labels": {
    "signup_0": {"label": "가입", "event_type": "session_start", "group": "계정"},
    "error_1": {"label": "오류", "event_type": "content_fail", "group": None, "confidence": 0.9}}})


def code_meanings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each different code once: what it means, by what, and how surely."""
    return code_dictionary(std_events(spark, sf_dir), CODE_WORDS).withColumnRenamed("code_type", "event_type").withColumnRenamed("code_group", "group")


def meant_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events given their meaning by the dictionary of different codes."""
    given = std_events(spark, sf_dir).drop("event_label", "event_type", "group", "language_source")
    rows = given.select("src", "uid", "ts", "event_raw", "content_id", "product_id", "amount", "duration_sec", "wait_time_sec", "result", "source_file")
    return meant(rows, CODE_WORDS).groupBy("event_raw", "event_label", "event_type", "group", "language_source").agg(F.count("*").alias("events"))


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as nested JSON, with braces and quotes inside texts."""
    note = F.concat(F.lit('} "'), F.col("event_type"), F.lit('" { [\\'))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.to_json(F.struct(
        "event_id", "event_type", F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), note.alias("note"), F.array(F.struct("user_id")).alias("who")).alias("props"))).alias("value"))


#: Events to a JSON document, which one task has to write.
DOCUMENT_ROWS = 500_000


def json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as JSON documents, each an array, read back in many tasks."""
    folder = new_folder(spark)
    lines = _nested(spark, sf_dir)
    # Documents are ranges of events, as many as they need.
    n = max(1, -(-lines.count() // DOCUMENT_ROWS))
    bounds = (lines.agg(F.percentile_approx("event_id", [i / n for i in range(1, n)], 10_000)).first()[0] or []) if n > 1 else []
    number = sum((F.coalesce(F.col("event_id") > b, F.lit(False)).cast("int") for b in bounds), F.lit(0))
    numbered = lines.select(number.alias("document"), F.lit(0).alias("part"), "event_id", "value")
    first = F.row_number().over(Window.partitionBy("document").orderBy("part", "event_id")) == 1
    closing = numbered.select("document").distinct().select("document", F.lit(1).alias("part"), F.lit(None).cast("long").alias("event_id"), F.lit("]").alias("value"))
    text = F.when(F.col("part") == 1, F.col("value")).when(first, F.concat(F.lit("[\n  "), "value")).otherwise(F.concat(F.lit("  ,"), "value"))
    (numbered.unionByName(closing).repartitionById(n, F.col("document")).withColumn("text", text).sortWithinPartitions("document", "part", "event_id")
     .select("document", F.col("text").alias("value")).write.partitionBy("document").text(f"{folder}/made"))
    made = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/made")
    fs = made.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(made):
        if status.isDirectory():
            renamed(spark, status.getPath().toString(), ".txt", ".json")
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", "UTC")
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    # A document is read in several tasks, whatever its size.
    size = fs.getContentSummary(made).getLength() // n
    session.conf.set("spark.sql.files.maxPartitionBytes", str(min(16 << 20, max(64 << 10, size // 4))))
    return _flat(session, files.ingest(session, [f"{folder}/made"]))


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as JSON lines, read back."""
    folder = new_folder(spark)
    _nested(spark, sf_dir).select("value").write.text(folder)
    renamed(spark, folder, ".txt", ".jsonl")
    return _flat(spark, files.ingest(spark, [folder]))


def _flat(spark: SparkSession, tables: list[DataFrame]) -> DataFrame:
    table = files.fields(spark, tables, ["event_id", "event_type", "props.k", "props.note", "props.who"])
    return table.select(F.col("event_id").cast("long").alias("event_id"), "event_type", F.col("`props.k`").cast("long").alias("k"),
                        F.col("`props.note`").alias("note"), F.col("`props.who`").alias("who"))


def renamed(spark: SparkSession, folder: str, old: str, new: str) -> None:
    """Give a folder's files another ending."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(path(folder)):
        name = status.getPath().getName()
        if name.endswith(old):
            fs.rename(status.getPath(), path(folder, name[: -len(old)] + new))


for _query in (raw_standard_events, raw_quality, raw_shapes, raw_issues, raw_alerts, raw_file_groups, raw_unnamed, role_profile, code_meanings, meant_by_code,
               json_array, json_lines):
    QUERIES[_query.__name__] = _query

RAW = """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
r AS (SELECT event_id, CASE WHEN k = 7 THEN '' ELSE 'u' || user_id END AS uid, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, value, CASE event_type WHEN 'signup' THEN 'login'
  WHEN 'view' THEN 'shop_view' WHEN 'purchase' THEN 'pkg_starter_buy' WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN 'arena_enter' ELSE 'raid_clear' END
  ELSE CASE WHEN k % 4 = 1 THEN 'mystery_signal' ELSE 'raid_clear_fail' END END AS raw FROM e),
m(raw, label, type, grp, content) AS (VALUES ('login', '접속', 'session_start', NULL, NULL), ('shop_view', '상점 노출', 'product_view', '상점', '상점'),
  ('pkg_starter_buy', '패키지 초보자 구매', 'purchase', '상품', '상품'), ('arena_enter', '아레나 입장', 'content_enter', '투기장', '투기장'),
  ('raid_clear', '레이드 클리어', 'content_success', '레이드', '레이드'), ('mystery_signal', 'mystery signal', 'match_issue', 'raid', 'raid'),
  ('raid_clear_fail', '레이드 클리어 실패', 'content_fail', '레이드', '레이드'))
"""
ORACLES |= {
    "raw_standard_events": RAW + """SELECT uid, ts, raw AS event_raw, m.label AS event_label, m.type AS event_type, m.grp AS "group", m.content AS content_label,
  CASE WHEN raw = 'pkg_starter_buy' THEN '초보자 패키지' END AS product_label, CASE WHEN raw = 'pkg_starter_buy' THEN value ELSE 0 END AS amount,
  CASE WHEN raw = 'mystery_signal' THEN 45.0::DOUBLE ELSE 0 END AS wait_time_sec, CASE WHEN raw = 'login' THEN 'dictionary' ELSE 'inferred' END AS language_source
FROM r JOIN m USING (raw) WHERE uid <> ''""",
    "raw_quality": RAW + "SELECT count(*) AS input_rows, count(*) FILTER (WHERE uid = '') AS missing_uid_rows, count(*) FILTER (WHERE uid <> '' AND raw <> 'login') AS inferred_rows FROM r",
    "raw_shapes": RAW + """SELECT CASE WHEN raw = 'pkg_starter_buy' AND value > 0 THEN 'purchase' WHEN raw = 'pkg_starter_buy' THEN 'product_view'
  WHEN raw = 'mystery_signal' THEN 'match_issue' WHEN raw IN ('login', 'shop_view') THEN 'event' ELSE 'content_enter' END AS event_type,
  count(*) AS events, count(DISTINCT uid) AS users, round(sum(CASE WHEN raw = 'pkg_starter_buy' THEN value ELSE 0 END), 2) AS amount FROM r WHERE uid <> '' GROUP BY 1""",
}

#: The raw log in the form that the SQL over standard events starts from.
RAW_STD = RAW.removeprefix("WITH ").rstrip() + """,
std AS (SELECT event_id AS src, uid, CAST(ts AS TIMESTAMP) AS ts, raw AS event_raw, label AS event_label, type AS event_type, grp,
  CASE WHEN raw = 'pkg_starter_buy' THEN '초보자 패키지' END AS product, CASE WHEN raw = 'pkg_starter_buy' THEN value ELSE 0 END AS amount,
  CAST(0 AS DOUBLE) AS duration_sec, CASE WHEN raw = 'mystery_signal' THEN 45 ELSE 0 END AS wait_time_sec,
  CASE WHEN raw = 'login' THEN 'dictionary' ELSE 'inferred' END AS language_source FROM r JOIN m USING (raw) WHERE uid <> '')"""
_ALL_ISSUES = (events._ISSUES + events._REVENUE).replace(STD, RAW_STD) + f""", sh AS (SELECT avg(CASE WHEN language_source = 'inferred' THEN 1.0::DOUBLE ELSE 0 END) AS share FROM std),
al AS (SELECT part, issue_type, subject, severity, {events._CONFIDENT} FROM (
  SELECT 0 AS part, 'log_mapping_needed' AS issue_type, 'log' AS subject, '주의' AS severity, least(1.0::DOUBLE, share) AS impact, 0.8::DOUBLE AS evidence, 0.7::DOUBLE AS sufficiency
    FROM sh WHERE share >= 0.5 UNION ALL SELECT 1, * FROM iss UNION ALL SELECT 2, * FROM rv))
"""
_PROFILED = {"events": ("event_id", "ts", "user_id", "event_type", "value", "props"),
             "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
             "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), "nation": ("n_nationkey", "n_name", "n_regionkey")}
_TEXTS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS name, trim(CAST({c} AS VARCHAR)) AS t FROM {t}" for t, columns in _PROFILED.items() for c in columns)
_KNOWN = "'fail', 'failed', 'failure', 'lose', 'loss', 'lost', 'error', 'drop', 'cancel', 'abandon', 'success', 'win', 'won', 'clear', 'complete', 'timeout', 'true', 'false', 'yes', 'no', 'y', 'n', '0', '1'"
_MEANT = """CASE WHEN event_raw = 'signup_0' THEN '가입' WHEN event_raw = 'error_1' THEN '오류' ELSE replace(replace(replace(replace(event_raw, '_', ' '), 'click', '클릭'), 'view', '노출'), 'purchase', '구매') END AS event_label,
  CASE WHEN event_raw = 'signup_0' THEN 'session_start' WHEN event_raw = 'error_1' THEN 'content_fail' WHEN event_raw LIKE 'purchase%' THEN 'purchase'
    WHEN event_raw LIKE 'click%' THEN 'click' WHEN event_raw LIKE 'view%' THEN 'view' ELSE 'event' END"""
_SOURCE = "CASE WHEN event_raw IN ('signup_0', 'error_1') THEN 'dictionary' ELSE 'inferred' END AS language_source"
_NESTED_SQL = """SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '} "' || event_type || '" { [\\' AS note, '[{"user_id":' || user_id || '}]' AS who FROM events"""
ORACLES |= {
    "raw_issues": _ALL_ISSUES + "SELECT * FROM al",
    "raw_alerts": _ALL_ISSUES + "SELECT * FROM al ORDER BY CASE severity WHEN '위험' THEN 0 WHEN '주의' THEN 1 ELSE 2 END, confidence DESC, part, issue_type, subject LIMIT 5",
    "raw_file_groups": """SELECT CAST(event_id % 3 AS INTEGER) AS layout, event_type || '_"1;2"' AS event_raw, count(*) AS events, count(DISTINCT user_id) AS users,
  round(sum(value), 2) AS amount, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM events GROUP BY ALL""",
    "raw_unnamed": """SELECT event_type AS event, count(*) AS events, count(DISTINCT event_id % 5000) AS users, CASE WHEN event_type = 'error' THEN 'fail' ELSE 'success' END AS result,
  round(sum(value), 2) AS amount, max(strftime(ts, '%Y/%-m/%-d %-H:%M:%S')) AS last_text FROM events GROUP BY event_type""",
    "role_profile": rf"""WITH v AS ({_TEXTS}), f AS (SELECT *, CASE WHEN regexp_full_match(t, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(t AS DOUBLE) END AS x,
  CASE WHEN regexp_matches(t, '[0-9]{{4}}[-/년]|[0-9]{{1,2}}:[0-9]{{2}}') THEN 1 ELSE 0 END AS looks, CASE WHEN TRY_CAST(t AS TIMESTAMP) IS NOT NULL THEN 1 ELSE 0 END AS dated FROM v WHERE t <> '')
SELECT table_name, name, count(*) AS filled, round(count(DISTINCT t) / count(*), 6) AS "distinct", round(count(x) / count(*), 6) AS numeric,
  round(coalesce(count(*) FILTER (WHERE x > 0) / nullif(count(x), 0), 0), 6) AS positive,
  round(count(*) FILTER (WHERE regexp_matches(t, '[A-Za-z가-힣_]')) / count(*), 6) AS worded, round(CASE WHEN avg(looks) >= 0.4 THEN avg(dated) ELSE 0 END, 6) AS dated,
  round(count(*) FILTER (WHERE regexp_replace(lower(t), '[^a-z0-9가-힣]+', '', 'g') IN ({_KNOWN})) / count(*), 6) AS result FROM f GROUP BY table_name, name""",
    "code_meanings": f"""WITH {STD}, c AS (SELECT DISTINCT event_raw FROM std) SELECT event_raw, {_SOURCE}, {_MEANT} AS event_type, CASE event_raw WHEN 'signup_0' THEN '계정' END AS "group",
  CASE WHEN event_raw = 'signup_0' THEN 1.0 WHEN event_raw = 'error_1' THEN 0.9 WHEN event_raw LIKE 'signup%' OR event_raw LIKE 'error%' THEN 0.55 ELSE 0.75 END::DOUBLE AS confidence FROM c""",
    "meant_by_code": f"""WITH {STD}, t AS (SELECT *, {_MEANT} AS kind FROM (SELECT event_raw, grp, product, amount, wait_time_sec FROM std))
SELECT event_raw, event_label, CASE WHEN kind <> 'event' THEN kind WHEN product IS NOT NULL AND amount > 0 THEN 'purchase' WHEN wait_time_sec > 0 THEN 'match_issue'
  WHEN product IS NOT NULL THEN 'product_view' WHEN grp IS NOT NULL THEN 'content_enter' ELSE 'event' END AS event_type,
  CASE WHEN event_raw = 'signup_0' THEN '계정' WHEN event_raw = 'error_1' THEN NULL ELSE grp END AS "group", {_SOURCE}, count(*) AS events FROM t GROUP BY ALL""",
    "json_array": _NESTED_SQL, "json_lines": _NESTED_SQL,
}
