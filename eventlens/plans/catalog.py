"""All queries of the library itself, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import facts, metrics
from ..sources import exports, files, warehouse
from ..sources.scratch import new_folder
from ..streaming.sessions import session_stream
from . import events, rawlogs, scale, synthetic
from .testbed import ordered_events, std_events

QUERIES, ORACLES = events.Q | scale.QUERIES | rawlogs.QUERIES, events.O | scale.ORACLES | rawlogs.ORACLES


def warehouse_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table of a stored run, read back."""
    ordered, folder = ordered_events(spark, sf_dir), new_folder(spark)
    sessions = facts.session_facts(ordered)
    tables = {"standard_events": ordered, "session_facts": sessions, "user_journeys": facts.user_journeys(ordered)}
    summary = metrics.run_summary(ordered, sessions).first().asDict()
    warehouse.store_run(spark, folder, "run", tables, summary, ["events"])
    counted = [warehouse.read_run(spark, folder, "run", t).agg(F.lit(t).alias("table_name"), F.count("*").alias("row_count")) for t in tables]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


def summary_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a stored summary matches one worked out from the stored rows."""
    ordered, folder = ordered_events(spark, sf_dir), new_folder(spark)
    sessions = facts.session_facts(ordered)
    summary = metrics.run_summary(ordered, sessions).first().asDict()
    warehouse.store_run(spark, folder, "run", {"standard_events": ordered, "session_facts": sessions}, summary, ["events"])
    stored = warehouse.snapshot(spark, folder, "run")
    found, figures = stored["summary_validation"], stored["sql_summary"]
    return spark.createDataFrame([(found["status"], len(found["differences"]), figures["events"], figures["sessions"], figures["revenue"])],
                                 "status string, differences long, events long, sessions long, revenue double")


def run_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored run as its snapshot tells it, after it was replaced once."""
    ordered, folder = ordered_events(spark, sf_dir), new_folder(spark)
    sessions = facts.session_facts(ordered)
    summary = metrics.run_summary(ordered, sessions).first().asDict()
    tables = {"standard_events": ordered, "session_facts": sessions, "daily_summaries": metrics.daily_summary(ordered, sessions),
              "raw_files": warehouse.raw_files(spark, [{"source_file": "events", "source_sheet": None, "rows": summary["events"], "columns": ordered.columns}]),
              "run_artifacts": warehouse.artifacts(spark, {"summary": summary, "alerts": []})}
    warehouse.store_run(spark, folder, "run", {t: df.limit(0) for t, df in tables.items()}, {}, ["events"])
    warehouse.store_run(spark, folder, "run", tables, summary, ["events"])
    told = warehouse.snapshot(spark, folder, "run")
    rows = [("table", t, float(n)) for t, n in told["table_counts"].items() if n] + [("day", d["date"], d["revenue"]) for d in told["summary_by_date"]["dates"]]
    rows += [("file", f["source_file"], float(f["row_count"])) for f in told["source_files"]] + [("artifact", a, 0.0) for a in told["artifact_types"]]
    rows += [("status", told["status"], float(told["commit"])), ("validation", told["summary_validation"]["status"], 0.0)]
    return spark.createDataFrame(rows, "part string, name string, figure double")


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as CSV and read back as text, counted by type."""
    folder = new_folder(spark)
    std_events(spark, sf_dir).select("uid", "event_raw", "event_type", "amount").coalesce(2).write.csv(folder, header=True)
    back = reduce(DataFrame.unionByName, files.ingest(spark, [folder]))
    return back.groupBy("event_type").agg(F.count("*").alias("events"), F.round(F.sum(F.col("amount").cast("double")), 2).alias("amount"))


def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested JSON lines read as dotted columns, counted by one of them."""
    folder = new_folder(spark)
    parsed = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.from_json("props", "k long").alias("props"))
    parsed.select(F.to_json(F.struct("event_id", "props")).alias("value")).write.text(folder)
    rawlogs.renamed(spark, folder, ".txt", ".jsonl")
    flat = files.fields(spark, files.ingest(spark, [folder]), ["props.k"])
    return flat.groupBy(F.col("`props.k`").cast("long").alias("k")).agg(F.count("*").alias("events"))


def normalized_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export of standard events, read back from its files."""
    folder = new_folder(spark)
    exports.write_events_csv(ordered_events(spark, sf_dir), folder)
    return spark.read.csv(folder, header=True).select("uid", F.col("user_event_index").cast("long").alias("user_event_index"), "session_id", "event_raw",
                                                      "event_type", F.col("group").alias("content_group"))


def synthetic_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A synthetic row in place of each event, counted by event name."""
    given = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"))
    log = synthetic.patterned(given, synthetic.users_for(given.count()))
    return log.groupBy("event_name").agg(F.count("*").alias("events"), F.count_distinct("uid").alias("users"),
                                         F.sum("amount").cast("long").alias("amount"), F.min("event_time").alias("first_time"), F.max("event_time").alias("last_time"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions that the streaming form finds, over the table."""
    found = session_stream(std_events(spark, sf_dir))
    return found.select("uid", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_count", "purchase_count", F.round("revenue", 4).alias("revenue"))


def customer_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue shares of customers, by their orders."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_custkey").cast("string").alias("uid"), F.col("o_totalprice").alias("amount"), F.lit("purchase").alias("event_type"))
    return metrics.revenue_concentration(orders)


for _query in (warehouse_roundtrip, summary_validation, run_snapshot, csv_roundtrip, json_flatten, normalized_export, synthetic_events, stream_sessions, customer_concentration):
    QUERIES[_query.__name__] = _query

W = events.WITH
ORACLES |= {
    "warehouse_roundtrip": W + """ SELECT 'standard_events' AS table_name, count(*) AS row_count FROM ev UNION ALL SELECT 'session_facts', count(*) FROM ses
UNION ALL SELECT 'user_journeys', count(DISTINCT uid) FROM ev""",
    "summary_validation": W + """ SELECT 'match' AS status, CAST(0 AS BIGINT) AS differences, count(*) AS events, (SELECT count(*) FROM ses) AS sessions,
  round(round(sum(amount), 6), 2) AS revenue FROM ev""",
    "run_snapshot": W + """, d AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, round(round(sum(amount), 6), 2) AS revenue FROM ev GROUP BY 1)
SELECT 'table' AS part, 'standard_events' AS name, count(*)::DOUBLE AS figure FROM ev UNION ALL SELECT 'table', 'session_facts', count(*) FROM ses
UNION ALL SELECT 'table', 'daily_summaries', count(*) FROM d UNION ALL SELECT 'table', 'raw_files', 1 UNION ALL SELECT 'table', 'run_artifacts', 2
UNION ALL SELECT 'day', date, revenue FROM d UNION ALL SELECT 'file', 'events', count(*) FROM ev UNION ALL SELECT 'artifact', 'alerts', 0 UNION ALL SELECT 'artifact', 'summary', 0
UNION ALL SELECT 'status', 'found', 2 UNION ALL SELECT 'validation', 'match', 0""",
    "csv_roundtrip": f"WITH {events.STD} SELECT event_type, count(*) AS events, round(sum(amount), 2) AS amount FROM std GROUP BY event_type",
    "json_flatten": "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS events FROM events GROUP BY 1",
    "normalized_export": W + " SELECT uid, ix AS user_event_index, session_id, event_raw, event_type, grp AS content_group FROM ev",
    "synthetic_events": "WITH p(i, event_name, amount) AS (VALUES " + ", ".join(f"({i}, '{p[0]}', {p[3]})" for i, p in enumerate(synthetic.PATTERNS)) + """),
u AS (SELECT least(greatest(count(*) // 12, 10), 50000) AS users FROM events),
r AS (SELECT event_id AS id, users, TIMESTAMP '2026-05-28 00:00:00' + INTERVAL 1 SECOND * ((event_id // users) * 7 + (event_id % users) % 5) AS t FROM events, u)
SELECT event_name, count(*) AS events, count(DISTINCT id % users) AS users, CAST(sum(amount) AS BIGINT) AS amount,
  strftime(min(t), '%Y-%m-%d %H:%M:%S') AS first_time, strftime(max(t), '%Y-%m-%d %H:%M:%S') AS last_time FROM r JOIN p ON p.i = r.id % 11 GROUP BY event_name""",
    "stream_sessions": f"""WITH {events.STD}, l AS (SELECT *, lag(ts) OVER (PARTITION BY uid ORDER BY ts, src) AS before FROM std),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR date_diff('second', before, ts) > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY uid ORDER BY ts, src) AS n FROM l)
SELECT uid, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS event_count, count(*) FILTER (WHERE event_type = 'purchase') AS purchase_count,
  round(coalesce(sum(amount) FILTER (WHERE event_type = 'purchase'), 0), 4) AS revenue FROM s GROUP BY uid, n""",
    "customer_concentration": """WITH p AS (SELECT CAST(o_custkey AS VARCHAR) AS uid, sum(o_totalprice) AS revenue,
  row_number() OVER (ORDER BY sum(o_totalprice) DESC, CAST(o_custkey AS VARCHAR)) AS place FROM orders GROUP BY o_custkey)
SELECT round(max(revenue) / sum(revenue), 4) AS top_1_user_share,
  round(sum(revenue) FILTER (WHERE place <= greatest(1, CAST(floor((SELECT count(*) FROM p) * 0.05) AS BIGINT))) / sum(revenue), 4) AS top_5pct_share FROM p""",
}
