"""Standard events out of the driver's ``events`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sessions import sessionize


def std_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    kind, quarter = F.col("event_type"), F.col("k") % 4
    no_text = F.lit(None).cast("string")
    sold = kind.isin("view", "purchase")
    group = F.when(sold, "shop").when(kind != "signup", F.concat(F.lit("mode_"), (F.col("k") % 5).cast("string")))
    product = F.when(sold, F.concat(F.lit("p"), (F.col("k") % 7).cast("string")))
    standard = (
        F.when(kind == "signup", F.when(quarter == 0, "reward_claim").otherwise("session_start"))
        .when(kind == "view", "product_view").when(kind == "purchase", "purchase")
        .when(kind == "click", F.when(quarter == 0, "content_success").otherwise("content_enter"))
        .otherwise(F.when(quarter == 1, "match_issue").otherwise("content_fail")))
    paid = lambda when: F.when(when, F.col("value")).otherwise(0.0)
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", k).select(
        F.col("event_id").alias("src"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("uid"),
        F.col("ts").cast("timestamp_ntz").alias("ts"), F.concat_ws("_", kind, quarter.cast("string")).alias("event_raw"),
        F.concat_ws(" ", kind, quarter.cast("string")).alias("event_label"), standard.alias("event_type"), group.alias("group"),
        group.alias("content_id"), group.alias("content_label"), no_text.alias("content_type"), product.alias("product_id"),
        product.alias("product_label"), no_text.alias("product_category"), paid(kind == "purchase").alias("amount"),
        paid(kind == "click").alias("duration_sec"), paid((kind == "error") & (quarter == 1)).alias("wait_time_sec"),
        no_text.alias("result"), F.lit("events").alias("source_file"),
        F.when(F.col("k") % 3 == 0, "inferred").otherwise("dictionary").alias("language_source"))


def ordered_events(spark: SparkSession, sf_dir: str, gap_minutes: int = 30) -> DataFrame:
    return sessionize(std_events(spark, sf_dir), gap_minutes)


STD = """
k AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
std AS (
  SELECT event_id AS src, 'u' || user_id AS uid, ts, event_type || '_' || (k % 4) AS event_raw,
    event_type || ' ' || (k % 4) AS event_label,
    CASE event_type
      WHEN 'signup' THEN CASE WHEN k % 4 = 0 THEN 'reward_claim' ELSE 'session_start' END
      WHEN 'view' THEN 'product_view' WHEN 'purchase' THEN 'purchase'
      WHEN 'click' THEN CASE WHEN k % 4 = 0 THEN 'content_success' ELSE 'content_enter' END
      ELSE CASE WHEN k % 4 = 1 THEN 'match_issue' ELSE 'content_fail' END END AS event_type,
    CASE WHEN event_type IN ('view', 'purchase') THEN 'shop' WHEN event_type <> 'signup' THEN 'mode_' || (k % 5) END AS grp,
    CASE WHEN event_type IN ('view', 'purchase') THEN 'p' || (k % 7) END AS product,
    CASE WHEN event_type = 'purchase' THEN value ELSE 0 END AS amount,
    CASE WHEN event_type = 'click' THEN value ELSE 0 END AS duration_sec,
    CASE WHEN event_type = 'error' AND k % 4 = 1 THEN value ELSE 0 END AS wait_time_sec,
    CASE WHEN k % 3 = 0 THEN 'inferred' ELSE 'dictionary' END AS language_source
  FROM k
)"""


def ordered_sql(gap_minutes: int = 30) -> str:
    return f"""{STD},
o AS (
  SELECT *, row_number() OVER w - 1 AS ix, lag(ts) OVER w AS before FROM std
  WINDOW w AS (PARTITION BY uid ORDER BY ts NULLS LAST, src)
), b AS (
  SELECT *, CASE WHEN before IS NULL OR ts IS NULL OR date_diff('second', before, ts) / 60.0 > {gap_minutes} THEN 1 ELSE 0 END AS opens FROM o
), ev AS (
  SELECT *, uid || '-' || session_index AS session_id FROM (
    SELECT *, CAST(sum(opens) OVER (PARTITION BY uid ORDER BY ix ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS session_index FROM b)
), ses AS (
  SELECT session_id, min(uid) AS uid, arg_min(ts, ix) AS start, arg_max(ts, ix) AS stop, count(*) AS event_count,
    arg_min(event_label, ix) AS first_event, arg_max(event_label, ix) AS last_event, arg_max(event_type, ix) AS last_event_type,
    count(*) FILTER (WHERE event_type = 'purchase') AS purchase_count,
    coalesce(sum(amount) FILTER (WHERE event_type = 'purchase'), 0) AS revenue,
    greatest(0, date_diff('second', arg_min(ts, ix), arg_max(ts, ix))) AS duration_sec
  FROM ev GROUP BY session_id
)"""
