"""Queries whose forms hold for users, files and codes of any number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordering
from ..sources.scratch import new_folder
from ..streaming.bursts import burst_stream
from .testbed import STD, ordered_sql, std_events

QUERIES, ORACLES = {}, {}
#: Events to a slice of a stream's state.
SLICE_ROWS = 5000


def query(sql: str | None = None):
    """Register a query and its SQL under the query's name."""
    def add(build):
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build
    return add


#: One user who holds a third of all events.
HOT_SQL = ordered_sql().replace("'u' || user_id AS uid", "CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE 'u' || user_id END AS uid")


def with_hot_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return std_events(spark, sf_dir).withColumn("uid", F.when(F.col("src") % 3 == 0, "hot").otherwise(F.col("uid")))


@query(f"WITH {HOT_SQL} SELECT src, uid, ix AS user_event_index, session_index, session_id FROM ev")
def sessions_of_hot_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ordering.sessionize_in_ranges(with_hot_user(spark, sf_dir))
    return found.select("src", "uid", "user_event_index", "session_index", "session_id")


@query(f"WITH {STD} SELECT src, uid, CAST(row_number() OVER (ORDER BY uid, ts NULLS LAST, src) - 1 AS BIGINT) AS event_order FROM std")
def event_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.dense_order(std_events(spark, sf_dir), ordering.event_keys()).select("src", "uid", "event_order")


@query(f"""WITH {STD}, a AS (SELECT DISTINCT uid, event_type, ts FROM std)
SELECT a.uid, a.event_type AS code, strftime(a.ts, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS events, date_diff('microsecond', a.ts, max(b.ts)) / 1000000 AS span_seconds
FROM a JOIN std b ON b.uid = a.uid AND b.event_type = a.event_type AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 DAY GROUP BY a.uid, a.event_type, a.ts HAVING count(*) >= 3""")
def stream_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of repeats that a stream over the events' files tells, each once.

    Files come in any order, so the delay is as long as the table; an event
    after all others lets the stream tell the last windows.
    """
    folder = new_folder(spark, "bursts")
    rows = std_events(spark, sf_dir).select("uid", F.col("event_type").alias("code"), "ts")
    rows.write.parquet(f"{folder}/in")
    days = rows.agg(F.datediff(F.max("ts"), F.min("ts"))).first()[0] or 0
    beat = rows.agg((F.max("ts") + F.make_dt_interval(F.lit(days + 5))).alias("ts")).select(F.lit("").alias("uid"), F.lit("").alias("code"), "ts")
    beat.where("ts is not null").write.mode("append").parquet(f"{folder}/in")
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", "UTC")
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    slices = max(int(session.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SLICE_ROWS))
    found = burst_stream(session.readStream.schema(rows.schema).parquet(f"{folder}/in"), 86_400, 3, f"{days + 2} days", slices)
    (found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
     .start().awaitTermination())
    return spark.read.schema(found.schema).parquet(f"{folder}/out").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))
