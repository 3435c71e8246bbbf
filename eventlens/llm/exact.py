"""Exact duplicates by a stateful stream over the files of a table.

The files are read as a stream, a bounded number of bytes at a time. The state
is keyed by the digest of a text, lies in RocksDB on the executors' disks, is
checkpointed to the shared folder, and never expires. For each digest it
retains the stable identifier and the content locator (file and row in it) of
the row that stays, and how many rows have come. Rows are combined before the
shuffle, so a text that a third of all rows share reaches the state as one
entry for each task.

A digest that came more than once is a hit, and hits are checked on full bytes:
each text is read once more and compared with the text at the locator. Equal
texts of one Arrow batch meet in a dictionary first, which compares them whole;
what is left of a group is one text for each batch. Texts of one digest that
differ are grouped by their bytes instead.

The state may be kept between calls: a later call streams new files only.

Defined results: a null text is the empty text; of equal texts the row with the
largest id stays, of rows with one id the last by file and row; null ids come
before all others, so one stays only where a group has no id; repeated rows each
get a row, one of which is kept; an empty table gives an empty result; columns
other than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir

#: Bytes of files that one step of the stream reads.
STEP_BYTES = 1 << 40
#: Megabytes of memory that all state stores of an executor share.
STATE_MB = 256

_STORE = "spark.sql.streaming.stateStore."
_SETTINGS = {
    _STORE + "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    _STORE + "rocksdb.changelogCheckpointing.enabled": "true",
    _STORE + "rocksdb.boundedMemoryUsage": "true",
    _STORE + "rocksdb.maxMemoryUsageMB": str(STATE_MB),
    _STORE + "rocksdb.writeBufferSizeMB": "8",
    # Else each store takes 4 MB of disk in advance, whatever it holds.
    _STORE + "rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _columns(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, file, row, text): a row, where it lies, and what it says."""
    place = df.metadataColumn("_metadata")
    return df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), place["file_path"].alias("file"), place["row_index"].alias("row"),
                     F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))


def _own() -> Column:
    """What names a row and says where its content is; the largest stays."""
    return F.struct("doc_id", "file", "row")


def _streamable(spark: SparkSession, path: str) -> str:
    """A stream's folder as it is; one file as a pattern that only it matches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return f"{path[:-1]}[{path[-1]}]"
    return path


def remember(spark: SparkSession, path: str, state: str, key: str, text: str, digest, step_bytes: int) -> DataFrame:
    """(digest, own, n): what the state retains after all files of ``path``.

    Runs the stream over files that ``state`` doesn't know. Each step writes
    the entries it changed under its own number, so a step that is run again
    after a failure replaces what it had written.
    """
    session = spark.newSession()
    for name, value in (_SETTINGS | {"spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions")}).items():
        session.conf.set(name, value)
    schema = spark.read.parquet(path).schema
    files = session.readStream.schema(schema).option("maxBytesPerTrigger", step_bytes).parquet(_streamable(spark, path))
    entries = _columns(files, key, text).select(digest(F.col("text")).alias("digest"), _own().alias("own"))
    retained = entries.groupBy("digest").agg(F.max("own").alias("own"), F.count("*").alias("n"))

    def changed(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state}/changed/step={number}")

    (retained.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{state}/stream")
     .foreachBatch(changed).start().awaitTermination())
    kinds = "digest binary, own struct<doc_id: long, file: string, row: long>, n long, step int"
    steps = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/changed")
    if not steps.getFileSystem(spark._jsc.hadoopConfiguration()).exists(steps):
        return spark.createDataFrame([], kinds).drop("step")
    # The last step that touched a digest has seen the most rows of it.
    return (spark.read.schema(kinds).parquet(f"{state}/changed").groupBy("digest")
            .agg(F.max_by(F.struct("own", "n"), "step").alias("last")).select("digest", "last.own", "last.n"))


def _distinct(rows: DataFrame) -> DataFrame:
    """Of rows with equal digest and bytes in one Arrow batch, the largest."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, files, places = (batch.column(i).to_pylist() for i in (1, 2, 3))
            best: dict = {}
            for i, found in enumerate(zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                own = (ids[i] is not None, ids[i] or 0, files[i], places[i], i)
                if found not in best or best[found] < own:
                    best[found] = own
            yield batch.take(pa.array([own[-1] for own in best.values()], pa.int64()))

    return rows.mapInArrow(each, rows.schema)


def _collided(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(digest): digests of hits whose texts aren't all equal.

    Joins on the digest with tables on both sides, so that Spark can split
    a digest that very many batches hold.
    """
    hits = groups.where("n > 1").select(F.col("digest").alias("hit"), F.col("own").alias("best"))
    texts = _distinct(rows.select("digest", "doc_id", "file", "row", F.col("text").cast("binary").alias("text")))
    checked = cut(texts.join(hits, F.col("digest") == F.col("hit")).select(
        "digest", "text", _own().eqNullSafe(F.col("best")).alias("stays")), "exact-hits")
    stay = checked.where("stays").select(F.col("digest").alias("of"), F.col("text").alias("retained"))
    return (checked.where("not stays").join(stay, F.col("digest") == F.col("of"))
            .where(F.col("text") != F.col("retained")).select("digest").distinct())


def deduplicate(spark: SparkSession, path: str, state: str | None = None, key: str = "doc_id", text: str = "text",
                digest=sha256, step_bytes: int = STEP_BYTES) -> DataFrame:
    """(doc_id, file, row, digest, keep_id, group_size, kept) of every row of
    the Parquet files in ``path``.

    ``state`` keeps what the stream knows for later calls with the same
    columns and digest; without it the state is of this call alone. The
    files must not change while a call runs.
    """
    state = state or f"{shared_dir(spark)}/eventlens/exact-{uuid.uuid4().hex}"
    groups = cut(remember(spark, path, state, key, text, digest, step_bytes), "exact-groups")
    rows = _columns(spark.read.parquet(path), key, text).withColumn("digest", digest(F.col("text")))
    collided = cut(_collided(rows, groups), "exact-collided")
    by_digest = rows.drop("text")
    if collided.isEmpty():
        whole = by_digest.join(groups.withColumnRenamed("digest", "of"), F.col("digest") == F.col("of"))
    else:
        # The digest isn't enough for these; their bytes group them.
        apart = rows.join(collided, "digest", "left_semi")
        exact = cut(apart.groupBy("text").agg(F.max(_own()).alias("own"), F.count("*").alias("n")), "exact-apart")
        clean = groups.join(collided, "digest", "left_anti").withColumnRenamed("digest", "of")
        whole = by_digest.join(clean, F.col("digest") == F.col("of")).unionByName(
            apart.join(exact.withColumnRenamed("text", "same"), F.col("text") == F.col("same")).drop("text", "same")
            .withColumn("of", F.col("digest")))
    return whole.select("doc_id", "file", "row", "digest", F.col("own.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
                        _own().eqNullSafe(F.col("own")).alias("kept"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of equal text that stays."""
    found = deduplicate(spark, f"{sf_dir}/documents.parquet")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

QUERIES = {"op13_exact_dedup": op13_exact_dedup}
ORACLES = {"op13_exact_dedup": ORACLE}
