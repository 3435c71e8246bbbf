"""The corpus pipeline: from all documents to documents on shards.

Each stage reads what the one before it kept, as a table, and returns a table
with the columns of ``documents``; the last adds the shard. Documents that a
stage rejects are gone for the stages after it.

Defined results, for every stage: columns beyond those of ``documents`` pass
through, whatever their names; an empty table gives an empty one. Null, empty
and blank texts have no words, so the quality rules reject them; the stages
after them, on such rows: near-duplicates keep one row of all of them,
decontamination keeps them, mixing takes them as often as others of their
source (they add nothing to its words) and sharding places them. Rows that repeat: quality rules judge each, one is kept
of near-duplicates, decontamination judges each, mixing may take each, sharding
gives them one shard. A null doc_id comes after all others among
near-duplicates and counts as an empty key when placed; a null source is a
source of its own. Of near-duplicates the one with the least doc_id stays; of
rows equal in id and text the one with the least hash. Texts are whole,
whatever their length.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm import common, decontaminate, mixing, near, quality, sharding


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy of the corpus keeps."""
    return quality.kept(docs, quality.CORPUS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, with the least doc_id."""
    return near.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.without_leaks(docs, common.table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources; a document stands in it as often as it is taken."""
    sized = docs.withColumn("__size", common.word_count(F.col("text")))
    return mixing.take(sized, size="__size", ties=("doc_id", "text", "lang", "source", "n_chars")).select(*docs.columns)


def shard_placement(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its slot and shard."""
    return sharding.place(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("source mixing", source_mixing),
    ("sharding", shard_placement),
]


def run(spark: SparkSession, sf_dir: str, run_id: str | None = None) -> DataFrame:
    """All stages in order, each written as Parquet and read by the next.

    A stage's table is removed once the next one is written; the last one is
    what the result reads. A run with a ``run_id`` that was broken off goes on
    behind the last stage that it had written.
    """
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.shared_dir(spark)}/eventlens/pipeline-{run_id or uuid.uuid4().hex}"
    written = [i for i in range(len(STAGES) - 1) if common.exists(spark, f"{folder}/{i}/_SUCCESS")]
    if written:
        docs = spark.read.parquet(f"{folder}/{written[-1]}")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        if written and i <= written[-1]:
            continue
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        common.remove(spark, f"{folder}/{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SimHash groups and edit distances have no SQL; brute force tests stand in.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict = {}
