"""Placement of rows on shards by a permutation-filled lookup table.

Each shard prefers the slots of a prime-sized table in an order of its own,
``offset + j * skip``. The shards take turns, and each claims the first slot
on its list that is still free, until none is. All shards thus hold equal
shares of the table to within one slot, and when a shard joins or leaves
most slots keep their shard.

The table has ``SLOTS`` entries whatever the data, and is broadcast; a row's
slot comes from a digest of its key, and finding its shard is one lookup.

``lay_out`` writes rows by shard, each shard in a bounded number of files that
its rows are dealt to by all they hold, so that neither a key that very many
rows share nor a large shard is written by one task.

Defined results: a null key counts as an empty one and all such rows share a
shard; rows that repeat a key share a shard; a column named ``slot`` or
``shard`` is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: A prime, large against the number of shards.
SLOTS = 65_537
SHARDS = 64


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def lookup(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The number of the shard that owns each slot."""
    if not 0 < len(shards) <= slots:
        raise ValueError("there must be at least one shard and no more than slots")
    if len(set(shards)) < len(shards):
        raise ValueError("shard names repeat")
    step = [_number(s, "skip") % (slots - 1) + 1 for s in shards]
    at = [_number(s, "offset") % slots for s in shards]
    owner, left = [-1] * slots, slots
    while True:
        for shard in range(len(shards)):
            while owner[at[shard]] >= 0:
                at[shard] = (at[shard] + step[shard]) % slots
            owner[at[shard]] = shard
            left -= 1
            if not left:
                return owner


def names(count: int) -> list[str]:
    return [f"shard-{i}" for i in range(count)]


def place(df: DataFrame, key: str = "doc_id", shards: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """Add ``slot`` and ``shard`` to every row; nothing is shuffled."""
    owners = lookup(shards or names(SHARDS), slots)
    spark = df.sparkSession
    entries = spark.createDataFrame(list(enumerate(owners)), "slot int, shard int")
    slotted = df.drop("slot", "shard").withColumn(
        "slot", (F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % slots).cast("int"))
    return slotted.join(F.broadcast(entries), "slot").select(*[F.col(f"`{c}`") for c in slotted.columns], "shard")


def lay_out(df: DataFrame, path: str, key: str = "doc_id", shards: list[str] | None = None, files: int = 4) -> None:
    """Write the rows to a folder for each shard, in up to ``files`` files."""
    placed = place(df, key, shards).drop("slot")
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if c not in ("slot", "shard")]), F.lit(files))
    count = len(shards or names(SHARDS)) * files
    placed.repartition(count, "shard", part).write.partitionBy("shard").parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whole, with their slot and shard."""
    return place(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """The lookup table is written out by its rule."""
    owners = ",".join(map(str, lookup(names(SHARDS))))
    return f"""
WITH s AS (SELECT *, CAST(CAST(concat('0x', substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) % {SLOTS} AS INTEGER) AS slot FROM documents)
SELECT *, CAST(list_extract(string_split('{owners}', ','), slot + 1) AS INTEGER) AS shard FROM s
"""


QUERIES = {"op1_sharding": op1_sharding}
ORACLES = {"op1_sharding": _oracle()}
