"""Mixing sources to target weights by systematic sampling.

Each source gets a target, its share of all words by weight, but no more than
``CAP`` times its own words; what is cut off goes to the others by weight.
Within a source every document is expected ``target / source words`` times.
The running sum of these expectations, plus one random offset per source,
crosses a whole number once for each copy the mix takes.

Documents of like size stand together in that order, so the words taken stay
near the target. The running sum is a rank times a constant, and the rank is
found in two steps: documents are dealt into slices (source, size class, hash
of the row), slices are counted and their counts summed, and rows are numbered
within their slice by size, key and hash of the whole row. A source with a third of all rows is spread over
all its slices; only slice counts meet in one task.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; repeated rows are numbered one after another and each may be
taken; of rows with equal size and key, null keys too, the order goes by the
hash of all their columns, so reruns agree on the rows however the table lies; a source without words has target 0 and rate 0; an empty table gives an
empty result. Other columns pass through; ones that carry the names of added
columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, word_count

#: Weights of the sources in code point order, repeating; null comes last.
WEIGHTS = (5, 2, 1)
#: No source is repeated more often than this.
CAP = 3
#: Slices of one size class; a parameter of the plan, not of the result's law.
SLICES = 256
#: Sources up to this many travel to every task; more are joined by shuffle.
BROADCAST_SOURCES = 10_000


def targets(sizes: DataFrame) -> DataFrame:
    """One row per source of (source, size): words, target, rate and offset."""
    by_place = Window.orderBy(F.col("source").asc_nulls_last())
    by_need = Window.orderBy("need", "place")
    everything = by_need.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(
        F.array(*[F.lit(w).cast("long") for w in WEIGHTS]), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    # In order of cap / weight the capped sources come first. Were all before
    # this one capped, `level` words per weight would be left for it.
    ranked = (
        sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
        .withColumn("place", F.row_number().over(by_place) - 1)
        .withColumn("weight", weight)
        .withColumn("need", F.col("source_size") * CAP / F.col("weight"))
        .withColumn("before", F.coalesce(F.sum(F.col("source_size") * CAP).over(
            by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
        .withColumn("weight_left", F.sum("weight").over(
            by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", (F.col("total") - F.col("before")) / F.col("weight_left"))
        # The first that isn't capped says what the rest are given.
        .withColumn("final", F.min(F.when(F.col("level") <= F.col("need"), F.struct("need", "place", "level"))).over(
            everything)["level"])
    )
    goal = F.when(F.col("need") <= F.col("final"), F.col("source_size") * F.lit(float(CAP))).otherwise(
        F.col("final") * F.col("weight"))
    bits = F.conv(F.substring(F.md5(F.concat(F.lit("offset:"), F.coalesce("source", F.lit("")))), 1, 4), 16, 10)
    return ranked.select(
        "source", "source_size", goal.cast("double").alias("target"),
        F.when(F.col("source_size") > 0, goal / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"),
        (bits.cast("double") / 65536).alias("offset"))


def size_class(size: Column) -> Column:
    """Sizes that share their four leading bits share a class."""
    length = F.length(F.bin(size)).cast("int")
    low = F.greatest(length - 4, F.lit(0))
    return length * 16 + F.call_function("shiftright", size, low).cast("int")


def row_hash(df: DataFrame, first: tuple[str, ...] = ()) -> Column:
    """A hash of the columns ``first`` of a row, and then one of all columns;
    what Spark can't hash counts as JSON."""
    plain = lambda kind: not any(x in kind for x in ("map<", "variant"))

    def of(names: list[tuple[str, str]]) -> Column:
        return F.lpad(F.hex(F.xxhash64(*[F.col(f"`{c}`") if plain(kind) else F.to_json(F.struct(F.col(f"`{c}`").alias("x"))) for c, kind in names])), 16, "0")

    named = [(c, kind) for c, kind in df.dtypes if c in first]
    return F.concat(of(named), of(df.dtypes)) if named else of(df.dtypes)


def mix(df: DataFrame, size: str = "size", source: str = "source", key: str = "doc_id", row: Column | None = None) -> DataFrame:
    """Add source_size, target and copies, the times the mix takes each row.

    ``row`` is a hash that tells rows of one key and size apart; without it
    the hash of all columns is taken.
    """
    own = row_hash(df) if row is None else row
    # Keys spread evenly; rows that have none are spread by what they hold.
    spread = F.conv(F.substring(F.coalesce(F.md5(F.col(key).cast("string").cast("binary")), own), 1, 4), 16, 10)
    df = df.drop("source_size", "target", "copies")
    goals = cut(targets(df.select(F.col(source).alias("source"), F.col(size).alias("size"))), "mix-targets")
    kept = df.withColumns({"__class": size_class(F.col(size)), "__slice": spread.cast("int") % SLICES, "__row": own})
    counts = kept.groupBy(
        F.col(source).alias("__of"), F.col("__class").alias("__at"), F.col("__slice").alias("__in")).count()
    ahead = Window.partitionBy("__of").orderBy("__at", "__in").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn(
        "__before", F.coalesce(F.sum("count").over(ahead), F.lit(0).cast("long"))).drop("count")
    within = Window.partitionBy(source, "__class", "__slice").orderBy(F.col(size), F.col(key).asc_nulls_first(), "__row")
    named = goals.select(F.col("source").alias("__source"), "source_size", "target",
                         F.col("rate").alias("__rate"), F.col("offset").alias("__offset"))
    if goals.count() <= BROADCAST_SOURCES:
        named = F.broadcast(named)
    # The place of a row in its slice needs no join; its slice's start does,
    # on the columns by which the rows already lie.
    rows = kept.withColumn("__place", F.row_number().over(within).cast("long"))
    same = F.col(source).eqNullSafe(F.col("__of")) & F.expr("__class = __at AND __slice = __in")
    placed = rows.join(starts, same).drop("__of", "__at", "__in")
    done = F.col("__before") + F.col("__place")
    copies = (F.floor(F.col("__offset") + F.col("__rate") * done)
              - F.floor(F.col("__offset") + F.col("__rate") * (done - 1)))
    return (
        placed.join(named, F.col(source).eqNullSafe(F.col("__source")))
        .withColumn("copies", F.least(copies.cast("long"), F.lit(CAP).cast("long")))
        .drop("__source", "__class", "__slice", "__row", "__before", "__place", "__rate", "__offset"))


def take(df: DataFrame, size: str = "size", source: str = "source", key: str = "doc_id", ties: tuple[str, ...] = ()) -> DataFrame:
    """The mix itself: each row as often as it is taken, with its own columns.

    ``ties`` are the columns that tell rows of one key and size apart before
    all others do, so that columns beyond them change nothing.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rows = df.select(own.alias("row"), *[F.col(c).alias(n) for c, n in ((size, "n"), (source, "origin"), (key, "id"))], row_hash(df, ties).alias("tie"))
    taken = mix(rows, "n", "origin", "id", F.col("tie")).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source's target and the words taken from it."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", word_count(F.col("text")).alias("size"))
    sized = cut(docs, "mix-sizes")
    return mix(sized).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(list_filter(
    regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source
), w AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s
), n AS (
  SELECT *, CAST(source_size * 3 AS DOUBLE) / weight AS need FROM w
), l AS (
  SELECT *, CAST((sum(source_size) OVER ()) - coalesce(sum(source_size * 3) OVER (
        ORDER BY need, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
      / (sum(weight) OVER (ORDER BY need, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level
  FROM n
), f AS (
  SELECT *, (SELECT level FROM l WHERE level <= need ORDER BY need, place LIMIT 1) AS final FROM l
), t AS (
  SELECT source, source_size,
    CASE WHEN need <= final THEN CAST(source_size AS DOUBLE) * 3 ELSE final * weight END AS target,
    CAST(CAST(concat('0x', substr(md5(concat('offset:', coalesce(source, ''))), 1, 4)) AS BIGINT) AS DOUBLE) / 65536 AS u
  FROM f
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t
), k AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, r.rate, r.u, row_number() OVER (
      PARTITION BY d.source ORDER BY
        length(bin(d.size)) * 16 + (d.size >> greatest(length(bin(d.size)) - 4, 0)),
        CAST(concat('0x', substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 4)) AS BIGINT) % 256,
        d.size, d.doc_id NULLS FIRST) AS pos
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target,
  CAST(least(floor(u + rate * pos) - floor(u + rate * (pos - 1)), 3) AS BIGINT) * size AS taken FROM k
"""

QUERIES = {"op9_mixing": op9_mixing}
ORACLES = {"op9_mixing": ORACLE}
