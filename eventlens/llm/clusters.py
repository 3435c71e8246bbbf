"""Clusters of vectors by centroids, with Drake's adaptive bounds.

Lloyd's rounds, done exactly, with most distances left out. Each vector keeps
an upper bound of the distance to its own centroid, a lower bound for each of
the few other centroids nearest to it, in order, and one remainder bound below
the distances to all the rest. When centroids move, the bounds move with them.
Where the upper bound stays below every lower bound from some place on, only
the centroids before that place can be nearer, and just these are measured;
where it is below none, the vector is measured against all centroids. The
number of kept bounds adapts: it shrinks to the most that any vector needed in
a round, but not below an eighth of the centroids.

Components are whole numbers, so distances, sums and centroids are exact; the
bounds are floating-point numbers that are loosened by more than their error,
and a bound only certifies what is strictly farther, so ties are measured and
go to the smaller number.

Vectors and their bounds are one table, written anew in each round and read in
any number of tasks, without a shuffle; only counts and sums for each centroid
are brought together. Centroids are as many and as wide as the caller says;
they travel to every task.

Defined results: vectors that are null, have another number of components, or
hold a null or non-finite one aren't kept and give no row; repeated rows each
get a row; a null id seeds after all others; if fewer vectors than centroids are
kept, each is a centroid; an empty table gives an empty result; other columns
are ignored. A component beyond 2**27 in whole numbers is an error that says
so, since squared distances would pass 64 bits, and so is an inertia beyond 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, table

DIMENSIONS = 64
SCALE = 256
CENTROIDS = 40
ROUNDS = 5
SEED = 2
#: Magnitude of components whose squared distances fit 64 bits.
LARGEST = 1 << 27
#: Whole numbers up to this are exact in floating point.
EXACT = 1 << 53
#: More than the relative error of a root and of a few sums.
SLACK = 1e-9

STATE = ("vec_id long, v array<long>, cluster int, upper double, near array<int>, lower array<double>, rest double, used int")


class Moves(NamedTuple):
    """Centroids, and how far each has moved since the bounds were set."""

    centroids: np.ndarray
    moved: np.ndarray


def whole_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the kept vectors in whole numbers."""
    v = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = df.where(v.isNotNull() & (F.size(v) == dimensions) & F.coalesce(finite, F.lit(False)))

    def number(x: Column) -> Column:
        y = F.floor(x * float(scale))
        return F.when(F.abs(x * float(scale)) <= float(LARGEST), y).otherwise(
            F.raise_error(F.lit(f"a component is beyond {LARGEST} in whole numbers; its distances would pass 64 bits")))

    return kept.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.transform(v, number).cast("array<long>").alias("v"))


def first_centroids(vectors: DataFrame, count: int, seed: int) -> np.ndarray:
    """The vectors with the smallest hashes of their ids, in that order."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    found = vectors.select("v", order.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(count).collect()
    return np.array([r.v for r in found], np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all rows of ``c``."""
    largest = int(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * largest * largest <= EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        # One product of matrices; every part of the sum is a whole number.
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1)


def _ranked(far: np.ndarray, bounds: int) -> tuple[np.ndarray, ...]:
    """(cluster, upper, near, lower, rest) from exact squared distances."""
    order = np.argsort(far, axis=1, kind="stable")
    roots = np.sqrt(np.take_along_axis(far, order[:, : bounds + 2], 1).astype(np.float64))
    low = roots * (1 - SLACK)
    rest = low[:, bounds + 1] if far.shape[1] > bounds + 1 else np.full(len(far), np.inf)
    return order[:, 0], roots[:, 0] * (1 + SLACK), order[:, 1: bounds + 1], low[:, 1: bounds + 1], rest


def _in_doubt(upper: np.ndarray, lower: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """How many of the nearest others may be as near as the own centroid; one
    more than there are bounds if the remainder may hold such ones too."""
    floor = np.minimum.accumulate(np.column_stack([rest, lower[:, ::-1]]), axis=1)[:, ::-1]
    certain = upper[:, None] < floor
    return np.where(certain.any(1), certain.argmax(1), floor.shape[1])


def reassign(x: np.ndarray, own: np.ndarray, upper: np.ndarray, near: np.ndarray, lower: np.ndarray, rest: np.ndarray,
             moves: Moves, bounds: int) -> tuple[np.ndarray, ...]:
    """The state of a batch after centroids moved, with ``bounds`` bounds."""
    centroids, moved = moves
    # Bounds beyond the number still kept join the remainder.
    if near.shape[1] > bounds:
        rest = np.minimum(rest, lower[:, bounds:].min(1))
        near, lower = near[:, :bounds], lower[:, :bounds]
    upper = (upper + moved[own]) * (1 + SLACK)
    lower = np.maximum(lower - moved[near], 0) * (1 - SLACK)
    rest = np.maximum(rest - moved.max(), 0) * (1 - SLACK)
    own, near = own.copy(), near.copy()
    used = np.zeros(len(x), np.int32)
    # The true distance to the own centroid settles many of those in doubt.
    doubt = np.flatnonzero(_in_doubt(upper, lower, rest) > 0)
    exact = ((x[doubt] - centroids[own[doubt]]) ** 2).sum(1)
    upper[doubt] = np.sqrt(exact.astype(np.float64)) * (1 + SLACK)
    places = _in_doubt(upper[doubt], lower[doubt], rest[doubt])
    for n in np.unique(places[(places > 0) & (places <= near.shape[1])]).tolist():
        rows = doubt[places == n]
        among = np.column_stack([own[rows], near[rows, :n]])
        far = ((x[rows][:, None, :] - centroids[among]) ** 2).sum(2)
        order = np.lexsort((among, far), axis=1)
        among, far = np.take_along_axis(among, order, 1), np.take_along_axis(far, order, 1)
        roots = np.sqrt(far.astype(np.float64))
        own[rows], upper[rows] = among[:, 0], roots[:, 0] * (1 + SLACK)
        near[rows, :n], lower[rows, :n] = among[:, 1:], roots[:, 1:] * (1 - SLACK)
        used[rows] = n
    rows = doubt[places > near.shape[1]]
    if len(rows):
        own[rows], upper[rows], near[rows], lower[rows], rest[rows] = _ranked(squared(x[rows], centroids), near.shape[1])
        used[rows] = near.shape[1]
    return own, upper, near, lower, rest, used


def _table(batch: pa.RecordBatch, own, upper, near, lower, rest, used) -> pa.RecordBatch:
    def lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
        ends = np.arange(len(x) + 1) * x.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x.reshape(-1), kind))

    return pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(1), pa.array(own, pa.int32()), pa.array(upper, pa.float64()), lists(near, pa.int32()),
         lists(lower, pa.float64()), pa.array(rest, pa.float64()), pa.array(used, pa.int32())],
        ["vec_id", "v", "cluster", "upper", "near", "lower", "rest", "used"])


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, len(flat) // rows)


def _scan(vectors: DataFrame, centroids: np.ndarray, bounds: int) -> DataFrame:
    """The state of vectors that have none yet: all centroids are measured."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield _table(batch, *_ranked(squared(_matrix(batch.column(1), len(batch)), centroids), bounds), np.zeros(len(batch), np.int32))

    return vectors.mapInArrow(each, STATE)


def _rescan(state: DataFrame, moves: Moves, bounds: int) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if n := len(batch):
                own, upper, rest = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 6))
                yield _table(batch, *reassign(_matrix(batch.column(1), n), own, upper, _matrix(batch.column(4), n),
                                              _matrix(batch.column(5), n), rest, moves, bounds))

    return state.mapInArrow(each, STATE)


def _means(state: DataFrame, before: np.ndarray) -> tuple[np.ndarray, int]:
    """Centroids with every non-empty one replaced, and the most bounds used."""
    width = before.shape[1]
    sums = state.groupBy("cluster").agg(
        F.count("*").alias("n"), F.max("used").alias("used"), *[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(width)]).collect()
    after = before.copy()
    for row in sums:
        after[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(width)]
    return after, max(r["used"] for r in sums)


def cluster(vectors: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, v, cluster and bounds) after ``rounds`` rounds and a last
    assignment, and the final centroids. ``vectors`` is (vec_id, v)."""
    vectors = cut(vectors, "cluster-vectors")
    centroids = first_centroids(vectors, count, seed)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], STATE), centroids
    k = len(centroids)
    bounds = min(max(k // 4, 1), k - 1)
    state = cut(_scan(vectors, centroids, bounds), "cluster-state")
    discard(vectors)
    for done in range(rounds):
        after, used = _means(state, centroids)
        if done:
            bounds = min(bounds, max(used, k // 8, 1))
        moved = np.sqrt(((after - centroids) ** 2).sum(1).astype(np.float64)) * (1 + SLACK)
        centroids, last = after, state
        state = cut(_rescan(last, Moves(centroids, moved), bounds), "cluster-state")
        discard(last)
    return state, centroids


def assignments(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""
    spark = state.sparkSession
    rows = [(i, [int(x) for x in c]) for i, c in enumerate(centroids)]
    named = spark.createDataFrame(rows, "number int, centroid array<long>")
    far = F.aggregate(F.zip_with("v", "centroid", lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda a, b: a + b)
    # As many rows as centroids, which travelled to every task before.
    each = state.join(F.broadcast(named), F.col("cluster") == F.col("number")).select("vec_id", "cluster", far.alias("distance"))
    sums = cut(each.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")), "cluster-inertia").collect()
    whole = sum(r["s"] for r in sums)
    text = {i: ",".join(map(str, c)) for i, c in rows}
    totals = spark.createDataFrame([(r["cluster"], int(r["s"]), int(whole), text[r["cluster"]]) for r in sums],
                                   "of int, cluster_inertia long, inertia long, centroid string")
    return each.join(F.broadcast(totals), F.col("cluster") == F.col("of")).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.col("centroid").cast("binary"), 256).alias("centroid_sha256"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kept vector with its cluster."""
    return assignments(*cluster(whole_vectors(table(spark, sf_dir, "embeddings"))))


def _oracle() -> str:
    """Plain rounds: each vector is measured against all centroids."""
    far = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    nearest = ("SELECT vec_id, v, min_by(k, far * {n} + k) AS k, min(far) AS far FROM "
               "(SELECT row_id, vec_id, v, k, CAST({far} AS BIGINT) AS far FROM e, c{i}) GROUP BY row_id, vec_id, v")
    parts = [
        f"""WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS k, v AS c FROM (
    SELECT v, sha256('{SEED}:' || vec_id) AS h FROM e ORDER BY h LIMIT {CENTROIDS}))"""]
    for i in range(ROUNDS + 1):
        parts.append(f"a{i} AS MATERIALIZED ({nearest.format(far=far, i=i, n=CENTROIDS)})")
        if i < ROUNDS:
            parts.append(f"""m{i} AS (
  SELECT k, j, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x FROM (
    SELECT k, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (
      SELECT k, unnest(v) AS x, unnest(range({DIMENSIONS})) AS j FROM a{i}) GROUP BY k, j)
), c{i + 1} AS MATERIALIZED (
  SELECT c{i}.k, coalesce(n.c, c{i}.c) AS c FROM c{i} LEFT JOIN (SELECT k, list(x ORDER BY j) AS c FROM m{i} GROUP BY k) n ON n.k = c{i}.k)""")
    return ",\n".join(parts) + f"""
SELECT a.vec_id, CAST(a.k AS INTEGER) AS cluster, a.far AS distance, CAST(sum(a.far) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.far) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{ROUNDS}.c, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} ON a.k = c{ROUNDS}.k
"""


QUERIES = {"op11_centroid_clustering": op11_centroid_clustering}
ORACLES = {"op11_centroid_clustering": _oracle()}
