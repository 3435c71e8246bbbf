"""SimHash near-duplicates found at anchor points of a covering code.

A fingerprint bit is set if it is set in over half of the hashes of a text's
shingles. Fingerprints are linked when few bits differ, and links are found
without comparing all pairs: the points of a covering code serve as anchors,
and two fingerprints that are close are both near a common anchor.

The codes are perfect: the Golay code on 23 bits, whose anchors cover
everything within 3, and the Hamming code on 15 bits, within 1. Take x and y
that differ in two bits, and z half way between them. z lies within the
covering radius of some anchor, so x and y lie within the radius plus one.
Each fingerprint is therefore replicated to every anchor within the covering
radius plus its half of the threshold; both halves together make up the
threshold, and that costs far fewer replicas than giving one side all of it.
On a product of blocks the half is shared: one block may use it.

``op2`` covers 61 of 64 bits by a product of three blocks, 16 replicas for
each different fingerprint and 2**35 anchors. ``near_groups``, for texts whose
shingles agree by 0.8 or more and whose fingerprints differ in many bits, takes
a fingerprint of eleven Golay blocks and looks in each block on its own.

Defined results: null, empty and blank texts have the fingerprint zero and are
linked like any other; repeated rows each get a row; a null doc_id takes no
part in naming a component, and a component of null ids alone is named null;
columns other than the id and the text are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .components import components

SEED = 42
#: Shingles whose bits are counted at a time.
COUNT_AT_ONCE = 1 << 16


def shingles(text: str | None, size: int) -> list[bytes]:
    """Shingles of the words of a text with A-Z in lower case."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(found) <= size:
        return [b" ".join(found)] if found else []
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    return [joined[s:e] for s, e in zip(starts[: len(found) - size + 1].tolist(), ends[size - 1:].tolist(), strict=True)]


def majority(hashes: np.ndarray) -> np.ndarray:
    """Bits (uint8, the lowest first) set in over half of 64-bit hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), COUNT_AT_ONCE):
        part = hashes[at: at + COUNT_AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8)
        # Counts in a byte hold for 255 rows; blocks of as many are summed first.
        bits = np.unpackbits(part, axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.int32) if len(bits) < 1024 else sum(
            (np.add.reduce(bits[i: i + 255], axis=0, dtype=np.uint8).astype(np.int64) for i in range(0, len(bits), 255)),
            np.zeros(64, np.int64))
    return (2 * counts > len(hashes)).astype(np.uint8)


def simhash(text: str | None, size: int) -> int:
    """64-bit fingerprint as a signed number."""
    found = shingles(text, size)
    if not found:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(x, SEED) for x in found], np.uint64)
    return int(np.packbits(majority(hashes), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, size: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [simhash(t, size) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "fp"])

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string")).mapInArrow(each, "doc_id long, fp long")


# --- covering codes ------------------------------------------------------------


class Code:
    """A perfect code on ``n`` bits with the covering radius ``radius``.

    ``near`` holds, for every syndrome, the patterns of up to ``radius`` plus
    one bit that lead from a point with that syndrome to an anchor.
    """

    def __init__(self, n: int, generator: int, radius: int) -> None:
        self.n, self.radius = n, radius
        self.checks = generator.bit_length() - 1
        powers = []
        for i in range(n):
            x = 1 << i
            for bit in range(n - 1, self.checks - 1, -1):
                if x >> bit & 1:
                    x ^= generator << (bit - self.checks)
            powers.append(x)
        self._powers = np.array(powers, np.int64)
        patterns = {0: [(0, 0, -1)]}
        for weight in range(1, radius + 2):
            patterns[weight] = [
                (p | 1 << i, s ^ powers[i], i) for p, s, last in patterns[weight - 1] for i in range(last + 1, n)]
        every = [(s, p, weight > radius) for weight, found in patterns.items() for p, s, _ in found]
        every.sort(key=lambda x: (x[0], x[2], x[1]))
        self.patterns = np.array([p for _, p, _ in every], np.int64)
        self.beyond = np.array([b for _, _, b in every], bool)
        self.starts = np.searchsorted(np.array([s for s, _, _ in every]), np.arange((1 << self.checks) + 1))

    def syndrome(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        for i in range(self.n):
            out ^= np.where(points >> i & 1, self._powers[i], 0)
        return out

    def anchors(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor, beyond): all anchors within the radius plus one."""
        at = self.syndrome(points)
        first, count = self.starts[at], self.starts[at + 1] - self.starts[at]
        row = np.repeat(np.arange(len(points)), count)
        which = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        return row, points[row] ^ self.patterns[which], self.beyond[which]


@lru_cache
def golay() -> Code:
    return Code(23, 0b101011100011, 3)


@lru_cache
def hamming() -> Code:
    return Code(15, 0b10011, 1)


def product_anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) over blocks of 23, 23 and 15 bits; one may be beyond."""
    values = prints.view(np.uint64)
    blocks, at = [], 0
    for code in (golay(), golay(), hamming()):
        part = (values >> np.uint64(at) & np.uint64((1 << code.n) - 1)).astype(np.int64)
        blocks.append((at, *code.anchors(part)))
        at += code.n
    home = np.zeros(len(prints), np.int64)
    for shift, row, anchor, beyond in blocks:
        home[row[~beyond]] |= anchor[~beyond] << shift
    rows, anchors = [np.arange(len(prints))], [home]
    for (shift, row, anchor, beyond), code in zip(blocks, (golay(), golay(), hamming()), strict=True):
        row, anchor = row[beyond], anchor[beyond]
        rows.append(row)
        anchors.append(home[row] & ~(np.int64((1 << code.n) - 1) << shift) | anchor << shift)
    return np.concatenate(rows), np.concatenate(anchors)


def replicas(prints: DataFrame) -> DataFrame:
    """(anchor, fp): every different fingerprint at every anchor near it."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            row, anchor = product_anchors(own)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(own[row])], ["anchor", "fp"])

    return prints.select("fp").mapInArrow(each, "anchor long, fp long")


#: Bits by which linked fingerprints may differ; the codes are laid out for it.
THRESHOLD = 2


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """(a, b): different fingerprints that differ in at most two bits.

    A fingerprint has no more than 2080 others within two bits, however many
    texts share them, so links grow with the fingerprints, not their square.
    """
    placed = cut(replicas(prints), "simhash-replicas")
    a = placed.select("anchor", F.col("fp").alias("a"))
    b = placed.select("anchor", F.col("fp").alias("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= THRESHOLD)
    return a.join(b, (a["anchor"] == b["anchor"]) & near).select("a", "b").distinct()


def link(df: DataFrame, size: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``df``."""
    own = cut(fingerprints(df, size, key, text), "simhash-fingerprints")
    named = own.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    groups = components(fingerprint_links(named))
    by_group = cut(named.join(groups, named["fp"] == groups["node"]).select("fp", "component", "first_id"), "simhash-groups")
    ids = by_group.groupBy("component").agg(F.min("first_id").alias("group_id"))
    linked = by_group.join(ids, "component").select("fp", "group_id")
    # A table of its own, so that the join below is dealt out on both sides and
    # a fingerprint that very many documents share can be split.
    final = cut(named.join(linked, "fp", "left").select(
        "fp", F.coalesce("group_id", "first_id").alias("component_id")), "simhash-components")
    return own.join(final, "fp").select("doc_id", "fp", "component_id")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = link(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op2_simhash_dedup": op2_simhash_dedup}
ORACLES: dict = {}
