"""Groups of near-duplicate texts by wide SimHash fingerprints.

Two texts are linked if of their different five-word shingles 0.8 or more agree
(Jaccard similarity, by 64 bits of hash of each shingle). Fingerprints only find
the pairs to look at. Similar texts differ in about an eighth of their
fingerprint's bits, too many for the anchors of one code over all of it. The
fingerprint here has 253 bits, eleven blocks of the Golay code, and anchors are
laid in each block on its own: fingerprints that differ in two bits of a block,
half of it on either side, meet at an anchor of that block. Those that meet are
candidates if they differ in ``MOST_BITS`` of all bits.

Fingerprints go to their anchors packed, many to a row. At an anchor they are
compared in tiles. What is sent on are candidates that join two groups, fewer
than there are fingerprints however large a group of copies is, and for each
fingerprint the nearest one. The groups so found hold every candidate pair;
which of their pairs are links is then found by the shingles themselves:

* each text is first compared with its nearest one and others that have the
  same nearest, ``PART`` at a time, which links nearly all of a group of copies
  of one text at a cost in proportion to their number;
* texts of a group that are not linked with the greater part of it by then are
  compared with all others of the group, in pairs of parts. Pairs within what
  is linked already are not looked at again.

Texts with equal shingles are one from the start.

Defined results: see ``simhash``; texts without words are one group; where
rows repeat, one is kept; a null doc_id comes after all others; an empty table
gives an empty result; all columns of the kept rows are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .components import components
from .simhash import SEED, golay, majority, shingles
from .windows import scramble

SHINGLE = 5
BLOCKS = 11
#: Shingles of a pair that agree, of all that either has, for a link.
LEAST_ALIKE = 0.8
#: Of 253 bits; 38 are expected to differ at similarity 0.8, give or take 6.
MOST_BITS = 60
#: Texts of a group that are compared with as many others in one place.
PART = 256
#: Fingerprints a task places at a time, and the side of a tile of comparisons.
GATHER = 1 << 14
TILE = 1 << 11

PRINT = ["f0", "f1", "f2", "f3"]


def shingle_set(text: str | None) -> np.ndarray:
    """Hashes of the different shingles of a text."""
    digest = xxhash.xxh64_intdigest
    return np.array([digest(x, SEED) for x in set(shingles(text, SHINGLE))], np.uint64)


def wide_print(hashes: np.ndarray) -> np.ndarray:
    """Four words of 64 bits, by the hashes of a text's shingles."""
    if not len(hashes):
        return np.zeros(4, np.uint64)
    bits = np.concatenate([majority(scramble(hashes + np.uint64(i))) for i in range(4)])
    return np.packbits(bits, bitorder="little").view("<u8")


def wide_prints(docs: DataFrame) -> DataFrame:
    """(doc, print, own, f0..f3) of every row of (doc, print, text); own tells
    sets of shingles apart."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column(2).to_pylist()]
            prints = np.array([wide_print(x) for x in sets], np.uint64).reshape(-1, 4)
            own = np.array([np.add.reduce(scramble(x + np.uint64(4))) if len(x) else 0 for x in sets], np.uint64)
            words = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (own, *prints.T)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *words], ["doc", "print", "own", *PRINT])

    return docs.select("doc", "print", "text").mapInArrow(
        each, "doc long, print long, own long, f0 long, f1 long, f2 long, f3 long")


def block_anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor): each fingerprint at the anchors near it in any block."""
    bits = np.unpackbits(prints.view(np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")
    code, rows, anchors = golay(), [], []
    for block in range(BLOCKS):
        part = bits[:, block * code.n: (block + 1) * code.n].astype(np.int64) @ (1 << np.arange(code.n))
        row, anchor, _ = code.anchors(part)
        rows.append(row)
        anchors.append(anchor | block << code.n)
    return np.concatenate(rows), np.concatenate(anchors)


def _packed(prints: DataFrame) -> DataFrame:
    """(anchor, nodes, prints): fingerprints at each anchor, many to a row."""
    def send(nodes: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        row, anchor = block_anchors(own)
        order = np.argsort(anchor, kind="stable")
        row, anchor = row[order], anchor[order]
        at = np.flatnonzero(np.diff(anchor, prepend=-1))
        ends = np.append(at, len(anchor))
        return pa.RecordBatch.from_arrays([
            pa.array(anchor[at].astype(np.int32)),
            pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends * 8), pa.py_buffer(nodes[row].tobytes())]).cast(pa.binary()),
            pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends * 32), pa.py_buffer(own[row].tobytes())]).cast(pa.binary()),
        ], ["anchor", "nodes", "prints"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, GATHER):
                part = batch.slice(at, GATHER)
                columns = [c.to_numpy(zero_copy_only=False) for c in part.columns]
                yield send(columns[0], np.stack(columns[1:], axis=1).astype(np.int64).view(np.uint64))

    return prints.select("node", *PRINT).mapInArrow(each, "anchor int, nodes binary, prints binary")


def forest(nodes: np.ndarray, prints: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """Candidates among near fingerprints, as few as join the same groups; and
    (node, nearest node, bits) of those that have one."""
    group = list(range(len(nodes)))
    links = []
    bits, nearest = np.full(len(nodes), 1 << 14, np.int16), np.zeros(len(nodes), np.int64)

    def keep(at: int, far: np.ndarray, other: np.ndarray) -> None:
        mine = slice(at, at + len(far))
        better = far < bits[mine]
        nearest[mine][better] = other[better]
        bits[mine][better] = far[better]

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for a in range(0, len(nodes), TILE):
        for b in range(a, len(nodes), TILE):
            left, right = prints[a: a + TILE], prints[b: b + TILE]
            apart = np.zeros((len(left), len(right)), np.int16)
            for w in range(4):
                apart += np.bitwise_count(left[:, w, None] ^ right[None, :, w])
            if a == b:
                np.fill_diagonal(apart, 1 << 14)
            keep(a, apart.min(axis=1), b + apart.argmin(axis=1))
            keep(b, apart.min(axis=0), a + apart.argmin(axis=0))
            near = apart <= MOST_BITS
            if a == b:
                near = np.triu(near, 1)
            for i, j in zip(*np.nonzero(near), strict=True):
                x, y = root(a + int(i)), root(b + int(j))
                if x != y:
                    group[max(x, y)] = min(x, y)
                    links.append((int(nodes[a + i]), int(nodes[b + j])))
    has = np.flatnonzero(bits <= MOST_BITS)
    return links, list(zip(nodes[has].tolist(), nodes[nearest[has]].tolist(), bits[has].tolist(), strict=True))


def candidates(prints: DataFrame) -> DataFrame:
    """(a, b, bits) of nodes of (node, f0..f3): candidates, as few as join the
    same groups, without bits; and the nearest ones of each node at an anchor."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts = None, []

        def settle() -> Iterator[pa.RecordBatch]:
            nodes = np.frombuffer(b"".join(n for n, _ in parts), np.int64)
            if len(nodes) > 1:
                links, nearest = forest(nodes, np.frombuffer(b"".join(p for _, p in parts), np.uint64).reshape(-1, 4))
                found = [*((a, b, None) for a, b in links), *nearest]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int32()), strict=True)],
                                                     ["a", "b", "bits"])

        for batch in batches:
            for anchor, nodes, prints in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if anchor != own:
                    yield from settle()
                    own, parts = anchor, []
                parts.append((nodes, prints))
        yield from settle()

    dealt = _packed(prints).repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(each, "a long, b long, bits int")


def alike(nodes: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between sets that agree enough, as few as join the same groups."""
    sizes = np.array([len(x) for x in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.cumsum(sizes) - sizes
    group, links = np.arange(len(nodes)), []
    held = np.zeros(len(ids), bool)
    for i in range(len(nodes) - 1):
        if (group[i + 1:] == group[i]).all():
            continue
        mine = ids[starts[i]: starts[i] + sizes[i]]
        held[mine] = True
        both = np.add.reduceat(held[ids[starts[i + 1]:]], starts[i + 1:] - starts[i + 1], dtype=np.int64)
        held[mine] = False
        # Whole numbers, so that a pair at the very limit is linked.
        near = 100 * both >= round(100 * LEAST_ALIKE) * (sizes[i] + sizes[i + 1:] - both)
        for j in (np.flatnonzero(near) + i + 1).tolist():
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
                links.append((nodes[i], nodes[j]))
    return links


def _part(n: Column, seed: int) -> Column:
    """Which of ``n`` parts a node is in."""
    return F.pmod(F.xxhash64(F.lit(seed), "node"), n).cast("int")


def stars(found: DataFrame) -> DataFrame:
    """(node, group, left, right): each node with its nearest one, and with
    others that have the same."""
    nearest = found.where("bits is not null").groupBy(F.col("a").alias("node")).agg(F.min(F.struct("bits", "b"))["b"].alias("group"))
    sizes = nearest.groupBy("group").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    arms = nearest.join(sizes, "group").select("node", "group", _part(F.col("parts"), SEED).alias("left"), F.lit(0).alias("right"))
    hubs = sizes.select(F.col("group").alias("node"), "group", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("left"), F.lit(0).alias("right"))
    return arms.unionByName(hubs)


def rest(loose: DataFrame, linked: DataFrame) -> DataFrame:
    """(node, group, left, right): the pairs of parts of groups of (node,
    component) that may hold more links, given those of ``linked``.

    Of each group what is linked most is its bulk. Nodes beside it, in parts
    0 to ``l`` - 1, meet one another and all parts of the bulk, ``l`` to
    ``l`` + ``k`` - 1; the bulk's own pairs are left out.
    """
    named = loose.join(linked.withColumnRenamed("component", "own"), "node", "left").select(
        "node", F.col("component").alias("group"), F.coalesce("own", "node").alias("own"))
    sizes = named.groupBy("group", "own").agg(F.count("*").alias("n"))
    bulk = sizes.groupBy("group").agg(F.max(F.struct("n", "own")).alias("bulk"), (F.sum("n") - F.max("n")).alias("beside")).where("beside > 0")
    parts = bulk.select("group", F.col("bulk.own").alias("bulk"), F.ceil(F.col("bulk.n") / PART).cast("int").alias("k"),
                        F.ceil(F.col("beside") / PART).cast("int").alias("l"))
    placed = named.join(parts, "group")
    inside = F.col("own") == F.col("bulk")
    at = F.when(inside, F.col("l") + _part(F.col("k"), SEED)).otherwise(_part(F.col("l"), SEED))
    met = F.when(inside, F.sequence(F.lit(0), F.col("l") - 1)).otherwise(F.sequence(F.lit(0), F.col("l") + F.col("k") - 1))
    return placed.select("node", "group", at.alias("at"), F.explode(met).alias("other")).select(
        "node", "group", F.least("at", "other").alias("left"), F.greatest("at", "other").alias("right"))


def near_links(texts: DataFrame, placed: DataFrame) -> DataFrame:
    """(a, b): linked nodes of (node, text), of those in one place of (node,
    group, left, right)."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, nodes, sets = None, [], []

        def settle() -> Iterator[pa.RecordBatch]:
            found = alike(nodes, sets) if len(nodes) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

        for batch in batches:
            for group, left, right, node, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (group, left, right) != own:
                    yield from settle()
                    own, nodes, sets = (group, left, right), [], []
                found = shingle_set(text)
                if len(found):  # a text without words is like no other
                    nodes.append(node)
                    sets.append(found)
        yield from settle()

    place = ["group", "left", "right"]
    dealt = placed.join(texts, "node").select(*place, "node", "text").repartition(*place).sortWithinPartitions(*place)
    return dealt.mapInArrow(each, "a long, b long")


def groups(texts: DataFrame, found: DataFrame, loose: DataFrame) -> DataFrame:
    """(node, component) of linked nodes, of those in one loose group."""
    first = cut(near_links(texts, stars(found)), "near-first")
    linked = components(first)
    more = cut(near_links(texts, rest(loose, linked)), "near-more")
    if more.isEmpty():
        return linked
    return components(first.unionByName(more))


def keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """``df`` with __doc and __print, by which its rows are told apart."""
    return df.withColumns({"__doc": F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)),
                           "__print": F.xxhash64(F.col(text))})


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of every group of near-duplicates, the one with the least key."""
    rows = keyed(df, key, text)
    own = cut(wide_prints(rows.select(F.col("__doc").alias("doc"), F.col("__print").alias("print"),
                                      F.col(text).cast("string").alias("text"))), "near-prints")
    nodes = cut(own.groupBy("own", *PRINT).agg(F.min(F.struct("doc", "print")).alias("first")).withColumn(
        "node", F.xxhash64("own", *PRINT)), "near-nodes")
    found = cut(candidates(nodes), "near-candidates")
    loose = cut(components(found.where("bits is null").select("a", "b")), "near-loose")
    first = nodes.join(loose, "node", "left_semi").select("node", F.col("first.doc").alias("__doc"), F.col("first.print").alias("__print"))
    # Rows that repeat a text are one; they go no further than their task.
    texts = cut(rows.select("__doc", "__print", F.col(text).cast("string").alias("text")).join(first, ["__doc", "__print"]).groupBy("node").agg(
        F.first("text").alias("text")), "near-texts")
    named = nodes.select("node", "first").join(groups(texts, found, loose), "node", "left")
    kept = named.groupBy(F.coalesce("component", "node").alias("group")).agg(F.min("first").alias("first")).select(
        F.col("first.doc").alias("__doc"), F.col("first.print").alias("__print"))
    # Of rows that repeat a kept one, the least is kept, whatever their order.
    return rows.join(kept, ["__doc", "__print"]).withColumn("__place", F.row_number().over(
        Window.partitionBy("__doc", "__print").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])))).where("__place = 1").select(
        *[F.col(f"`{c}`") for c in df.columns])
