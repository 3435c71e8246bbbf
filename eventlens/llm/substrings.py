"""Removal of repeated byte strings by bucket-pointer refinement of suffixes.

Of all suffixes only those at pivots are kept, one for each run of 50-byte
strings (see ``windows``): every 50-byte string holds the pivot that stands
for it, so no match is missed.

* Initial buckets: a suffix points at the bucket of the 25-byte gram at its
  pivot. Buckets have the same identifiers in all tasks, by the gram's hash.
* Refinement: a bucket is sorted by the bucket identifiers at other offsets of
  its suffixes, first that of the last gram under the run, which lies behind
  the pivot, then that of the first. Each pass splits the buckets that the
  pass before left, and its new bucket numbers are what the next one sorts
  within. Three grams cover a run, so suffixes that stay together hold the same
  strings; all but those of the first document go.
* Recursion: a bucket that split over several documents has matches that begin
  or end inside its runs. The first suffix of each part goes one level down,
  to its single strings; these start in the bucket they come from and are
  refined in the same way, by the bucket identifiers at their own offsets, 25
  bytes and the 25 after them. Those are the 50 of the contract.

Suffixes travel packed, many to a row. Before they do, each task settles what
it can among its own: of equal suffixes it sends on only those of its first
document, so a passage that a third of all documents share reaches its bucket
once per ``GATHER`` suffixes of input. A gram that is followed by very many
different things (a label, a signature) is seen by the tasks that meet it:
they send its suffixes straight to the single strings, which are dealt out by
their own identifiers, and only tell its bucket that they did.

Defined results: a null text is empty and keeps nothing; texts under 50 bytes
keep everything; rows that repeat a doc_id never remove from each other; a
null doc_id comes after all others; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .windows import Spans, covered, runs, scramble

WINDOW = 50
GRAM = 25
#: Bytes worked on at a time, and suffixes that a task gathers before it sends.
CHUNK = 1 << 18
GATHER = 1 << 18
#: Buckets for each shuffle partition, and bytes of text for a bucket at most.
BUCKETS = 4
BUCKET_BYTES = 1 << 24
#: Different suffixes of one gram in a gather from which they are split up, at
#: most and at least: the more gathers there are, the fewer, so that what they
#: leave of a gram is about what a task holds.
HOT, LEAST_HOT = 1 << 10, 4
#: Suffixes of a bucket that a task holds before it settles what it can.
HELD = 1 << 21
#: Bytes of text to a suffix, about.
BYTES_TO_SUFFIX = 20

_TOKENS = scramble(np.arange(1, 257, dtype=np.uint64))
#: Bucket identifiers travel as 48 bits.
_KEEP = np.uint64(16)
#: The document of a row that only says that its bucket was split elsewhere.
_NOBODY = (1 << 63) - 1


class Suffixes(NamedTuple):
    """Places in texts: the bucket they point at, and the bucket identifiers
    at the offsets by which it is refined, in the order of the passes."""

    bucket: np.ndarray
    behind: np.ndarray
    front: np.ndarray
    doc: np.ndarray
    print: np.ndarray
    start: np.ndarray
    count: np.ndarray

    def take(self, rows: np.ndarray) -> Suffixes:
        return Suffixes(*(x[rows] for x in self))


def _together(parts: list[Suffixes]) -> Suffixes:
    return Suffixes(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _planes(x: np.ndarray, size: int) -> bytes:
    """The low bytes of numbers, first bytes first, which compresses well."""
    return x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def _numbers(data: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(size, -1).T
    out = np.zeros((len(planes), 8), np.uint8)
    out[:, :size] = planes
    return out.view("<i8")[:, 0]


#: What a packed row holds: suffixes to compare, ones to remove, or ones to
#: compare as single strings.
OPEN, GONE, SPLIT = 0, 1, 2
PACKED = "bucket int, state int, keys binary, docs binary, prints binary, starts binary, counts binary"


def _pack(x: Suffixes, bucket: np.ndarray, state: int) -> pa.RecordBatch:
    """A row for each bucket."""
    order = np.lexsort((x.start, x.doc, bucket))
    x, bucket = x.take(order), bucket[order]
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    out: list[list] = [[], [], [], [], [], [], []]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        gaps = np.diff(x.doc[a:b], prepend=0)
        keys = (b"" if state == GONE else _planes(x.bucket[a:b], 6) if state == SPLIT
                else _planes(x.bucket[a:b], 6) + _planes(x.behind[a:b], 6) + _planes(x.front[a:b], 6))
        row = (int(bucket[a]), state, keys, _planes(gaps, 8), _planes(x.print[a:b], 8), _planes(x.start[a:b], 5), _planes(x.count[a:b], 4))
        for column, value in zip(out, row, strict=True):
            column.append(value)
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
                                      ["bucket", "state", "keys", "docs", "prints", "starts", "counts"])


def _unpack(row: dict) -> Suffixes:
    docs = np.cumsum(_numbers(row["docs"], 8))
    keys = [_numbers(row["keys"][i * 6 * len(docs): (i + 1) * 6 * len(docs)], 6) for i in range(len(row["keys"]) // (6 * len(docs)))]
    none = np.zeros(len(docs), np.int64)
    return Suffixes(*keys, *[none] * (3 - len(keys)), docs,
                    _numbers(row["prints"], 8), _numbers(row["starts"], 5), _numbers(row["counts"], 4))


def _opens(*keys: np.ndarray) -> np.ndarray:
    """Where, in sorted rows, a new group of equal keys begins."""
    opens = np.ones(len(keys[0]), bool)
    opens[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return opens


def _refine(x: Suffixes) -> tuple[Suffixes, np.ndarray]:
    """Sort the suffixes of each bucket by the bucket identifiers at their
    offsets; with the first document of each bucket that is left."""
    x = x.take(np.argsort(x.bucket, kind="stable"))
    pointer = np.cumsum(_opens(x.bucket))
    for at in ("behind", "front"):
        key = getattr(x, at)
        order = np.lexsort((key, pointer))
        x, key, pointer = x.take(order), key[order], pointer[order]
        # The new numbers are the pointers that the next pass sorts within.
        pointer = np.cumsum(_opens(pointer, key))
    x = x.take(np.lexsort((x.doc, pointer)))  # pointers are in order by now
    return x, x.doc[_opens(pointer)][pointer - 1] if len(pointer) else x.doc


def _spread(x: Suffixes, buckets: int) -> np.ndarray:
    """Where rows go that need not meet others: by document."""
    return (x.doc.astype(np.uint64) % np.uint64(buckets)).astype(np.int64)


def _send(parts: list[Suffixes], buckets: int, hot_from: int | None) -> Iterator[pa.RecordBatch]:
    """Rows for the shuffle, after what the task can settle itself."""
    if not parts:
        return
    x, first = _refine(_together(parts))
    later = x.doc > first
    if later.any():
        gone = x.take(later)
        yield _pack(gone, _spread(gone, buckets), GONE)
    rest = x.take(~later)
    if hot_from is not None:
        which = np.cumsum(_opens(rest.bucket)) - 1
        hot = (np.bincount(which) > hot_from)[which]
        if hot.any():
            split = rest.take(hot)
            yield _pack(split, _spread(split, buckets), SPLIT)
            rest = _together([rest.take(~hot), _mark(split)])
    yield _pack(rest, _dealt(rest, hot_from is not None) % buckets, OPEN)


def _dealt(x: Suffixes, descend: bool) -> np.ndarray:
    """What deals suffixes out: their bucket, for single strings told apart by
    the identifier of the string itself."""
    return x.bucket if descend else (x.bucket ^ (scramble(x.behind.astype(np.uint64)) >> _KEEP).astype(np.int64) ^ x.front)


FOUND = "doc long, print long, starts array<long>, counts array<int>, buckets array<long>"


def _found(x: Suffixes, mixed: bool) -> pa.RecordBatch:
    """A row for each document, with its places."""
    x = x.take(np.lexsort((x.start, x.print, x.doc)))
    at = np.flatnonzero(_opens(x.doc, x.print))
    ends = pa.array(np.append(at, len(x.doc)).astype(np.int32))

    def lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
        return pa.ListArray.from_arrays(ends, pa.array(values, kind))

    buckets = lists(x.bucket, pa.int64()) if mixed else pa.nulls(len(at), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays(
        [pa.array(x.doc[at]), pa.array(x.print[at]), lists(x.start, pa.int64()), lists(x.count, pa.int32()), buckets],
        ["doc", "print", "starts", "counts", "buckets"])


def _settle(parts: list[Suffixes], descend: bool) -> Iterator[pa.RecordBatch]:
    """What goes of one dealt bucket and, to descend, the parts of split ones."""
    if not parts:
        return
    x, first = _refine(_together(parts))
    real = x.count > 0
    later = (x.doc > first) & real
    if later.any():
        yield _found(x.take(later), mixed=False)
    if not descend:
        return
    rest = x.take(~later)
    opens = _opens(rest.bucket)
    at, which = np.flatnonzero(opens), np.cumsum(opens) - 1
    # Several first documents, or parts elsewhere, make several parts.
    split = (np.minimum.reduceat(rest.doc, at) < np.maximum.reduceat(rest.doc, at)) | (np.minimum.reduceat(rest.count, at) == 0)
    split = split[which] & (rest.count > 0)
    if split.any():
        yield _found(rest.take(split), mixed=True)


def _ease(parts: list[Suffixes], hot_from: int | None) -> tuple[list[pa.RecordBatch], Suffixes]:
    """What can be told of a large bucket before all of it has come, and what
    has to be kept: of each string its first document, and of grams with many
    strings only a mark, for these are told apart as single strings."""
    x, first = _refine(_together(parts))
    later = (x.doc > first) & (x.count > 0)
    out, rest = [_found(x.take(later), mixed=False)] if later.any() else [], x.take(~later)
    if hot_from is not None:
        which = np.cumsum(_opens(rest.bucket)) - 1
        hot = (np.bincount(which) > hot_from)[which]
        if hot.any():
            split = rest.take(hot & (rest.count > 0))
            out.append(_found(split, mixed=True))
            rest = _together([rest.take(~hot), _mark(split)])
    return out, rest


def _mark(split: Suffixes) -> Suffixes:
    """A row for each bucket of ``split`` that says it was split elsewhere."""
    told = split.take(np.flatnonzero(_opens(split.bucket)))
    none = np.zeros(len(told.doc), np.int64)
    return told._replace(doc=none + _NOBODY, print=none, start=none, count=none)


def _deal(packed: DataFrame, descend: bool, hot_from: int = HOT, held: int = HELD) -> DataFrame:
    """Bring the rows of each bucket together and settle them."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts, size, most = None, [], 0, held
        for batch in batches:
            for row in batch.to_pylist():
                if row["state"] != OPEN:
                    yield _found(_unpack(row), mixed=row["state"] == SPLIT)
                    continue
                if row["bucket"] != own:
                    yield from _settle(parts, descend)
                    own, parts, size, most = row["bucket"], [], 0, held
                parts.append(_unpack(row))
                size += len(parts[-1].doc)
                if size > most:
                    out, rest = _ease(parts, hot_from if descend else None)
                    yield from out
                    parts, size = [rest], len(rest.doc)
                    most = max(held, 2 * size)
        yield from _settle(parts, descend)

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(each, FOUND)


def _gathered(makers: Iterator[Suffixes], buckets: int, gather: int, hot_from: int | None = None) -> Iterator[pa.RecordBatch]:
    parts, size = [], 0
    for made in makers:
        parts.append(made)
        size += len(made.doc)
        if size >= gather:
            yield from _send(parts, buckets, hot_from)
            parts, size = [], 0
    yield from _send(parts, buckets, hot_from)


def _pieces(lengths: list[int]) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (text, from, to); long texts in pieces that overlap by 49."""
    group, size = [], 0
    for i, n in enumerate(lengths):
        for at in range(0, n - WINDOW + 1, CHUNK):
            end = min(n, at + CHUNK + WINDOW - 1)
            group.append((i, at, end))
            size += end - at
            if size >= CHUNK:
                yield group
                group, size = [], 0
    if group:
        yield group


def suffixes(docs: DataFrame, buckets: int, gather: int = GATHER, hot_from: int = HOT) -> DataFrame:
    """The packed suffixes at the pivots of all texts."""
    def makers(batches: Iterator[pa.RecordBatch]) -> Iterator[Suffixes]:
        for batch in batches:
            ids, prints = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            texts = [t or b"" for t in batch.column(2).to_pylist()]
            for group in _pieces(list(map(len, texts))):
                data = np.frombuffer(b"".join(texts[i][a:b] for i, a, b in group), np.uint8)
                bounds = np.cumsum([0, *(b - a for _, a, b in group)])
                got, grams = runs(_TOKENS[data], bounds, WINDOW, GRAM)
                piece = np.searchsorted(bounds, got.start, "right") - 1
                row = np.array([i for i, _, _ in group])[piece]
                start = got.start - bounds[piece] + np.array([a for _, a, _ in group])[piece]
                last = got.start + got.count + (WINDOW - 1 - GRAM)
                yield Suffixes(*((x >> _KEEP).astype(np.int64) for x in (got.pivot, grams[last], grams[got.start])),
                               ids[row], prints[row], start, got.count)

    return docs.select("doc", "print", "body").mapInArrow(lambda b: _gathered(makers(b), buckets, gather, hot_from), PACKED)


def single_strings(docs: DataFrame, wanted: DataFrame, buckets: int, gather: int = GATHER) -> DataFrame:
    """The packed 50-byte strings of the suffixes in split buckets."""
    listed = wanted.groupBy("doc", "print").agg(
        *[F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "counts", "buckets")])

    def makers(batches: Iterator[pa.RecordBatch]) -> Iterator[Suffixes]:
        for batch in batches:
            for row in batch.to_pylist():
                start, count, own = (np.array(row[c], np.int64) for c in ("starts", "counts", "buckets"))
                order = np.argsort(start, kind="stable")
                start, count, own = start[order], count[order], own[order]
                for a in range(0, len(start), 1 << 14):
                    yield _strings(row, start[a: a + (1 << 14)], count[a: a + (1 << 14)], own[a: a + (1 << 14)])

    joined = docs.join(listed, ["doc", "print"]).select("doc", "print", "body", "starts", "counts", "buckets")
    return joined.mapInArrow(lambda b: _gathered(makers(b), buckets, gather), PACKED)


def _strings(row: dict, start: np.ndarray, count: np.ndarray, own: np.ndarray) -> Suffixes:
    low, high = start[0], (start + count).max() + WINDOW - 1
    grams = (Spans(_TOKENS[np.frombuffer(row["body"][low:high], np.uint8)]).all(GRAM) >> _KEEP).astype(np.int64)
    # Every start of every run: a ramp from each run's first.
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - start, count)
    return Suffixes(np.repeat(own, count), grams[at - low + GRAM], grams[at - low], np.full(len(at), row["doc"]), np.full(len(at), row["print"]),
                    at, np.ones(len(at), np.int64))


def keyed(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, print, doc_id, body): null keys last.

    ``print`` tells rows apart that share a key; it is 0 if none do.
    """
    doc = F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1))
    repeats = df.select(doc.alias("doc")).groupBy("doc").count().where("count > 1").take(1)
    return df.select(
        doc.alias("doc"), (F.xxhash64(F.col(text)) if repeats else F.lit(0).cast("long")).alias("print"),
        F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("body"))


def repeated_strings(docs: DataFrame, gather: int = GATHER, hot_from: int | None = None, held: int = HELD) -> DataFrame:
    """(doc, print, starts, counts): strings that start in an earlier document."""
    size = docs.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    buckets = max(BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)
    hot_from = hot_from or min(HOT, max(LEAST_HOT, held * gather * BYTES_TO_SUFFIX // max(size, 1)))
    level = cut(_deal(suffixes(docs, buckets, gather, hot_from), True, hot_from, held), "suffix-runs")
    strings = cut(_deal(single_strings(docs, level.where("buckets is not null"), buckets, gather), False, hot_from, held), "suffix-strings")
    return level.where("buckets is null").unionByName(strings).select("doc", "print", "starts", "counts")


def remove_substrings(df: DataFrame, key: str = "doc_id", text: str = "text", gather: int = GATHER, hot_from: int | None = None,
                      held: int = HELD) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): removed byte ranges and the bytes kept."""
    docs = keyed(df, key, text)
    listed = repeated_strings(docs, gather, hot_from, held).groupBy("doc", "print").agg(
        *[F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "counts")])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        for batch in batches:
            sizes, spans, kept = [], [], []
            for row in batch.to_pylist():
                body = row["body"] or b""
                sizes.append(len(body))
                if row["starts"]:
                    gone = covered(np.array(row["starts"], np.int64), np.array(row["counts"], np.int64), WINDOW, len(body))
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                    spans.append([{"from": a, "to": b} for a, b in edge.reshape(-1, 2).tolist()])
                    kept.append(np.frombuffer(body, np.uint8)[~gone].tobytes())
                else:
                    spans.append([])
                    kept.append(body)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "spans", "kept"])

    return docs.join(listed, ["doc", "print"], "left").select("doc_id", "body", "starts", "counts").mapInArrow(
        each, "doc_id long, n_bytes long, spans array<struct<from:long,to:long>>, kept binary")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document, bytes removed, and a digest of what is kept."""
    done = remove_substrings(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["to"] - s["from"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, h, CAST(length(h) / 2 AS BIGINT) AS n FROM d),
q AS (  -- short pieces, of which single strings are cut faster
  SELECT doc_id, i, n, substr(h, CAST(2 * i + 1 AS BIGINT), 298) AS piece
  FROM (SELECT doc_id, h, n, unnest(range(0, n - 49, 100)) AS i FROM s WHERE n >= 50)
), g AS (
  SELECT doc_id, i + j AS i, substr(piece, CAST(2 * j + 1 AS BIGINT), 100) AS w
  FROM (SELECT doc_id, i, piece, unnest(range(0, least(100, n - 49 - i))) AS j FROM q)
), m AS (SELECT w, min(doc_id) AS first FROM g GROUP BY w HAVING min(doc_id) < max(doc_id)
), f AS (SELECT g.doc_id, g.i FROM g JOIN m USING (w) WHERE g.doc_id > m.first
), o AS (  -- runs of covered bytes
  SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
    SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS opens FROM f)
), r AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM o GROUP BY doc_id, run
), k AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM r
), p AS (
  SELECT k.doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS last,
    string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) AS kept
  FROM k JOIN s USING (doc_id) GROUP BY k.doc_id
)
SELECT s.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM s LEFT JOIN p USING (doc_id)
"""

QUERIES = {"op3_substring_dedup": op3_substring_dedup}
ORACLES = {"op3_substring_dedup": ORACLE}
