"""Removal of repeated passages by compaction of a de Bruijn graph.

The edges of the graph are the windows of 50 words (k-mers) of all texts.
Edges that follow one another and share their least gram of words are taken
together from the start (a run, see ``windows``); equal runs of different
places are one run of the graph. The rest goes by joins:

* each run learns the document that has it first, and its neighbours;
* runs that are repeated and whose occurrences all have the same next and
  previous run form nonbranching paths, which are compacted to one: all its
  runs occur equally often, in the same documents;
* where runs of different content share a gram, a repeat begins or ends
  inside them; there, and only for the first occurrence of each, windows are
  compared one by one, and those that follow one another in both documents
  are one span;
* a span that an earlier document seems to have too, a path or such windows,
  carries the source coordinates of that document. The words there are read
  once for each different source span, and a span goes only if its own words
  are the same. Hashes thus find repeats, and words decide.

Defined results: a null or blank text has no words and nothing removed; a text
shorter than a window keeps everything; rows that repeat a doc_id never remove
from each other; a null doc_id comes after all others; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, discard, table
from .windows import covered, runs

WINDOW = 50
#: Words of the gram that stands for a window.
GRAM = 12
#: Words worked on at a time.
CHUNK = 1 << 18

RUN = "doc long, print long, start int, count int, gram long, run long, prior long, next long"
KEY = ["doc", "print"]


class _WordHashes(dict):
    """Hashes of words; forgets them when it holds very many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def split(text: bytes | None) -> list[bytes]:
    return (text or b"").split()


def pieces(lengths: list[int], chunk: int, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (text, from, to) of about ``chunk`` tokens.

    Long texts are cut into pieces that overlap by a window less one token,
    so that every window lies in exactly one piece.
    """
    group, size = [], 0
    for i, n in enumerate(lengths):
        at = 0
        while n - at >= window:
            end = min(n, at + chunk + window - 1)
            group.append((i, at, end))
            size += end - at
            at += end - at - window + 1
            if size >= chunk:
                yield group
                group, size = [], 0
            if end == n:
                break
    if group:
        yield group


#: Rows of a batch whose words are held at a time.
ROWS = 256


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts, so that few texts are taken apart at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def word_runs(docs: DataFrame) -> DataFrame:
    """The runs of all texts of (doc, print, text), with their neighbours."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in parts(batches):
            ids, prints, texts = (batch.column(i) for i in range(3))
            found = [split(t.as_py()) for t in texts]
            for group in pieces(list(map(len, found)), CHUNK, WINDOW):
                tokens = np.fromiter((known[w] for i, a, b in group for w in found[i][a:b]), np.uint64)
                bounds = np.cumsum([0, *(b - a for _, a, b in group)])
                got, _ = runs(tokens, bounds, WINDOW, GRAM)
                piece = np.searchsorted(bounds, got.start, "right") - 1
                row = np.array([i for i, _, _ in group])[piece]
                start = got.start - bounds[piece] + np.array([a for _, a, _ in group])[piece]
                own = got.content.view(np.int64)
                same = np.append(False, piece[1:] == piece[:-1])
                prior = pa.array(np.roll(own, 1), mask=~same)
                after = pa.array(np.roll(own, -1), mask=~np.append(same[1:], False))
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(row)), prints.take(pa.array(row)), pa.array(start.astype(np.int32)),
                    pa.array(got.count.astype(np.int32)), _signed(got.pivot), pa.array(own), prior, after,
                ], ["doc", "print", "start", "count", "gram", "run", "prior", "next"])

    return docs.select("doc", "print", "text").mapInArrow(each, RUN)


def classes(found: DataFrame) -> DataFrame:
    """Each different run once, if other documents have its gram.

    first and last are the least and greatest document with the run; prior
    and next are its neighbours where all its occurrences agree on them.
    """
    agreed = lambda c: F.when(
        (F.count(c) == F.count("*")) & (F.min(c) == F.max(c)), F.min(c))
    one = cut(found.groupBy("gram", "run").agg(
        F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("times"),
        F.min(F.struct("doc", "print", "start")).alias("source"), F.min("count").alias("count"),
        agreed("prior").alias("prior"), agreed("next").alias("next")), "passage-one")
    by_gram = one.groupBy("gram").agg(
        F.min("first").alias("gram_first"), F.max("last").alias("gram_last"), F.count("*").alias("kinds"))
    # Two tables, so that a gram that very many runs share can be split.
    shared = cut(by_gram.where("gram_first < gram_last").select("gram", (F.col("kinds") > 1).alias("mixed")), "passage-grams")
    known = cut(one.join(shared, "gram"), "passage-classes")
    discard(one)
    discard(shared)
    return known


def paths(repeated: DataFrame) -> DataFrame:
    """Nonbranching paths of repeated runs: (gram, run, source, windows).

    A run continues the one before it if every occurrence of either has the
    other beside it. All runs of a path then also stand side by side in its
    first document, where the path is read off: (gram, run) is its first run,
    ``source`` its place there and ``windows`` the number of all its windows.
    """
    along = Window.partitionBy("source.doc", "source.print").orderBy("source.start")
    heads = repeated.join(
        repeated.select(F.col("run").alias("prior"), F.col("next").alias("run"), F.lit(True).alias("joined")),
        ["prior", "run"], "left")
    return (
        heads.withColumn("path", F.sum(F.when(F.col("joined"), 0).otherwise(1)).over(along))
        .groupBy("source.doc", "source.print", "path")
        .agg(F.min_by(F.struct("gram", "run", "source"), "source.start").alias("head"), F.sum("count").cast("int").alias("windows"))
        .select("head.gram", "head.run", "head.source", "windows"))


def windows_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, id, doc, print, at) of every window in the wanted runs."""
    listed = wanted.groupBy(*KEY).agg(F.collect_set(F.struct("start", "count", "gram")).alias("runs"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .windows import Spans
        known = _WordHashes()
        for batch in parts(batches):
            for doc, mark, text, rows in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                found = split(text)
                spans = Spans(np.fromiter((known[w] for w in found), np.uint64, len(found)))
                start, count = (np.array([r[k] for r in rows], np.int64) for k in ("start", "count"))
                at = np.concatenate([np.arange(s, s + c) for s, c in zip(start, count, strict=True)])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(np.array([r["gram"] for r in rows], np.int64), count)),
                    _signed(spans.at(at, at + WINDOW)), pa.array([doc] * len(at), pa.int64()),
                    pa.array([mark] * len(at), pa.int64()), pa.array(at.astype(np.int32)),
                ], ["gram", "id", "doc", "print", "at"])

    return docs.join(listed, KEY).select("doc", "print", "text", "runs").mapInArrow(
        each, "gram long, id long, doc long, print long, at int")


def keyed(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, print, text): null keys last; rows of one key and text alike."""
    return df.select(
        F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)).alias("doc"),
        F.xxhash64(F.col(text)).alias("print"), F.col(text).cast("string").cast("binary").alias("text"),
        F.col(key).cast("long").alias("doc_id"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc, print, start, count, source): windows that an earlier document
    seems to have, and where; ``source`` is (doc, print, start)."""
    found = cut(word_runs(docs), "passage-runs")
    known = classes(found)
    # Small tables of their own, so that the joins below are dealt out on both
    # sides and a run or window that very many documents share can be split.
    compact = cut(paths(known.where("first < last")), "passage-paths")
    whole = found.join(compact, ["gram", "run"]).where("doc > source.doc").select(
        *KEY, "start", F.col("windows").alias("count"), "source")
    first = known.where("mixed").select("gram", "run", F.col("first").alias("doc"))
    edges = found.join(first, ["gram", "run", "doc"]).select(*KEY, "start", "count", "gram")
    single = cut(windows_of(docs, edges), "passage-windows")
    least = single.groupBy("gram", "id").agg(F.min(F.struct("doc", "print", F.col("at").alias("start"))).alias("source"), F.max("doc").alias("last"))
    shared = cut(least.where("source.doc < last").drop("last"), "passage-shared")
    parts = single.join(shared, ["gram", "id"]).where("doc > source.doc").select(*KEY, F.col("at").alias("start"), "source")
    return cut(whole.unionByName(joined_up(parts)), "passage-spans")


def joined_up(parts: DataFrame) -> DataFrame:
    """Windows that follow one another in a document and in its source as one
    span."""
    shift = F.col("start") - F.col("source.start")
    along = Window.partitionBy(*KEY).orderBy("source.doc", "source.print", shift, "start")
    same = [F.lag(c).over(along) == c for c in (F.col("source.doc"), F.col("source.print"), shift)]
    goes_on = same[0] & same[1] & same[2] & (F.lag("start").over(along) == F.col("start") - 1)
    opens = F.when(goes_on, 0).otherwise(1)
    numbered = parts.withColumn("opens", opens).withColumn("span", F.sum("opens").over(along))
    return numbered.groupBy(*KEY, "span").agg(
        F.min("start").alias("start"), F.count("*").cast("int").alias("count"), F.min("source").alias("source")).drop("span")


def source_words(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(source, count, words): the words at each different source span."""
    wanted = spans.select("source", "count").distinct().groupBy(F.col("source.doc").alias("doc"), F.col("source.print").alias("print")).agg(
        F.collect_list(F.struct(F.col("source.start").alias("start"), "count")).alias("spans"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            for doc, mark, text, rows in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                words = split(text)
                for at in range(0, len(rows), 1000):
                    part = rows[at: at + 1000]
                    out = [b" ".join(words[r["start"]: r["start"] + r["count"] + WINDOW - 1]) for r in part]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([doc] * len(part), pa.int64()), pa.array([mark] * len(part), pa.int64()),
                        pa.array([r["start"] for r in part], pa.int32()), pa.array([r["count"] for r in part], pa.int32()),
                        pa.array(out, pa.binary())], ["doc", "print", "start", "count", "words"])

    read = docs.join(wanted, KEY).select("doc", "print", "text", "spans").mapInArrow(
        each, "doc long, print long, start int, count int, words binary")
    return read.select(F.struct("doc", "print", "start").alias("source"), "count", "words")


def remove_passages(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, spans, kept): removed word ranges and the kept text."""
    docs = keyed(df, key, text)
    spans = repeated_spans(docs)
    # A table of its own, so that a source that very many spans have can be split.
    sources = cut(source_words(docs, spans), "passage-sources")
    listed = spans.join(sources, ["source", "count"]).groupBy(*KEY).agg(F.collect_list(F.struct("start", "count", "words")).alias("runs"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            out: list[tuple] = []
            for body, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = split(body)
                gone = np.zeros(len(words), bool)
                found = [r for r in found or () if b" ".join(words[r["start"]: r["start"] + r["count"] + WINDOW - 1]) == r["words"]]
                if found:
                    gone = covered(np.array([r["start"] for r in found], np.int64),
                                   np.array([r["count"] for r in found], np.int64), WINDOW, len(words))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if found else b" ".join(words)
                out.append((len(words), [{"from": a, "to": b} for a, b in edge.reshape(-1, 2).tolist()], kept))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([o[0] for o in out], pa.int64()),
                pa.array([o[1] for o in out], pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))),
                pa.array([o[2] for o in out], pa.binary())], ["doc_id", "n_words", "spans", "kept"])

    return docs.join(listed, KEY, "left").select("doc_id", "text", "runs").mapInArrow(
        each, "doc_id long, n_words long, spans array<struct<from:long,to:long>>, kept binary",
    ).withColumn("kept", F.col("kept").cast("string"))


def op7_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document, words removed, and a digest of what is kept."""
    done = remove_passages(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["to"] - s["from"])
    return done.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"),
                       F.size("spans").cast("long").alias("n_spans"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS w
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)
), m AS (SELECT w, min(doc_id) AS first FROM g GROUP BY w HAVING min(doc_id) < max(doc_id)
), f AS (SELECT g.doc_id, g.i FROM g JOIN m USING (w) WHERE g.doc_id > m.first
), p AS (SELECT doc_id, i, ws[i] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)
), c AS (
  SELECT doc_id, i, word, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS opens
  FROM (SELECT p.doc_id, p.i, p.word, coalesce(max(f.i) OVER (
        PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) > 0 AS gone
      FROM p LEFT JOIN f ON p.doc_id = f.doc_id AND p.i = f.i)
), k AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans,
    coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept
  FROM c GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans
FROM d LEFT JOIN k USING (doc_id)
"""

QUERIES = {"op7_passage_dedup": op7_passage_dedup}
ORACLES = {"op7_passage_dedup": ORACLE}
