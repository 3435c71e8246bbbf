"""Benchmark passages in documents, found by the q-gram lemma.

Texts are compared in lower case with runs of white space as one space. A
document is contaminated if it holds any ``PIECE`` characters in a row of an
item, wherever in the item they begin, or the whole of a shorter item, with no
more edits than the budget for that length.

Each item is laid out in overlapping pieces, which find whole items and long
parts of them. Items that no piece finds in a document are then searched in
windows at every place of the item: its q-grams are indexed once by their
place, and windows that share enough in a band of diagonals are verified.

By the q-gram lemma a piece of p characters and its occurrence with k edits
share at least p - q + 1 - k q of their q-grams, all on diagonals (place in the
document less place in the piece) no more than k apart. Shared q-grams are
counted in bands of diagonals that overlap by more than the largest budget,
bands that reach the piece's count are kept, and each is verified by
alignment within the band.

Work is bounded: shared q-grams are counted in stretches of a document that
overlap by the longest occurrence and are cut so that no more than ``POSTINGS``
pairs of places are held, and very long texts are searched in parts that
overlap likewise. The benchmark is dealt out in blocks of at most
``BLOCK_CHARS`` characters; an item longer than ``SEGMENT`` is laid out in
segments that overlap by a piece. One block's index at a time is built and
broadcast, and the documents are passed over once a block; they are never
shuffled.

Defined results: null and empty documents and items match nothing; an item of
fewer characters than a q-gram is found where it stands as whole words; items
with equal text are each reported; a document that holds an item several times
is reported once for it, at the best and then first place of a piece, or of a
window where no piece occurs; rows that repeat are each reported; other columns
pass through; an empty table, or an empty benchmark, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

Q = 8
#: Edits allowed for each character of a piece.
ERRORS = 0.1
PIECE, STRIDE = 96, 48
#: Width of a band of diagonals; every second band starts half a width later.
BAND = 32
#: Characters of benchmark in one index, and of an item in one row of it.
BLOCK_CHARS = 4_000_000
SEGMENT = STRIDE * 4096
#: Characters of documents worked on at a time, and pairs of equal q-grams.
CHUNK = 1 << 20
POSTINGS = 1 << 20
#: Regions aligned together.
ALIGN_AT_ONCE = 256
#: Windows that wait for it.
PUT_OFF = 1 << 14

_SLOT_BITS = 22
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(length: int) -> int:
    """Edits for a piece: by rate, and so that it must share a q-gram."""
    return min(int(ERRORS * length), (length - Q) // Q)


def _codes(text: str) -> np.ndarray:
    """A byte for each character; equal characters have equal bytes."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint8)


def _grams(codes: np.ndarray) -> np.ndarray:
    """The q-grams at all places, each as one number."""
    return np.ndarray(len(codes) - Q + 1, "<u8", np.ascontiguousarray(codes), strides=(1,)).astype(np.uint64)


@dataclass
class Index:
    items: list[int | None]  # of each piece
    pieces: list[str]
    needed: np.ndarray  # q-grams that a piece must share
    grams: np.ndarray  # sorted
    first: np.ndarray  # postings of gram i: first[i]:first[i + 1]
    piece: np.ndarray
    place: np.ndarray
    slots: np.ndarray  # whether any gram falls into a slot
    reach: int  # longest occurrence
    owners: list[int | None]  # items longer than a piece
    bodies: list[str]
    first_whole: np.ndarray  # postings of gram i in those
    owner: np.ndarray
    at_place: np.ndarray
    short: object  # finds items of fewer characters than a q-gram

    @classmethod
    def of(cls, rows: list[tuple[int | None, str | None]]) -> Index:
        items, pieces, owners, bodies = [], [], [], []
        short: dict[str, list[int | None]] = {}
        for item, text in rows:
            body = normal(text)
            if len(body) < Q:
                if body:
                    short.setdefault(body, []).append(item)
                continue
            if len(body) > PIECE:
                owners.append(item)
                bodies.append(body)
            starts = [0] if len(body) <= PIECE else [*range(0, len(body) - PIECE, STRIDE), len(body) - PIECE]
            for at in starts:
                items.append(item)
                pieces.append(body[at: at + PIECE])
        found = [_grams(_codes(p)) for p in pieces]
        grams = np.concatenate(found) if found else np.zeros(0, np.uint64)
        piece = np.repeat(np.arange(len(pieces)), [len(g) for g in found])
        place = np.concatenate([np.arange(len(g)) for g in found]) if found else np.zeros(0, np.int64)
        order = np.argsort(grams, kind="stable")
        keys, first = np.unique(grams[order], return_index=True)
        slots = np.zeros(1 << _SLOT_BITS, bool)
        slots[(keys * _SPREAD) >> np.uint64(64 - _SLOT_BITS)] = True
        whole = [_grams(_codes(b)) for b in bodies]
        # The pieces of an item have all of its q-grams.
        key = np.searchsorted(keys, np.concatenate(whole)) if whole else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(bodies)), [len(g) for g in whole])
        at_place = np.concatenate([np.arange(len(g)) for g in whole]) if whole else np.zeros(0, np.int64)
        by_key = np.argsort(key, kind="stable")
        needed = np.array([len(p) - Q + 1 - budget(len(p)) * Q for p in pieces], np.int64)
        return cls(items, pieces, needed, keys, np.append(first, len(grams)), piece[order], place[order], slots,
                   max((len(p) + budget(len(p)) for p in pieces), default=0), owners, bodies,
                   np.searchsorted(key[by_key], np.arange(len(keys) + 1)), owner[by_key], at_place[by_key], cls._words(short))

    @staticmethod
    def _words(short: dict[str, list[int | None]]) -> object:
        """An automaton for items that must stand as whole words."""
        if not short:
            return None
        found = ahocorasick.Automaton()
        for body, items in short.items():
            found.add_word(f" {body} ", (len(body), items))
        found.make_automaton()
        return found

    def shared(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, gram) of the q-grams that lie close enough to count."""
        if len(codes) < Q or not self.pieces:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        grams = _grams(codes)
        at = np.flatnonzero(self.slots[(grams * _SPREAD) >> np.uint64(64 - _SLOT_BITS)])
        which = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
        real = self.grams[which] == grams[at]
        at, which = at[real], which[real]
        # Places with too few shared q-grams within reach of them can't count.
        until = np.searchsorted(at, at + self.reach)
        dense = np.flatnonzero(until - np.arange(len(at)) >= self.needed.min())
        mark = np.zeros(len(at) + 1, np.int64)
        np.add.at(mark, dense, 1)
        np.add.at(mark, until[dense], -1)
        keep = np.cumsum(mark[:-1]) > 0
        return at[keep], which[keep]

    def stretches(self, at: np.ndarray, which: np.ndarray, whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in the document, piece, place in the piece) of equal q-grams,
        or the same for whole items, a bounded number at a time.

        Stretches of the document overlap by the longest occurrence, so every
        occurrence lies within one. One stretch that has more pairs yet is taken
        a range of pieces at a time.
        """
        first, piece, place = (self.first_whole, self.owner, self.at_place) if whole else (self.first, self.piece, self.place)
        low, high = first[which], first[which + 1]
        total = np.concatenate([[0], np.cumsum(high - low)])
        n, begin = len(self.bodies if whole else self.pieces), 0
        while begin < len(at):
            end = max(int(np.searchsorted(total, total[begin] + POSTINGS, "right")) - 1, int(np.searchsorted(at, at[begin] + 2 * self.reach)))
            parts = -(-int(total[end] - total[begin]) // POSTINGS)
            edges = np.linspace(0, n, max(min(parts, n), 1) + 1).astype(np.int64)
            a, b = low[begin:end], high[begin:end]
            for p, q in zip(edges[:-1], edges[1:], strict=True):
                # The postings of a gram lie in order of their pieces.
                c, d = (a, b) if len(edges) == 2 else (_within(piece, a, b, p), _within(piece, a, b, q))
                count = d - c
                post = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - c, count)
                if len(post):
                    yield np.repeat(at[begin:end], count), piece[post], place[post]
            if end >= len(at):
                break
            begin = int(np.searchsorted(at, at[end] - self.reach))

    def regions(self, at: np.ndarray, piece: np.ndarray, place: np.ndarray, wanted) -> np.ndarray:
        """(piece, first diagonal of the band) of bands that share enough, of
        those that are wanted."""
        diagonal = at - place + PIECE  # never negative
        bands = np.concatenate([diagonal // BAND * 2, (diagonal + BAND // 2) // BAND * 2 + 1])
        keys, shared = _counts(np.concatenate([piece, piece]), bands)
        keys = keys[shared >= self.needed[keys >> 40]]
        starts = _first_diagonal(keys) - PIECE
        keys = keys[[wanted(int(k) >> 40, s) for k, s in zip(keys.tolist(), starts.tolist(), strict=True)]] if len(keys) else keys
        keys = keys[self._narrow(keys, piece, place, diagonal)] if len(keys) else keys
        return np.stack([keys >> 40, _first_diagonal(keys) - PIECE], axis=1)

    def _narrow(self, keys: np.ndarray, piece: np.ndarray, place: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
        """Which bands also share enough where it must be: the q-grams of an
        occurrence lie on diagonals no further apart than its edits, and at
        different places of the piece."""
        keep = np.zeros(len(keys), bool)
        order = np.lexsort((diagonal, piece))
        piece, place, diagonal = piece[order], place[order], diagonal[order]
        first = np.searchsorted(piece, keys >> 40)
        last = np.searchsorted(piece, keys >> 40, "right")
        for i, (key, a, b) in enumerate(zip(keys.tolist(), first.tolist(), last.tolist(), strict=True)):
            own, band = key >> 40, key & ((1 << 40) - 1)
            low = band // 2 * BAND - band % 2 * (BAND // 2)
            a, b = a + np.searchsorted(diagonal[a:b], [low, low + BAND])
            own_edits, needed = budget(len(self.pieces[own])), int(self.needed[own])
            until = np.searchsorted(diagonal[a:b], diagonal[a:b] + own_edits, "right")
            dense = np.flatnonzero(until - np.arange(b - a) >= needed)
            keep[i] = any(len(np.unique(place[a + j: a + until[j]])) >= needed for j in dense.tolist())
        return keep

    def windows(self, at: np.ndarray, owner: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(owner, first diagonal of the band, windows of the item that share
        enough in it, by where they begin)."""
        needed, last = PIECE - Q + 1 - budget(PIECE) * Q, PIECE - Q
        longest = max(map(len, self.bodies), default=0)
        diagonal = at - place + longest  # never negative
        bands = np.concatenate([diagonal // BAND * 2, (diagonal + BAND // 2) // BAND * 2 + 1])
        owner, place = np.concatenate([owner, owner]), np.concatenate([place, place])
        keys, shared = _counts(owner, bands)
        keys = keys[shared >= needed]
        if not len(keys):
            return
        own = owner << 40 | bands
        which = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        keep = keys[which] == own
        # By key and place; a place counts once.
        both = np.unique(which[keep] * (longest + 1) + place[keep])
        key, place = np.divmod(both, longest + 1)
        ends = np.searchsorted(key, np.arange(len(keys)), "right")
        for k, start in enumerate((_first_diagonal(keys) - longest).tolist()):
            places = place[ends[k - 1] if k else 0: ends[k]]
            if len(places) < needed:
                continue
            low, high = places[: len(places) - needed + 1], places[needed - 1:]
            own = int(keys[k]) >> 40
            most = len(self.bodies[own]) - PIECE
            mark = np.zeros(most + 2, np.int64)
            begin, end = np.maximum(high - last, 0), np.minimum(low, most)
            real = begin <= end
            np.add.at(mark, begin[real], 1)
            np.add.at(mark, end[real] + 1, -1)
            starts = np.flatnonzero(np.cumsum(mark)[: most + 1] > 0)
            if len(starts):
                yield own, start, starts

    def search(self, text: str) -> dict[int | None, tuple[int, int, int]]:
        """``find`` for one text of any length, in parts that overlap."""
        over, hits = 4 * (self.reach + BAND + PIECE), {}
        for a in range(0, max(len(text) - over, 1), CHUNK):
            for item, (edits, start, end) in self.find([text[a: a + CHUNK + over]])[0].items():
                hit = (edits, start + a, end + a)
                hits[item] = min(hits.get(item, hit), hit)
        return hits

    def find(self, texts: list[str]) -> list[dict[int | None, tuple[int, int, int]]]:
        """For each normal text: item -> (edits, start, end)."""
        joined = "\0".join(texts)
        ends = np.cumsum([len(t) + 1 for t in texts])
        found: list[dict] = [{} for _ in texts]
        wanted: dict[int, list[tuple[int, int | None, int, str, str]]] = {}  # by length of the piece

        def put(row: int, item: int | None, at: int, best: tuple[int, int, int] | None) -> None:
            if best is not None:
                begin = int(ends[row]) - len(texts[row]) - 1
                hit = (best[0], best[1] + at - begin, best[2] + at - begin)
                found[row][item] = min(found[row].get(item, hit), hit)

        def look(item: int | None, body: str, start: int, rows: list[int] | None = None) -> None:
            """Search a band's occurrences of ``body``, or put that off."""
            edits = budget(len(body))
            low, high = max(start - edits, 0), start + BAND + len(body) + edits
            for row in near(low, high) if rows is None else rows:
                a, b = max(low, int(ends[row]) - len(texts[row]) - 1), min(high, int(ends[row]) - 1)
                if a >= b:
                    continue
                exact = joined.find(body, a, b)
                if exact >= 0:
                    put(row, item, a, (0, exact - a, exact - a + len(body)))
                else:
                    wanted.setdefault(len(body), []).append((row, item, a, body, joined[a:b]))

        def near(low: int, high: int) -> Iterator[int]:
            """The texts that lie between two places."""
            for row in range(int(np.searchsorted(ends, low, "right")), len(texts)):
                if int(ends[row]) - len(texts[row]) - 1 >= high:
                    break
                yield row

        def settle() -> None:
            for length, group in wanted.items():
                for k in range(0, len(group), ALIGN_AT_ONCE):
                    part = group[k: k + ALIGN_AT_ONCE]
                    best = align([g[3] for g in part], [g[4] for g in part], budget(length))
                    for (row, item, at, _, _), one in zip(part, best, strict=True):
                        put(row, item, at, one)
            wanted.clear()

        def open_band(piece: int, start: int) -> bool:
            """Whether a band may hold a better or earlier place."""
            edits = budget(len(self.pieces[piece]))
            low, high = max(start - edits, 0), start + BAND + len(self.pieces[piece]) + edits
            for row in near(low, high):
                hit = found[row].get(self.items[piece])
                if hit is None or hit[0] or hit[1] + int(ends[row]) - len(texts[row]) - 1 > low:
                    return True
            return False

        at, which = self.shared(_codes(joined))
        for stretch in self.stretches(at, which, whole=False):
            for piece, start in self.regions(*stretch, open_band).tolist():
                if open_band(piece, start):
                    look(self.items[piece], self.pieces[piece], start)
            settle()
        if self.short is not None:
            for row, text in enumerate(texts):
                for end, (size, items) in self.short.iter(f" {text} "):
                    for item in items:
                        hit = (0, end - size - 1, end - 1)
                        found[row][item] = min(found[row].get(item, hit), hit)
        held = [set(hits) for hits in found]
        n = len(self.owners)
        closed = np.array([row * n + o for row, items in enumerate(held) for o, item in enumerate(self.owners) if item in items] if any(held) else [], np.int64)
        for places, owner, place in self.stretches(at, which, whole=True):
            real = ~np.isin(np.searchsorted(ends, places, "right") * n + owner, closed)
            for own, start, begins in self.windows(places[real], owner[real], place[real]):
                item, body = self.owners[own], self.bodies[own]
                edits = budget(PIECE)
                reach = start + int(begins[0]) - edits, start + int(begins[-1]) + BAND + PIECE + edits
                rows = [row for row in near(max(reach[0], 0), reach[1]) if item not in held[row]]
                for begin in begins.tolist() if rows else ():
                    look(item, body[begin: begin + PIECE], start + begin, rows)
                    if sum(map(len, wanted.values())) >= PUT_OFF:
                        settle()
        settle()
        return found


def _first_diagonal(keys: np.ndarray) -> np.ndarray:
    """Where the band of a key begins."""
    band = keys & ((1 << 40) - 1)
    return band // 2 * BAND - band % 2 * (BAND // 2)


def _counts(owner: np.ndarray, bands: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys (owner, band), in order, and how often each occurs."""
    if not len(owner):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least, width = int(bands.min()), int(bands.max() - bands.min()) + 1
    base = int(owner.min())
    if (int(owner.max()) - base + 1) * width > 4 * len(owner):
        return np.unique(owner << 40 | bands, return_counts=True)
    count = np.bincount((owner - base) * width + bands - least)
    at = np.flatnonzero(count)
    return (at // width + base) << 40 | (at % width + least), count[at]


def _within(piece: np.ndarray, low: np.ndarray, high: np.ndarray, bound: int) -> np.ndarray:
    """For each range of ``piece``, which is in order, where ``bound`` begins."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) // 2
        less = open_ & (piece[np.minimum(middle, len(piece) - 1)] < bound)
        low = np.where(less, middle + 1, low)
        high = np.where(open_ & ~less, middle, high)
    return low


def align(pieces: list[str], regions: list[str], edits: int) -> list[tuple[int, int, int] | None]:
    """(edits, start, end) of the best occurrence of each piece in its region,
    if it has few enough; the pieces are of one length.

    Cell d of row i is the least number of edits that turn the first i
    characters of the piece into a stretch of the region that ends at i + d,
    less the budget; with it goes where that stretch begins.
    """
    length = len(pieces[0])
    p, size = np.stack([_wide(x) for x in pieces]), np.array([len(r) for r in regions])[:, None]
    width = max(int(size.max()) - length + 2 * edits + 1, 1)
    padded = np.full((len(pieces), length + width), -1, np.int64)
    for line, region in zip(padded, regions, strict=True):
        line[edits: edits + len(region)] = _wide(region)[: length + width - edits]
    # Cost and start in one number, so that a least cost carries its start.
    scale = 1 << 20
    places, never = np.arange(width), (length + int(size.max()) + 1) * scale
    begin = places - edits
    row = np.where((begin >= 0) & (begin <= size), begin, never)
    edge = np.full((len(pieces), 1), never)
    for i in range(length):
        same = row + np.where(padded[:, i: i + width] == p[:, i, None], 0, scale)
        row = np.minimum(same, np.concatenate([row[:, 1:], edge], axis=1) + scale)
        row = np.minimum.accumulate(row - places * scale, axis=1) + places * scale
    end = places - edits + length
    row = np.where((end >= 0) & (end <= size), row, never)
    best = row.argmin(axis=1)
    cost, start = np.divmod(row[np.arange(len(row)), best], scale)
    return [(c, s, e) if c <= edits else None
            for c, s, e in zip(cost.tolist(), start.tolist(), end[best].tolist(), strict=True)]


def _wide(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


HIT = "struct<item_id:long,edits:int,start:long,end:long>"


def _laid_out(benchmark: DataFrame) -> DataFrame:
    """(item_id, body) in normal form, long items in segments."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(item, body[a: a + SEGMENT + PIECE]) for item, body in zip(
                batch.column(0).to_pylist(), map(normal, batch.column(1).to_pylist()), strict=True)
                    for a in range(0, max(len(body) - PIECE, 1), SEGMENT) if body]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.string())], ["item_id", "body"])

    return benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, "item_id long, body string")


def blocks(benchmark: DataFrame, most: int | None = None) -> list[DataFrame]:
    """The benchmark in parts of at most ``BLOCK_CHARS`` characters each.

    Rows are dealt out by where they lie, not by what they hold, so that equal
    or null ids are spread like others; if a part is too large yet, there are
    twice as many.
    """
    most = most or BLOCK_CHARS
    # A row's number is written with it, so that every pass deals it alike.
    laid = cut(_laid_out(benchmark).withColumn("row", F.monotonically_increasing_id()), "benchmark")
    n = 1
    while True:
        placed = laid.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n)))
        largest = placed.groupBy("block").agg(F.sum(F.length("body")).alias("n")).agg(F.max("n"), F.max("block")).first()
        if (largest[0] or 0) <= max(most, SEGMENT + PIECE):
            return [placed.where(F.col("block") == i).select("item_id", "body") for i in range(n)] if largest[0] else []
        n *= 2


def _finder(index: Broadcast):
    """A function from texts to the hits of one block's index."""
    @F.pandas_udf(f"array<{HIT}>")
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out: list[list[dict]] = []
            for group in _groups([normal(t) for t in batch]):
                long = len(group) == 1 and len(group[0]) > 2 * CHUNK
                for hits in [index.value.search(group[0])] if long else index.value.find(group):
                    ordered = sorted(hits.items(), key=lambda h: (h[0] is None, h[0] or 0))
                    out.append([{"item_id": i, "edits": e, "start": a, "end": b} for i, (e, a, b) in ordered])
            yield pd.Series(out, dtype=object)

    return each


def _index(block: DataFrame) -> Broadcast:
    """The index of one block, which has a bounded size."""
    return block.sparkSession.sparkContext.broadcast(Index.of([tuple(r) for r in block.toLocalIterator()]))


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", most: int | None = None) -> DataFrame:
    """A row for each document and item that it holds: all columns of ``docs``,
    and ``hit`` of (item_id, edits, start, end)."""
    docs, parts = docs.drop("hit"), blocks(benchmark, most)
    found = None
    for part in parts:
        index = _index(part)
        one = docs.withColumn("hit", F.explode(_finder(index)(F.col(text))))
        if len(parts) > 1:
            one = cut(one, "leaks")
            index.destroy()
        found = one if found is None else found.unionByName(one)
    return docs.where("false").withColumn("hit", F.lit(None).cast(HIT)) if found is None else found


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", most: int | None = None) -> DataFrame:
    """The documents that hold no item."""
    parts = blocks(benchmark, most)
    for part in parts:
        index = _index(part)
        docs = docs.where(F.size(_finder(index)(F.col(text))) == 0)
        if len(parts) > 1:
            docs = cut(docs, "without-leaks")
            index.destroy()
    return docs


def _groups(texts: list[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for text in texts:
        if group and len(text) > CHUNK:  # a long text is worked on alone
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
        if size >= CHUNK:
            yield group
            group, size = [], 0
    if group:
        yield group


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "hit.*")


QUERIES = {"op5_decontamination": op5_decontamination}
ORACLES: dict = {}
