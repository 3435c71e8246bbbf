"""Phrases whose words occur together more often than by chance.

Vertical positional inverted lists: texts of one language are laid out in
blocks, and a block holds, for each of its phrases, the sorted list of the
positions where it begins. The length of a list is the phrase's exact
frequency in the block; frequencies of blocks are added up by Spark. A list is
extended by a merge join on position with the postings of what begins one word
later, of which only those count whose own words are frequent, since no phrase
is more frequent than a part of it. A level has phrases of one word more than
the level before it and starts from the lists of frequent phrases alone.

Frequent phrases are numbered within their level, so a longer phrase is named
exactly by two numbers: that of all its words but the last and that of all but
the first. Most pairs of numbers are rare, and are ruled out before they are
counted one by one: the lengths of lists are first added up in hash buckets,
twice as many as there are words, which travel as some three bytes for each list. A
phrase in a bucket that doesn't reach the least frequency can't reach it
either. Of the others the numbers and counts travel, packed alike, and are added
up exactly, and the numbers of frequent phrases go back to the blocks that hold
them. Every
block is of bounded size, unless one text alone is larger; nothing that grows
with the input is broadcast or gathered.

Defined results: a null text has no words; a null language counts as ``und``,
together with texts of that name; every row counts, repeated ones too; of equal
scores the phrase that is more frequent comes first, then the one smaller by
UTF-8 bytes; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, discard, table
from .windows import scramble

#: Phrases have up to so many words, and occur so often at least.
LONGEST = 5
FREQUENT = 100
#: Phrases reported for each language.
REPORTED = 2000
#: Words that a task holds before it closes a block.
BLOCK_WORDS = 1_000_000
UNKNOWN = "und"

#: Between pieces; all ends of pieces become one character.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_ONE_END = bytes.maketrans(_ENDS, b"\n" * len(_ENDS))

#: Buckets of an input without words, and how buckets are dealt out: in so many
#: ranges, or in more where a range would have too many for one task.
LEAST_BITS, RANGES_BITS, RANGE_BITS = 20, 9, 24

# Position lists of a block, one after another, as differences in few bytes.
BLOCK = "block long, lang string, words array<string>, counts array<int>, positions binary"
LISTS = ("block long, counts array<int>, positions binary, "
         "packets array<struct<range: long, which: binary, heads: binary, tails: binary, counts: binary>>")
#: Of a range: what a block has of its frequent phrases, or, without a block, the phrases themselves.
COUNTED = "block long, which binary, numbers binary, heads binary, tails binary, f binary"
SURE = "block long, numbers array<long>, counts array<int>, positions binary, packets array<struct<range: long, offsets: binary, lengths: binary>>"
HEAVY = "block long, range long, offsets binary"


def packed(x: np.ndarray) -> bytes:
    """Whole numbers in 7 bits to a byte; the last byte of each is below 128."""
    x = x.astype(np.uint64)
    size = np.ones(len(x), np.int64)
    for bits in range(7, 64, 7):
        size += x >= np.uint64(1 << bits)
    out, starts = np.empty(size.sum(), np.uint8), np.cumsum(size) - size
    for k in range(int(size.max(initial=0))):
        some = np.flatnonzero(size > k)
        out[starts[some] + k] = (x[some] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8) | np.where(size[some] > k + 1, 128, 0).astype(np.uint8)
    return out.tobytes()


def unpacked(data: bytes | np.ndarray) -> np.ndarray:
    data = np.frombuffer(data, np.uint8) if isinstance(data, (bytes, bytearray, memoryview)) else data
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if len(ends) else ends
    out = np.zeros(len(ends), np.int64)
    for k in range(int((ends - starts).max(initial=-1)) + 1):
        some = np.flatnonzero(ends - starts >= k)
        out[some] |= (data[starts[some] + k] & np.uint8(127)).astype(np.int64) << (7 * k)
    return out


def steps(lists: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Ascending lists, one after another, as differences within each."""
    out = np.diff(lists, prepend=0)
    starts = (np.cumsum(counts) - counts)[counts > 0]
    out[starts] = lists[starts]
    return out


def summed(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What ``steps`` made differences of."""
    whole = np.cumsum(found)
    starts = (np.cumsum(counts) - counts)[counts > 0]
    return whole - np.repeat(whole[starts] - found[starts], counts[counts > 0])


class _Numbers(dict):
    """Numbers words as they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Open:
    """A block of one language that is being filled."""

    def __init__(self) -> None:
        self.numbers = _Numbers({b"": 0, b"\n": 1})
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> int:
        found = text.lower().translate(_ONE_END).replace(b"\n", b" \n ").replace(b"\t", b" ").split(b" ")
        found.append(b"\n")
        tokens = np.fromiter(map(self.numbers.__getitem__, found), np.int32, len(found))
        self.parts.append(tokens[tokens != 0])
        self.size += len(self.parts[-1])
        return len(self.parts[-1])

    def close(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(words, counts, positions): the position list of every word. The
        end of a piece takes a position, so words beside it aren't adjacent."""
        tokens = np.concatenate(self.parts)
        order = np.argsort(tokens, kind="stable").astype(np.int32)
        counts = np.bincount(tokens, minlength=len(self.numbers)).astype(np.int32)
        return list(self.numbers)[2:], counts[2:], order[counts[1]:]


def blocks(df: DataFrame, text: str = "text", lang: str = "lang", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Blocks of texts with the position lists of their words."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, made, held, held_words = TaskContext.get().partitionId() << 32, 0, {}, 0

        def closed(of: str) -> pa.RecordBatch:
            nonlocal made, held_words
            block = held.pop(of)
            held_words -= block.size
            words, counts, positions = block.close()
            made += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([first + made - 1]), pa.array([of]), pa.array([words], pa.list_(pa.binary())).cast(pa.list_(pa.string())),
                 pa.array([counts], pa.list_(pa.int32())), pa.array([packed(steps(positions, counts))], pa.binary())],
                ["block", "lang", "words", "counts", "positions"])

        for batch in batches:
            for of, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block = held.get(of)
                if block is None:
                    block = held[of] = _Open()
                held_words += block.add(content.as_py())
                while held_words >= block_words:
                    yield closed(max(held, key=lambda x: held[x].size))
        for of in list(held):
            yield closed(of)

    rows = df.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UNKNOWN)).alias("lang"),
                     F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(each, BLOCK)


def kept(counts: np.ndarray, positions: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, positions) of the lists at ``which``, in that order."""
    starts = np.cumsum(counts) - counts
    chosen = counts[which]
    at = np.arange(chosen.sum()) - np.repeat(np.cumsum(chosen) - chosen, chosen) + np.repeat(starts[which], chosen)
    return chosen, positions[at]


def adjacent(numbers: np.ndarray, counts: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, ...]:
    """(heads, tails, counts, positions) of phrases one word longer.

    Lists are merged by position: two occurrences one position apart are all
    words but the last and all but the first of a longer phrase.
    """
    owner = np.repeat(np.arange(len(numbers), dtype=np.int32), counts)
    order = np.argsort(positions, kind="stable")
    at, owner = positions[order], owner[order]
    meets = np.flatnonzero(at[1:] == at[:-1] + 1)
    pairs = owner[meets].astype(np.int64) * max(len(numbers), 1) + owner[meets + 1]
    order = np.argsort(pairs, kind="stable")
    pairs = pairs[order]
    starts = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
    head, tail = np.divmod(pairs[starts], max(len(numbers), 1))
    return numbers[head], numbers[tail], np.diff(np.append(starts, len(pairs))).astype(np.int32), at[meets[order]]


def buckets(heads: np.ndarray, tails: np.ndarray, bits: int) -> np.ndarray:
    mixed = scramble(heads.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ scramble(tails.astype(np.uint64)))
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def _lists(*columns: tuple[np.ndarray, pa.DataType]) -> list[pa.Array]:
    return [pa.array([x], pa.list_(kind)) for x, kind in columns]


def _arrays(batch: pa.RecordBatch, row: int, *columns: int) -> list[np.ndarray]:
    return [batch.column(k)[row].values.to_numpy(zero_copy_only=False) for k in columns]


def _binaries(parts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Bytes cut at ``ends``."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, ends).astype(np.int32).tobytes()), pa.py_buffer(parts.tobytes())])


def _grouped(x: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, counts) of equal ``keys`` that stand together."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(x)))


def _packed_lists(lists: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Each ascending list as packed differences; no list is empty."""
    data = np.frombuffer(packed(steps(lists, counts)), np.uint8)
    return _binaries(data, (np.flatnonzero(data < 128) + 1)[np.cumsum(counts) - 1] if len(counts) else counts)


def _packed_each(x: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Whole numbers as they are, ``counts`` to a row; no row is empty."""
    data = np.frombuffer(packed(x), np.uint8)
    return _binaries(data, (np.flatnonzero(data < 128) + 1)[np.cumsum(counts) - 1] if len(counts) else counts)


def _unpacked_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(lists, counts) of packed differences."""
    if not len(column):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[at[0]: at[-1]]
    counts = np.add.reduceat((data < 128).astype(np.int64), at[:-1] - at[0])
    return summed(unpacked(data), counts), counts


def sure(lists: DataFrame, frequent: DataFrame, bits: int, range_bits: int) -> DataFrame:
    """The lists of frequent phrases, from (block, which, numbers), and packets
    of the lengths of the lists that adjacent ones would make."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                (counts,) = _arrays(batch, i, 1)
                which, numbers = (np.concatenate([unpacked(x) for x in batch.column(k)[i].as_py()]) for k in (3, 4))
                own = kept(counts, summed(unpacked(batch.column(2)[i].as_py()), counts), which)
                heads, tails, found, _ = adjacent(numbers, *own)
                at = buckets(heads, tails, bits)
                order = np.argsort(at, kind="stable")
                at, found = at[order], found[order]
                starts, size = _grouped(at, at >> range_bits)
                lengths = np.minimum(found, 255).astype(np.uint8)
                packets = pa.StructArray.from_arrays(
                    [pa.array(at[starts] >> range_bits), _packed_lists(at & ((1 << range_bits) - 1), size), _binaries(lengths, np.cumsum(size))],
                    ["range", "offsets", "lengths"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), *_lists((numbers, pa.int64()), (own[0], pa.int32())), pa.array([packed(steps(own[1], own[0]))], pa.binary()),
                     pa.ListArray.from_arrays(pa.array([0, len(starts)], pa.int32()), packets)],
                    ["block", "numbers", "counts", "positions", "packets"])

    known = frequent.groupBy("block").agg(F.collect_list(F.struct("which", "numbers")).alias("known"))
    return lists.select("block", "counts", "positions").join(known, "block").select(
        "block", "counts", "positions", F.col("known.which").alias("which"), F.col("known.numbers").alias("numbers")).mapInArrow(each, SURE)


def heavy(packets: DataFrame, frequent: int) -> DataFrame:
    """(block, range, offsets): the buckets of each block that may hold a
    frequent phrase, from (block, range, offsets, lengths)."""
    # A list of 255 or more reaches any bound that is held against it.
    least = min(frequent, 255)

    def each(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        found, counts = _unpacked_lists(table.column("offsets").chunk(0))
        lengths = np.frombuffer(b"".join(table.column("lengths").to_pylist()), np.uint8)
        order = np.argsort(found, kind="stable")
        starts, size = _grouped(found, found[order])
        reached = np.zeros(len(found), bool)
        reached[order] = np.repeat(np.add.reduceat(lengths[order].astype(np.int64), starts) >= least, size)
        rows = np.bincount(np.repeat(np.arange(len(counts)), counts)[reached], minlength=len(counts))
        some = np.flatnonzero(rows)
        return table.select(["block", "range"]).take(pa.array(some)).append_column("offsets", _packed_lists(found[reached], rows[some]))

    return packets.groupBy("range").applyInArrow(each, HEAVY)


def extended(own: DataFrame, allowed: DataFrame, bits: int, range_bits: int) -> DataFrame:
    """The lists of the next level: of adjacent ones, those in heavy buckets."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                numbers, counts, ranges = _arrays(batch, i, 1, 2, 4)
                heads, tails, found, positions = adjacent(numbers, counts, summed(unpacked(batch.column(3)[i].as_py()), counts))
                offsets, size = _unpacked_lists(batch.column(5)[i].values)
                which = np.flatnonzero(np.isin(buckets(heads, tails, bits), (np.repeat(ranges, size) << range_bits) + offsets))
                found, positions = kept(found, positions, which)
                heads, tails = heads[which], tails[which]
                ranges = buckets(heads, tails, bits) >> range_bits
                order = np.argsort(ranges, kind="stable")
                starts, size = _grouped(order, ranges[order])
                packets = pa.StructArray.from_arrays(
                    [pa.array(ranges[order][starts]), _packed_lists(order, size), *(_packed_each(x[order], size) for x in (heads, tails, found))],
                    ["range", "which", "heads", "tails", "counts"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), *_lists((found, pa.int32())), pa.array([packed(steps(positions, found))], pa.binary()),
                     pa.ListArray.from_arrays(pa.array([0, len(starts)], pa.int32()), packets)], ["block", "counts", "positions", "packets"])

    known = allowed.groupBy("block").agg(F.collect_list(F.struct("range", "offsets")).alias("known"))
    return own.select("block", "numbers", "counts", "positions").join(known, "block").select(
        "block", "numbers", "counts", "positions", F.col("known.range").alias("range"), F.col("known.offsets").alias("offsets")).mapInArrow(each, LISTS)


def counted(packets: DataFrame, frequent: int) -> DataFrame:
    """Phrases of (block, range, which, heads, tails, counts) added up exactly:
    the frequent ones of each block with their numbers, and the phrases."""
    def each(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        flat = {name: unpacked(b"".join(table.column(name).to_pylist())) for name in ("heads", "tails", "counts")}
        which, rows = _unpacked_lists(table.column("which").chunk(0))
        order = np.lexsort((flat["tails"], flat["heads"]))
        heads, tails = flat["heads"][order], flat["tails"][order]
        opens = np.concatenate([[True], (heads[1:] != heads[:-1]) | (tails[1:] != tails[:-1])])
        starts = np.flatnonzero(opens)
        f = np.add.reduceat(flat["counts"][order], starts)
        some = f >= frequent
        # Numbers of a range begin where no other range's do.
        number = (np.int64(table.column("range")[0].as_py()) << 32) + np.cumsum(some) - 1
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(opens) - 1
        mask = some[place]
        own = np.bincount(np.repeat(np.arange(len(rows)), rows)[mask], minlength=len(rows))
        there = np.flatnonzero(own)
        parts = [table.column("block").take(pa.array(there)).combine_chunks(), _packed_each(which[mask], own[there]), _packed_each(number[place[mask]], own[there])]
        nothing = pa.nulls(len(there), pa.binary())
        blocks_of = pa.table([*parts, nothing, nothing, nothing], names=["block", "which", "numbers", "heads", "tails", "f"])
        told = pa.table([pa.array([None], pa.int64()), pa.array([None], pa.binary()), *(pa.array([packed(x[some])], pa.binary()) for x in (
            number, heads[starts], tails[starts], f))], names=blocks_of.column_names)
        return pa.concat_tables([blocks_of, told] if some.any() else [blocks_of])

    return packets.groupBy("range").applyInArrow(each, COUNTED)


def _phrases(found: DataFrame) -> DataFrame:
    """(head, tail, f, number) of what ``counted`` tells of phrases."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                yield pa.RecordBatch.from_arrays([pa.array(unpacked(c[i].as_py())) for c in batch.columns], ["head", "tail", "f", "number"])

    return found.where("block is null").select("heads", "tails", "f", "numbers").mapInArrow(each, "head long, tail long, f long, number long")


def _packed_rows(rows: DataFrame) -> DataFrame:
    """(block, which, numbers), packed, of rows of (block, which, number)."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, which, number = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            order = np.lexsort((which, block))
            starts, size = _grouped(order, block[order])
            yield pa.RecordBatch.from_arrays([pa.array(block[order][starts]), _packed_each(which[order], size), _packed_each(number[order], size)],
                                             ["block", "which", "numbers"])

    return rows.select("block", "which", "number").mapInArrow(each, "block long, which binary, numbers binary")


def frequent_words(lists: DataFrame, frequent: int) -> DataFrame:
    """(block, which, number) of each block's words that are frequent in all;
    the first of a word also has lang, phrase and its frequency ``f``.

    A word has one entry in a block, so no word holds many of them, and one
    dealing out by word gives both its sum and its number.
    """
    entries = lists.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("which", "x")).select(
        "block", "lang", "which", F.col("x.words").alias("phrase"), F.col("x.counts").alias("c"), F.monotonically_increasing_id().alias("entry"))
    same = Window.partitionBy("lang", "phrase")
    found = entries.withColumns({"f": F.sum("c").over(same), "number": F.min("entry").over(same)}).where(F.col("f") >= frequent)
    first = F.col("entry") == F.col("number")
    return cut(found.select("block", "which", "number", *[F.when(first, F.col(c)).alias(c) for c in ("lang", "phrase", "f")]), "phrase-words")


def levels(df: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, frequent: int = FREQUENT,
           block_words: int = BLOCK_WORDS) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) with all words counted, and for each number of words a table
    (lang, phrase, last, f, number, head, tail) of the frequent phrases."""
    lists = cut(blocks(df, text, lang, block_words), "phrase-blocks")
    in_block = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)
    total = cut(lists.select("lang", in_block.alias("n")).groupBy("lang").agg(F.sum("n").alias("n")).where("n > 0"), "phrase-totals")
    words = total.agg(F.sum("n")).first()[0] or 0
    bits = max(LEAST_BITS, (2 * words).bit_length())
    range_bits = min(bits - RANGES_BITS, RANGE_BITS)
    entries = frequent_words(lists, frequent)
    nobody = F.lit(None).cast("long")
    found = [cut(entries.where("f is not null").select(
        "lang", "phrase", F.col("phrase").alias("last"), "f", "number", nobody.alias("head"), nobody.alias("tail")), "phrase-level")]
    known = _packed_rows(entries)
    for _ in range(longest - 1):
        before, old = lists, entries
        own = cut(sure(before, known, bits, range_bits), "phrase-sure")
        discard(before)
        discard(old)
        allowed = heavy(own.select("block", F.explode("packets").alias("p")).select("block", "p.range", "p.offsets", "p.lengths"), frequent)
        lists = cut(extended(own, allowed, bits, range_bits), "phrase-lists")
        discard(own)
        entries = cut(counted(lists.select("block", F.explode("packets").alias("p")).select("block", "p.*"), frequent), "phrase-counted")
        known = entries.where("block is not null").select("block", "which", "numbers")
        heads = found[-1].select(F.col("number").alias("of_head"), "lang", F.col("phrase").alias("start"))
        tails = found[-1].select(F.col("number").alias("of_tail"), "last")
        spelt = _phrases(entries).join(heads, F.col("head") == F.col("of_head")).join(tails, F.col("tail") == F.col("of_tail"))
        found.append(cut(spelt.select("lang", F.concat_ws(" ", "start", "last").alias("phrase"), "last", "f", "number", "head", "tail"), "phrase-level"))
    discard(lists)
    discard(entries)
    return total, found


def scored(total: DataFrame, found: list[DataFrame]) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of candidates that no longer one
    covers; the score is that of the weakest cut."""
    parts = []
    for words, phrases in enumerate(found[1:], 2):
        own = phrases.select("number", "lang", "phrase", F.col("f").alias("a"))
        if words < len(found):
            longer = found[words].select(F.explode(F.array("head", "tail")).alias("part"), "f")
            # As often as a phrase one word longer: it never stands alone. Longer
            # ones that cover it hold one of that length that does.
            most = longer.groupBy("part").agg(F.max("f").alias("most"))
            own = own.join(most, F.col("number") == F.col("part"), "left").where(F.coalesce(F.col("most"), F.lit(0)) < F.col("a"))
        parts.append(own.select("lang", "phrase", "a"))
    candidates = parts[0]
    for part in parts[1:]:
        candidates = candidates.unionByName(part)
    frequency = found[0].select("lang", "phrase", "f")
    for phrases in found[1:]:
        frequency = frequency.unionByName(phrases.select("lang", "phrase", "f"))
    frequency = cut(frequency, "phrase-frequencies")
    left = frequency.select(F.col("lang").alias("l_lang"), F.col("phrase").alias("l_phrase"), F.col("f").alias("l"))
    right = frequency.select(F.col("lang").alias("r_lang"), F.col("phrase").alias("r_phrase"), F.col("f").alias("r"))
    words = F.split("phrase", " ")
    cuts = (candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size(words) - 1)))
            .withColumn("first", F.array_join(F.slice(words, F.lit(1), F.col("k")), " "))
            .withColumn("rest", F.array_join(F.slice(words, F.col("k") + 1, F.size(words)), " ")))
    wide = "decimal(38,0)"
    measured = (cuts.join(left, (F.col("lang") == F.col("l_lang")) & (F.col("first") == F.col("l_phrase")))
                .join(right, (F.col("lang") == F.col("r_lang")) & (F.col("rest") == F.col("r_phrase")))
                .join(total.withColumnRenamed("lang", "n_lang"), F.col("lang") == F.col("n_lang"))
                .withColumn("score", F.expr(f"(cast(a * 1000 as {wide}) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")))
    weakest = measured.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut"))
    return weakest.select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of each language that hold together most."""
    found = scored(*levels(table(spark, sf_dir, "documents")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= REPORTED)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


def _oracle() -> str:
    grams = "\n  UNION ALL ".join(
        f"SELECT lang, {k} AS k, array_to_string(w[i:i + {k - 1}], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM p WHERE len(w) >= {k})"
        for k in range(1, LONGEST + 1))
    return rf"""
WITH d AS (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), p AS MATERIALIZED (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM d
), g AS (
  {grams}
), f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= {FREQUENT}
), t AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang
), s AS (
  SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM f WHERE k >= 2
), inside AS (
  SELECT lang, array_to_string(w[:k - 1], ' ') AS phrase, f FROM s UNION ALL SELECT lang, array_to_string(w[2:], ' '), f FROM s
), longer AS (
  SELECT lang, phrase, max(f) AS most FROM inside GROUP BY lang, phrase
), c AS (
  SELECT s.lang, s.phrase, s.f AS a, s.w, unnest(range(1, s.k)) AS k FROM s LEFT JOIN longer USING (lang, phrase) WHERE coalesce(most, 0) < s.f
), m AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, t.n,
    CAST((CAST(c.a AS HUGEINT) * 1000 * t.n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:c.k], ' ')
    JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ') JOIN t ON t.lang = c.lang
), b AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM m
), o AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE place = 1
)
SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= {REPORTED}
"""


QUERIES = {"op12_phrase_collocations": op12_phrase_collocations}
ORACLES = {"op12_phrase_collocations": _oracle()}
