"""Raw log files as DataFrames of text columns.

Inputs are paths of any file system that Spark reads. Files of one layout, that
is of one header and separator, or of the same JSON fields, are one scan, so
jobs and plans grow with the layouts and not with the files.
"""

from __future__ import annotations

import csv
import io
import itertools
import json
import re
import zipfile
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.values import named
from . import scratch

#: Columns that a raw table has beside those of its files.
OWN = ("_src", "_source_file", "_source_sheet", "_source_place")
#: Files whose names travel to every task; more are joined by shuffle.
BROADCAST_FILES = 200_000
SUFFIXES = (".csv", ".tsv", ".txt", ".json", ".jsonl", ".xlsx", ".xls")


def name_of(path: str) -> str:
    return str(path).rstrip("/").rsplit("/", 1)[-1]


def suffix(path: str) -> str:
    name = name_of(path)
    return name[name.rfind("."):].lower() if "." in name else ""


def discover(spark: SparkSession, inputs: Iterable[object]) -> list[str]:
    """The log files among files and folders; folders are searched in order."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found: list[str] = []
    for item in map(str, inputs):
        path = jvm.org.apache.hadoop.fs.Path(item)
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            raise FileNotFoundError(f"no such input: {item}")
        if fs.getFileStatus(path).isDirectory():
            inside, files = [], fs.listFiles(path, True)
            while files.hasNext():
                inside.append(files.next().getPath().toString())
            found += sorted(f for f in inside if suffix(f) in SUFFIXES)
        elif suffix(item) not in SUFFIXES:
            raise ValueError(f"unsupported input: {item}")
        else:
            found.append(item)
    if not found:
        raise ValueError("no supported input files")
    return found


#: Bytes of a file's head that its layout is read off.
HEAD_BYTES = 1 << 16
#: Heads that are fetched at a time.
AT_ONCE = 32


@dataclass(frozen=True)
class Head:
    """How a file begins, and its size."""

    path: str
    size: int
    text: str

    def lines(self, n: int = 50) -> list[str]:
        found = re.split("\r\n|\n|\r", self.text)
        # The last line of a longer file's head may be cut off.
        return (found[:-1] if self.size > HEAD_BYTES and len(found) > 1 else found)[:n]

    @property
    def empty(self) -> bool:
        """Whether there is nothing in the file that could have a layout, as in
        what a task without rows writes."""
        return self.size <= HEAD_BYTES and not self.text.strip()


def heads(spark: SparkSession, paths: list[str]) -> list[Head]:
    """The heads of files, without a job: each is one short read."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def head(path: str) -> Head:
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(conf)
        stream = fs.open(at)
        try:
            text = bytes(stream.readNBytes(HEAD_BYTES)).decode("utf-8", "replace")
        finally:
            stream.close()
        return Head(path, fs.getFileStatus(at).getLen(), text.removeprefix("\ufeff"))

    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(head, paths))


def split_size(spark: SparkSession) -> int:
    """Bytes up to which Spark reads a file in one piece anyway."""
    return spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()


def separator(path: str, lines: list[str]) -> str:
    if suffix(path) != ".txt":
        return "\t" if suffix(path) == ".tsv" else ","
    try:
        return csv.Sniffer().sniff("\n".join(lines), delimiters=",\t;|").delimiter
    except csv.Error:
        return ","


def comparable(path: Column) -> Column:
    """A path as URI with one slash after its scheme."""
    return F.regexp_replace(path, "^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/")


def quotes_span_lines(spark: SparkSession, paths: list[str]) -> set[str]:
    """The files in which a line has an odd number of quotes, by one scan."""
    if not paths:
        return set()
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"')))) % 2 == 1
    lines = spark.read.text(paths)
    found = lines.where(odd).select(comparable(lines.metadataColumn("_metadata")["file_path"]).alias("path")).distinct().collect()
    own = {_uri(spark, p): p for p in paths}
    return {own[r.path] for r in found}


def _uri(spark: SparkSession, path: str) -> str:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri().toString()
    return re.sub("^([A-Za-z][A-Za-z0-9+.-]*):/+", r"\1:/", whole)


def header_of(lines: list[str], sep: str) -> tuple[str, ...]:
    return header_of_cells(next(csv.reader(io.StringIO("\n".join(lines)), delimiter=sep), []))


def header_of_cells(header: list[str | None]) -> tuple[str, ...]:
    """Column names as they are written; ones that repeat but for case are
    numbered."""
    names, seen = [], {}
    for name in ((h or "").strip() or f"column{i}" for i, h in enumerate(header)):
        n = seen[name.lower()] = seen.get(name.lower(), -1) + 1
        names.append(name if not n else f"{name}_{n}")
    return tuple(names)


def read_delimited(spark: SparkSession, paths: list[str], names: tuple[str, ...], sep: str, multiline: bool) -> DataFrame:
    """Delimited files of one layout, as one scan.

    Files are split over tasks unless ``multiline`` says that quoted fields
    span lines, for then a file has to be read from its start.
    """
    schema = ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
    return spark.read.csv(paths, schema=schema, header=True, sep=sep, quote='"', escape='"', multiLine=multiline,
                          enforceSchema=True, mode="PERMISSIVE", encoding="UTF-8")


def flat(schema: StructType, at: tuple[str, ...] = ()) -> list[Column]:
    """Leaf fields of a nested schema, under dotted names, as text."""
    out: list[Column] = []
    for f in schema.fields:
        path = (*at, f.name)
        if isinstance(f.dataType, StructType):
            out += flat(f.dataType, path)
        else:
            column = F.col(".".join(f"`{p}`" for p in path))
            out.append((F.to_json(column) if isinstance(f.dataType, ArrayType) else column.cast("string")).alias(".".join(path)))
    return out


def elements(text: str, n: int = 50) -> list[str]:
    """The first whole objects of an array that ``text`` begins."""
    found, at, decoder = [], re.match(r"[\s\[]*", text).end(), json.JSONDecoder()
    while len(found) < n:
        try:
            _, end = decoder.raw_decode(text, at)
        except ValueError:
            break
        found.append(text[at:end])
        at = re.compile(r"[\s,]*").match(text, end).end()
    return found


def keys_of(lines: list[str]) -> tuple[str, ...]:
    """The top-level fields of the JSON lines of a head."""
    found: set[str] = set()
    for line in lines:
        try:
            record = json.loads(line)
        except ValueError:
            continue
        found |= set(record) if isinstance(record, dict) else set()
    return tuple(sorted(found))


def _pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, block, value): the texts of files between closing braces, in
    order within a block, that is what a task reads of a file."""
    text = spark.read.text(paths, lineSep="}")
    at = text.metadataColumn("_metadata")
    block = at["file_block_start"].alias("block")
    if len(paths) == 1:
        return text.select(F.lit(0).cast("long").alias("file"), block, "value")
    order = spark.createDataFrame([(i, _uri(spark, p)) for i, p in enumerate(paths)], "file long, __of string")
    return text.select(comparable(at["file_path"]).alias("__path"), block, "value").join(F.broadcast(order), F.col("__path") == F.col("__of")).select("file", "block", "value")


def _stretches(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[int, ...], bytes]]:
    """Stretches of text of one block, with the numbers that stand by it."""
    for batch in batches:
        numbers = np.column_stack([batch.column(i).to_numpy() for i in range(batch.num_columns - 1)])
        cuts = [0, *(np.flatnonzero((np.diff(numbers, axis=0) != 0).any(axis=1)) + 1).tolist(), batch.num_rows]
        for begin, end in itertools.pairwise(cuts):
            if begin < end:
                pieces = batch.column("value").slice(begin, end - begin).to_pylist()
                yield tuple(numbers[begin].tolist()), ("}".join(pieces) + "}").encode()


#: What bytes do to the depth of brackets; quotes are told by 2.
_STEPS = np.zeros(256, np.int8)
_STEPS[list(b"{[")], _STEPS[list(b"}]")], _STEPS[ord('"')] = 1, -1, 2


def _steps(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places of brackets, what each does to the depth, and the parity of
    quotes before it; then the number of quotes."""
    plain = np.frombuffer(re.sub(rb"\\[\s\S]", b"__", data), np.uint8)
    at = np.flatnonzero(_STEPS[plain])
    steps = _STEPS[plain[at]]
    quote = steps == 2
    return at[~quote], steps[~quote], np.cumsum(quote)[~quote] % 2, int(quote.sum())


def _sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block whether its quotes are odd in number, and what it adds
    to the depth if it begins outside of a string, or inside."""
    found: dict[tuple[int, ...], list[int]] = {}
    for of, data in _stretches(batches):
        sums = found.setdefault(of, [0, 0, 0])
        _, steps, odd, quotes = _steps(data)
        for inside in (0, 1):
            sums[1 + inside] += int(steps[odd == (sums[0] + inside) % 2].sum())
        sums[0] = (sums[0] + quotes) % 2
    yield pa.RecordBatch.from_pylist([dict(zip(("file", "block", "odd", "outside", "inside"), (*of, *sums), strict=True)) for of, sums in found.items()],
                                     pa.schema([(c, pa.int64()) for c in ("file", "block", "odd", "outside", "inside")]))


#: Kinds of what a block is cut into: what ends its first record, whole records, what begins one.
_ENDING, _WHOLE, _BEGUN = 0, 1, 2


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of blocks, cut where an element of the array ends."""
    now, rest, place, inside, depth = None, [], 0, 0, 0

    def told(texts: list[bytes], kinds: list[int]) -> pa.RecordBatch:
        n = len(texts)
        return pa.RecordBatch.from_arrays(
            [pa.array([now[0]] * n, pa.int64()), pa.array([now[1]] * n, pa.int64()), pa.array(range(place, place + n), pa.int64()),
             pa.array(kinds, pa.int32()), pa.array(texts, pa.binary()).cast(pa.string())], ["file", "block", "at", "kind", "text"])

    for (*of, odd, deep), data in _stretches(batches):
        if of != now:
            if rest:
                yield told([b"".join(rest)], [_BEGUN])
            now, rest, place, inside, depth = of, [], 0, odd, deep
        at, steps, quotes, n = _steps(data)
        outside = quotes == inside
        depths = depth + np.cumsum(np.where(outside, steps, 0))
        closing = outside & (depths == 1) & (steps == -1) & (np.frombuffer(data, np.uint8)[at] == ord("}"))
        ends = (at[closing] + 1).tolist()
        inside, depth = (inside + n) % 2, int(depths[-1]) if len(depths) else depth
        if ends:
            texts = [data[b:e] for b, e in itertools.pairwise([0, *ends])]
            texts[0] = b"".join([*rest, texts[0]])
            yield told(texts, [_WHOLE if place else _ENDING, *[_WHOLE] * (len(texts) - 1)])
            place, rest = place + len(texts), []
        rest.append(data[ends[-1] if ends else 0:])
    if rest:
        yield told([b"".join(rest)], [_BEGUN])


#: Bytes of an array's lines to a part.
PART_BYTES = 32 << 20
#: The column that tells the files of arrays apart once they are lines.
ARRAY = "__array"


def arrays_as_lines(spark: SparkSession, paths: list[str], folder: str, size: int) -> None:
    """JSON arrays of objects rewritten as JSON lines, in many tasks.

    Files are read in pieces that end at closing braces, wherever a task
    begins. Each task sums up the quotes and brackets of its blocks; running
    sums over the blocks, a row each, say how deep a block begins and whether
    inside a string, so each can be cut into records by itself. What lies
    over a border of blocks is put together. Parts are written in the order
    of the records.
    """
    pieces, before = _pieces(spark, paths), Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = scratch.written(pieces.mapInArrow(_sums, "file long, block long, odd long, outside long, inside long"), "json-sums")
    running = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    starts = sums.withColumn("begins", running("odd") % 2).withColumn("adds", F.when(F.col("begins") == 1, F.col("inside")).otherwise(F.col("outside"))).select(
        "file", "block", "begins", running("adds").alias("depth"))
    cut = pieces.join(F.broadcast(starts), ["file", "block"]).select("file", "block", "begins", "depth", "value")
    found = scratch.written(cut.mapInArrow(_records, "file long, block long, at long, kind int, text string"), "json-records")
    border, order = found.where(F.col("kind") != _WHOLE), Window.partitionBy("file").orderBy("block", "at").rowsBetween(Window.unboundedPreceding, -1)
    numbered = border.select("file", "block", "at", F.coalesce(F.sum((F.col("kind") == _ENDING).cast("int")).over(order), F.lit(0)).alias("record"))
    joined = border.join(numbered, ["file", "block", "at"]).groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "at", "text"))).alias("parts")).select(
        "file", F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["at"].alias("at"), F.array_join(F.col("parts.text"), "").alias("text"))
    # Line ends can only stand between values; what leads a record joins it to the last.
    line = F.regexp_replace(F.regexp_replace("text", "^[\\s,\\[\ufeff]+", ""), "[\r\n]+", " ")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    lines = found.where(F.col("kind") == _WHOLE).select(*joined.columns).unionByName(joined).withColumn("value", line).where(F.col("value").startswith("{"))
    (lines.withColumnRenamed("file", ARRAY).repartitionByRange(n, ARRAY, "block", "at").sortWithinPartitions(ARRAY, "block", "at").select(ARRAY, "value")
     .write.partitionBy(ARRAY).text(folder))


def read_json(spark: SparkSession, paths: list[str], lines: bool) -> DataFrame:
    """JSON lines, or one JSON document; nested objects become dotted columns."""
    found = spark.read.option("multiLine", not lines).json(paths)
    return found.select(*flat(found.schema), *_place(found))


_XML = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if c.isalpha():
            n = n * 26 + ord(c.upper()) - 64
    return n - 1


class Workbook:
    """An .xlsx workbook whose sheets are read row by row.

    Only its shared strings and styles are held; a sheet's XML is read as it is
    unpacked, and each row is let go once it is told.
    """

    def __init__(self, content: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        names = self.zip.namelist()
        self.shared = list(self._shared()) if "xl/sharedStrings.xml" in names else []
        self.dated: set[int] = set()
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")) for f in styles.iterfind(".//m:numFmt", _XML) if any(c in (f.get("formatCode") or "").lower() for c in ("yy", "hh", "dd"))}
            kinds = [int(x.get("numFmtId", 0)) for x in styles.iterfind("m:cellXfs/m:xf", _XML)]
            self.dated = {i for i, k in enumerate(kinds) if 14 <= k <= 22 or k in own}
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        listed = ElementTree.fromstring(self.zip.read("xl/workbook.xml")).iterfind("m:sheets/m:sheet", _XML)
        self.sheets = [(s.get("name"), self._inside(targets[s.get(_REL)].lstrip("/"))) for s in listed]

    @staticmethod
    def _inside(target: str) -> str:
        return target if target.startswith("xl/") else f"xl/{target}"

    def _elements(self, name: str, tag: str) -> Iterator[ElementTree.Element]:
        with self.zip.open(name) as stream:
            path: list[ElementTree.Element] = []
            for event, element in ElementTree.iterparse(stream, ("start", "end")):
                if event == "start":
                    path.append(element)
                    continue
                path.pop()
                if element.tag == f"{{{_XML['m']}}}{tag}":
                    yield element
                    if path:
                        path[-1].clear()

    def _shared(self) -> Iterator[str]:
        for entry in self._elements("xl/sharedStrings.xml", "si"):
            yield "".join(t.text or "" for t in entry.iterfind(".//m:t", _XML))

    def _value(self, cell: ElementTree.Element) -> str | None:
        value, kind = cell.findtext("m:v", None, _XML), cell.get("t")
        if kind == "s" and value is not None:
            return self.shared[int(value)]
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iterfind(".//m:t", _XML))
        if value is not None and kind in (None, "n") and int(cell.get("s", 0)) in self.dated:
            return (datetime(1899, 12, 30) + timedelta(days=float(value))).isoformat(sep=" ", timespec="seconds")
        return value

    def rows(self, place: int) -> Iterator[list[str | None]]:
        """The rows of the sheet at ``place``, as text."""
        for row in self._elements(self.sheets[place][1], "row"):
            cells = {_column(c.get("r")) if c.get("r") else i: self._value(c) for i, c in enumerate(row.iterfind("m:c", _XML))}
            yield [cells.get(i) for i in range(max(cells, default=-1) + 1)]


#: Rows of a sheet that a task hands on at a time.
SHEET_BATCH = 5000


def read_workbook(spark: SparkSession, path: str) -> list[DataFrame]:
    """A frame for every sheet, each read by a task of its own. Only the names
    and headers of sheets come to the driver."""
    if suffix(path) == ".xls":
        raise ValueError(f"the old .xls format isn't supported: {path}")
    content = spark.read.format("binaryFile").load(path).select("content")

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                book = Workbook(data)
                yield pd.DataFrame([(i, name, next(book.rows(i), None)) for i, (name, _) in enumerate(book.sheets)], columns=["place", "sheet", "cells"])

    def body_of(place: int):
        def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for data in batch["content"]:
                    rows = itertools.islice(Workbook(data).rows(place), 1, None)
                    while part := list(itertools.islice(rows, SHEET_BATCH)):
                        yield pd.DataFrame({"cells": part})
        return body

    out = []
    for head in content.mapInPandas(heads, "place int, sheet string, cells array<string>").where("cells is not null").orderBy("place").collect():
        names = header_of_cells(head.cells)
        rows = content.mapInPandas(body_of(head.place), "cells array<string>")
        out.append(rows.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)], F.lit(head.sheet).alias("_source_sheet")))
    return out


def fields(spark: SparkSession, tables: Iterable[DataFrame], names: Iterable[str]) -> DataFrame:
    """Columns of raw tables as text, in one table; null where one has none."""
    parts = [t.select(*[(named(n) if n in t.columns else F.lit(None)).cast("string").alias(n) for n in names]) for t in tables]
    return reduce(DataFrame.unionByName, parts or [spark.createDataFrame([], StructType([StructField(n, StringType()) for n in names]))])


def _place(df: DataFrame) -> list[Column]:
    at = df.metadataColumn("_metadata")
    return [comparable(at["file_path"]).alias("__path"), at["file_name"].alias("__part"), at["file_block_start"].alias("__block"),
            F.monotonically_increasing_id().alias("__row")]


def _layouts(spark: SparkSession, known: list[Head]) -> dict[tuple, list[int]]:
    """The places of files by what one scan can read."""
    found: dict[tuple, list[int]] = {}
    whole = split_size(spark)
    delimited = [h for h in known if suffix(h.path) in (".csv", ".tsv", ".txt")]
    # A file of one piece loses nothing by being read from its start.
    spanning = quotes_span_lines(spark, [h.path for h in delimited if h.size > whole])
    for place, head in enumerate(known):
        kind, lines = suffix(head.path), head.lines()
        if head.empty:
            continue
        if kind in (".csv", ".tsv", ".txt"):
            sep = separator(head.path, lines)
            key = ("delimited", sep, header_of(lines, sep), head.size <= whole or head.path in spanning)
        elif kind == ".jsonl":
            key = ("lines", keys_of(lines))
        elif kind == ".json":
            large = head.size > whole and head.text.lstrip().startswith("[")
            key = ("array", keys_of(elements(head.text)) or place) if large else ("document", place)
        else:
            key = ("workbook", place)
        found.setdefault(key, []).append(place)
    return found


def ingest(spark: SparkSession, inputs: Iterable[object]) -> list[DataFrame]:
    """The raw tables of all inputs: one for each layout, however many files
    have it, and one for each sheet of a workbook.

    Rows carry their place (``_src``: file, part, block and row) and the name
    of their file. Files are told apart by a table of paths, a row each.
    """
    paths = discover(spark, inputs)
    known = [(_uri(spark, p), i, name_of(p)) for i, p in enumerate(paths)]
    out = []
    head_of = heads(spark, paths)
    sizes = {h.path: h.size for h in head_of}
    for key, places in _layouts(spark, head_of).items():
        files = [paths[i] for i in places]
        if key[0] == "workbook":
            for sheet in read_workbook(spark, files[0]):
                out.append(sheet.withColumns({"_src": _src(F.lit(places[0]), F.lit(""), F.lit(0), F.monotonically_increasing_id()),
                                              "_source_file": F.lit(name_of(files[0])), "_source_place": F.lit(places[0])}))
            continue
        if key[0] == "delimited":
            if not key[2]:
                continue
            raw = read_delimited(spark, files, key[2], key[1], key[3])
            # The columns as they are; of what Spark knows of a row only its place.
            rows = raw.select(*[named(c) for c in raw.columns], *_place(raw))
        elif key[0] == "array":
            folder = scratch.new_folder(spark, "json-lines")
            arrays_as_lines(spark, files, folder, sum(sizes[p] for p in files))
            order = spark.createDataFrame([(str(i), known[p][0]) for i, p in enumerate(places)], "__at string, __path string")
            rows = read_json(spark, [folder], lines=True).drop("__path").join(F.broadcast(order), F.col(ARRAY) == F.col("__at")).drop(ARRAY, "__at")
        else:
            rows = read_json(spark, files, lines=key[0] == "lines")
        if len(files) == 1:
            told = rows.withColumns({"_source_place": F.lit(places[0]), "_source_file": F.lit(name_of(files[0]))})
        else:
            order = spark.createDataFrame([known[i] for i in places], "__of string, _source_place int, _source_file string")
            told = rows.join(F.broadcast(order) if len(files) <= BROADCAST_FILES else order, F.col("__path") == F.col("__of")).drop("__of")
        part = F.col("__part") if key[0] == "array" else F.lit("")
        out.append(told.withColumn("_src", _src(F.col("_source_place"), part, F.col("__block"), F.col("__row")))
                   .drop("__path", "__part", "__block", "__row"))
    return out


def _src(file: Column, part: Column, block: Column, row: Column) -> Column:
    return F.struct(file.cast("int").alias("file"), part.alias("part"), block.cast("long").alias("block"), row.alias("row"))
