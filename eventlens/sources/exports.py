"""Results as CSV and JSON files."""

from __future__ import annotations

import json
import math
from datetime import date, datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def plain(value: object) -> object:
    """A value as JSON has it: times as ISO text, no NaN, rows as objects."""
    if isinstance(value, Row):
        return plain(value.asDict(recursive=True))
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value


def records(df: DataFrame) -> list[dict]:
    """The rows of a small result."""
    return [plain(r) for r in df.collect()]


def write_json(spark: SparkSession, path: str, payload: object) -> None:
    """One JSON document, on any file system that Spark reaches."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(json.dumps(plain(payload), ensure_ascii=False, indent=2).encode("utf-8")))
    finally:
        out.close()


def write_list(df: DataFrame, folder: str) -> None:
    """A list of any length as JSON lines, written in parallel."""
    df.write.mode("overwrite").option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").json(folder)


def write_events_csv(ordered: DataFrame, folder: str) -> None:
    """Standard events in order, as a folder of CSV parts with headers.

    The parts are ranges of the order, written in parallel; read by name they
    give the whole in order. Quotes inside values are doubled.
    """
    columns = [c for c in ordered.columns if c not in ("src", "session_index")]
    ordered.orderBy("uid", "user_event_index").select(*[F.col(f"`{c}`") for c in columns]).write.mode("overwrite").option(
        "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(folder, header=True, escape='"')
