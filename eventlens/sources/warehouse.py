"""A warehouse of runs: tables by run, and a log of numbered commits.

A run's tables are written first, under a version of their own, and become
visible with one commit: a file whose number is one above the last, put in
place only if no other writer has taken that number; then the next is tried.
Readers follow the last commit of a run, or the last up to a number they name,
so a run is replaced all at once or not at all, and a reader can stay with what
it has begun to read. Tables that no commit names any more are removed apart.
"""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import metrics
from .exports import plain

TABLES = ("raw_files", "standard_events", "session_facts", "user_journeys", "failure_contexts", "purchase_prior_events", "content_facts",
          "product_facts", "daily_summaries", "run_artifacts")
#: How far a stored figure may lie from one worked out again.
TOLERANCE = {"avg_session_duration_sec": 0.01, "revenue": 0.01, "arppu": 0.01, "conversion_rate": 0.0001}
RECORD = "number long, run_id string, version string, stored_at string, summary string, source_files string, counts string"


def store_run(spark: SparkSession, folder: str, run_id: str, tables: dict[str, DataFrame], summary: dict, sources: list[str]) -> dict[str, int]:
    """Write all tables of a run and commit them; return their row counts.

    Tables that were not made are counted as empty, and read as missing.
    """
    version = uuid.uuid4().hex
    counts = {}
    for name, df in tables.items():
        path = f"{folder}/{name}/run_id={run_id}/version={version}"
        df.write.mode("overwrite").parquet(path)
        counts[name] = spark.read.parquet(path).count()
    commit(spark, folder, {"run_id": run_id, "version": version, "stored_at": datetime.now(UTC).isoformat(),
                           "summary": json.dumps(summary, ensure_ascii=False, default=str), "source_files": json.dumps(sources, ensure_ascii=False),
                           "counts": json.dumps(counts)})
    return counts


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(folder).getFileSystem(spark._jsc.hadoopConfiguration())


def _entries(spark: SparkSession, folder: str) -> list:
    """The states of the files and folders in a folder; none if it isn't there."""
    path, fs = _fs(spark, folder)
    return list(fs.listStatus(path(folder))) if fs.exists(path(folder)) else []


def last_commit(spark: SparkSession, folder: str) -> int:
    """The number of the last commit, 0 before the first."""
    names = [e.getPath().getName() for e in _entries(spark, f"{folder}/_log")]
    return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)


def commit(spark: SparkSession, folder: str, record: dict) -> int:
    """Put a record in place under the next number; return the number.

    The file is written whole under another name first. Giving it its name
    fails if another writer was faster, and the next number is tried.
    """
    path, fs = _fs(spark, folder)
    number = last_commit(spark, folder)
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    unless_there = _no_overwrite(spark)
    while True:
        number += 1
        draft = path(f"{folder}/_log/.{uuid.uuid4().hex}.draft")
        out = fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(record | {"number": number}, ensure_ascii=False).encode()))
        finally:
            out.close()
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(path(f"{folder}/_log/{number:020d}.json")), unless_there)
            return number
        except Exception as e:  # noqa: BLE001  whatever else went wrong is raised
            fs.delete(draft, False)
            if "FileAlreadyExists" not in str(e):
                raise


def _no_overwrite(spark: SparkSession):
    kind = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.NONE
    return options


def _record(spark: SparkSession, folder: str, run_id: str, at: int | None = None):
    """The last record of a run, up to commit ``at`` if that is given."""
    if not last_commit(spark, folder):
        return None
    log = spark.read.schema(RECORD).json(f"{folder}/_log").where(F.col("run_id") == run_id)
    return (log if at is None else log.where(F.col("number") <= at)).orderBy(F.col("number").desc()).first()


def remove_orphans(spark: SparkSession, folder: str, older_than_hours: float = 24, keep_from: int | None = None) -> list[str]:
    """Remove tables that no run's last commit names, nor any commit from
    ``keep_from`` on, and return their folders.

    Younger ones may belong to a writer that hasn't committed yet.
    """
    path, fs = _fs(spark, folder)
    last = Window.partitionBy("run_id").orderBy(F.col("number").desc())
    current = F.row_number().over(last) == 1
    if last_commit(spark, folder):
        log = spark.read.schema(RECORD).json(f"{folder}/_log").withColumn("current", current)
        named = {r.version for r in log.where(F.col("current") | (F.col("number") >= (keep_from or 1 << 62))).select("version").collect()}
    else:
        named = set()
    limit, gone = (datetime.now(UTC).timestamp() - older_than_hours * 3600) * 1000, []
    for table in _entries(spark, folder):
        for run in _entries(spark, table.getPath().toString()) if table.isDirectory() and table.getPath().getName() != "_log" else ():
            for version in _entries(spark, run.getPath().toString()) if run.isDirectory() else ():
                name = version.getPath().getName()
                if name.startswith("version=") and name[8:] not in named and version.getModificationTime() < limit:
                    fs.delete(version.getPath(), True)
                    gone.append(version.getPath().toString())
    return gone


def count_rows(spark: SparkSession, folder: str, run_id: str, name: str) -> int:
    """Rows of a table of a run; none where there is no such run or table."""
    found = _record(spark, folder, run_id)
    return json.loads(found.counts).get(name, 0) if found is not None else 0


def raw_files(spark: SparkSession, reports: list[dict]) -> DataFrame:
    """A row for each raw table: its file, sheet, rows and columns."""
    rows = [(r["source_file"], r.get("source_sheet"), r["rows"], json.dumps(r["columns"], ensure_ascii=False)) for r in reports]
    return spark.createDataFrame(rows, "source_file string, source_sheet string, row_count long, columns_json string")


def artifacts(spark: SparkSession, parts: dict[str, object]) -> DataFrame:
    """A row for each part of a result, as JSON."""
    rows = [(name, json.dumps(plain(part), ensure_ascii=False)) for name, part in parts.items()]
    return spark.createDataFrame(rows, "artifact_type string, payload_json string")


def read_run(spark: SparkSession, folder: str, run_id: str, name: str, at: int | None = None) -> DataFrame:
    """One table of a stored run, as of commit ``at`` if that is given; only
    its own files are read."""
    found = _record(spark, folder, run_id, at)
    if found is None:
        raise LookupError(f"no such run: {run_id}")
    return spark.read.parquet(f"{folder}/{name}/run_id={run_id}/version={found.version}")


def compare(stored: dict, computed: dict) -> dict:
    """Whether the figures of a summary match those worked out again."""
    if not stored:
        return {"status": "missing", "differences": []}
    apart = [{"metric": k, "stored": stored.get(k), "computed": v} for k, v in computed.items()
             if stored.get(k) is None or abs(float(stored[k]) - float(v)) > TOLERANCE.get(k, 0)]
    return {"status": "mismatch" if apart else "match", "differences": apart}


def snapshot(spark: SparkSession, folder: str, run_id: str, at: int | None = None) -> dict:
    """A stored run: rows of its tables, its summary as stored and as worked
    out again, its days, its files by sheet, and the kinds of its artifacts.

    The status is ``empty`` where nothing was ever stored, ``missing`` where
    there is no such run, else ``found``.
    """
    if not last_commit(spark, folder):
        return {"status": "empty", "path": folder, "run_id": run_id}
    found = _record(spark, folder, run_id, at)
    if found is None:
        return {"status": "missing", "path": folder, "run_id": run_id}
    counts = json.loads(found.counts)

    def rows(name: str, *columns: str) -> list[dict]:
        if name not in counts:
            return []
        return [plain(r) for r in read_run(spark, folder, run_id, name, found.number).select(*columns).orderBy(*columns).collect()]

    events, sessions = (read_run(spark, folder, run_id, t, found.number) for t in ("standard_events", "session_facts"))
    computed, stored = metrics.run_summary(events, sessions).first().asDict(), json.loads(found.summary)
    dates = rows("daily_summaries", "date", "active_users", "events", "sessions", "avg_session_duration_sec", "revenue", "paying_users", "conversion_rate", "arppu")
    return {"status": "found", "path": folder, "run_id": run_id, "commit": found.number, "stored_at": found.stored_at,
            "table_counts": {t: counts.get(t, 0) for t in TABLES}, "summary": stored, "summary_by_date": {"date_count": len(dates), "dates": dates},
            "sql_summary": computed, "summary_validation": compare(stored, computed),
            "source_files": rows("raw_files", "source_file", "source_sheet", "row_count") or [{"source_file": f} for f in json.loads(found.source_files)],
            "artifact_types": [r["artifact_type"] for r in rows("run_artifacts", "artifact_type")]}
