"""Every query with SQL gives the rows its SQL gives."""

from __future__ import annotations

import duckdb
import pytest
from helpers import DATA, same
from pyspark.sql import functions as F

from eventlens.plans import catalog, rawlogs


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    same(catalog.QUERIES[name](spark, DATA), duck, catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def uneven(spark, folder: str, name: str) -> None:
    """A table of events whose first tasks have no rows, or none with values."""
    spark.read.parquet(f"{DATA}/events.parquet").where("event_id < 300").withColumns(
        {c: F.expr(f"if(event_id < 100, null, {c})") for c in ("event_type", "props")}).repartitionByRange(3, "event_id").write.parquet(
        f"{folder}/events.parquet")
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", "UTC")
    session.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    same(catalog.QUERIES[name](session, folder), con, catalog.ORACLES[name])


def test_json_flatten_where_tasks_have_no_rows(spark, tmp_path):
    uneven(spark, str(tmp_path), "json_flatten")


def test_json_lines_where_tasks_have_no_rows(spark, tmp_path):
    uneven(spark, str(tmp_path), "json_lines")


def test_json_array_in_documents_of_bounded_size(spark, duck, monkeypatch):
    """No task sorts or writes more than a document's events."""
    monkeypatch.setattr(rawlogs, "DOCUMENT_ROWS", 300)
    paths = []
    monkeypatch.setattr(rawlogs.files, "ingest", lambda s, inputs, read=rawlogs.files.ingest: (paths.extend(rawlogs.files.discover(s, inputs)), read(s, inputs))[1])
    same(catalog.QUERIES["json_array"](spark, DATA), duck, catalog.ORACLES["json_array"])
    assert len(paths) == 4


def test_raw_alerts_read_the_raw_files_once(spark, duck, monkeypatch):
    """In files of bounded size, and nothing goes back to them."""
    monkeypatch.setattr(rawlogs, "FILE_ROWS", 300)
    assert spark.read.csv(rawlogs.raw_log(spark, DATA), header=True).select("_metadata.file_name").distinct().count() == 4
    found = catalog.QUERIES["raw_alerts"](spark, DATA)
    assert "FileScan csv" not in found._jdf.queryExecution().executedPlan().toString()
    same(found, duck, catalog.ORACLES["raw_alerts"])


def test_entry_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries()"], cwd=root, check=True, timeout=120)
