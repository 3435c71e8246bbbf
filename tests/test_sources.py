"""Reading, understanding, storing and writing logs."""

from __future__ import annotations

import json
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventlens.config import Language
from eventlens.plans import pipeline, synthetic
from eventlens.sources import exports, files, roles, warehouse

HEAD = "uid,event_time,event_name,content_id,product_id,amount,duration_sec,wait_time_sec,result\n"


def test_discover(spark, tmp_path):
    (tmp_path / "b.csv").write_text("a\n1\n")
    (tmp_path / "a.JSONL").write_text("{}")
    (tmp_path / "x.md").write_text("")
    assert [files.name_of(p) for p in files.discover(spark, [tmp_path])] == ["a.JSONL", "b.csv"]
    assert len(files.discover(spark, [f"file://{tmp_path}/b.csv"])) == 1
    for bad, error in ((tmp_path / "x.md", ValueError), (tmp_path / "none.csv", FileNotFoundError)):
        with pytest.raises(error):
            files.discover(spark, [bad])


def test_delimited_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿uid,UID,a.b\n1,2,"x\ny"\n3\n4,5,6,7\n', encoding="utf-8")
    (tmp_path / "b.txt").write_text("uid;n\nu;1\nv;2\n")
    a, b = files.ingest(spark, [tmp_path])
    assert [tuple(r)[:3] for r in a.orderBy("_src").collect()] == [("1", "2", "x\ny"), ("3", None, None), ("4", "5", "6")]
    assert [(r.uid, r.n) for r in b.orderBy("_src").collect()] == [("u", "1"), ("v", "2")]


def test_logs_are_split_unless_quotes_span_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("uid,n\n" + "\n".join(f'u{i},"{i}, of it"' for i in range(20_000)))
    (tmp_path / "b.csv").write_text('uid,n\nu,"one\ntwo"\nv,2\n')
    both = [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]
    assert files.quotes_span_lines(spark, both) == {both[1]}
    small = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        (a,) = files.ingest(spark, [tmp_path / "a.csv"])
        assert a.rdd.getNumPartitions() > 4 and a.count() == 20_000
        assert [r.uid for r in a.orderBy("_src").take(3)] == ["u0", "u1", "u2"] and a.where("n = '7, of it'").count() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", small)
    (b,) = files.ingest(spark, [tmp_path / "b.csv"])
    assert [(r.uid, r.n) for r in b.orderBy("_src").collect()] == [("u", "one\ntwo"), ("v", "2")]


def _jobs(spark, work) -> int:
    """Jobs that some work starts."""
    group = f"jobs-{id(work)}"
    spark.sparkContext.setJobGroup(group, "")
    work()
    spark.sparkContext.setJobGroup("", "")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


@pytest.mark.parametrize("many", [12, 1000])
def test_files_of_one_layout_are_one_scan(spark, tmp_path, many):
    heads = ["uid,event_time,event_name\n{0},2026-05-28 10:00:00,login\n", "acct\tlog_at\tcode\n{0}\t2026-05-28 10:00:00\tlogin\n",
             "n;uid;behavior;log_dt\n1;{0};login;2026-05-28 10:00:00\n2;;login;2026-05-28 10:00:00\n"]
    for i in range(many):
        (tmp_path / f"{i:04d} a.{('csv', 'tsv', 'txt')[i % 3]}").write_text(heads[i % 3].format(f"u{i}"))
    tables = files.ingest(spark, [tmp_path])
    assert len(tables) == 3 and all(t._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1 for t in tables)
    found = []
    assert _jobs(spark, lambda: found.append(pipeline.understand(spark, [tmp_path], Language(), str(tmp_path / "work")))) <= 20
    reports = found[0].reports()
    assert len(reports) == many and [r["source_file"] for r in reports] == [f"{i:04d} a.{('csv', 'tsv', 'txt')[i % 3]}" for i in range(many)]
    assert [(r["rows"], r["missing_uid_rows"]) for r in reports[:3]] == [(1, 0), (1, 0), (2, 1)]
    # Rows stand in the order of files, whatever their layout.
    rows = found[0].rows.where("uid <> ''").orderBy("src").select("uid").collect()
    assert [r.uid for r in rows] == [f"u{i}" for i in range(many)]


def test_json_array_is_read_in_many_tasks(spark, tmp_path):
    rows = [{"i": i, "t": ['a } b', 'q " q', 'back \\', '{[', ""][i % 5], "x": {"y": [{"z": "}"}, {"z": str(i)}]}} for i in range(4000)]
    for name, text in (("a", json.dumps(rows)), ("b", json.dumps(rows, indent=1))):
        (tmp_path / f"{name}.json").write_text(text)
        session = spark.newSession()
        session.conf.set("spark.sql.files.maxPartitionBytes", "32k")
        (table,) = files.ingest(session, [tmp_path / f"{name}.json"])
        got = table.orderBy("_src").select("i", "t", "`x.y`").collect()
        assert [(int(r.i), r.t) for r in got] == [(r["i"], r["t"]) for r in rows] and json.loads(got[7]["x.y"]) == [{"z": "}"}, {"z": "7"}]
        assert session.read.text(str(tmp_path / f"{name}.json"), lineSep="}").rdd.getNumPartitions() > 4


def test_arrays_of_one_layout_are_one_table(spark, tmp_path):
    """Records longer than a block, strings with brackets and escapes, files of
    other fields, and an end that is cut off."""
    rows = [{"i": i, "t": ("]}" * 30_000 if i % 700 == 5 else 'q "{ \\ é')} for i in range(2000)]
    (tmp_path / "a.json").write_text(json.dumps(rows[:900], ensure_ascii=False))
    (tmp_path / "b.json").write_text(json.dumps(rows[900:], indent=1))
    (tmp_path / "c.json").write_text(json.dumps([{"uid": f"u{i}"} for i in range(2000)]) + "\n")
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    one, two = files.ingest(session, [tmp_path])
    got = one.orderBy("_src").select("i", "t", "_source_file").collect()
    assert [(int(r.i), r.t) for r in got] == [(r["i"], r["t"]) for r in rows] and [got[i]._source_file for i in (0, 899, 900)] == ["a.json", "a.json", "b.json"]
    assert two.count() == 2000 and "uid" in two.columns


def test_json_lines_of_other_fields_are_other_tables(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"uid": "u", "x": {"y": 1}}\n{"uid": "v"}\n')
    (tmp_path / "b.jsonl").write_text('{"uid": "w", "x": {"y": 2}}\n')
    (tmp_path / "c.jsonl").write_text('{"account_id": "z"}\n')
    one, two = files.ingest(spark, [tmp_path])
    assert [(r.uid, r["x.y"], r._source_file) for r in one.orderBy("_src").collect()] == [("u", "1", "a.jsonl"), ("v", None, "a.jsonl"), ("w", "2", "b.jsonl")]
    assert two.first().account_id == "z"


def test_files_without_rows_have_no_layout(spark, tmp_path):
    """As a task without rows writes them."""
    (tmp_path / "a.jsonl").write_text("")
    (tmp_path / "b.jsonl").write_text('{"uid": "u"}\n')
    (tmp_path / "c.jsonl").write_text("\n")
    (table,) = files.ingest(spark, [tmp_path])
    assert [(r.uid, r._source_file) for r in table.collect()] == [("u", "b.jsonl")]
    assert files.fields(spark, [table], ["uid", "x.y"]).collect() == [("u", None)]


def test_json_is_flattened(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"uid": "u", "x": {"y": {"z": 1}}, "l": [1, 2]}]')
    (table,) = files.ingest(spark, [tmp_path / "a.json"])
    r = {k: v for k, v in table.first().asDict().items() if k not in files.OWN}
    assert r == {"uid": "u", "x.y.z": "1", "l": "[1,2]"}


def _workbook(path, rows):
    cells = lambda r: "".join(f'<c t="inlineStr"><is><t>{v}</t></is></c>' for v in r)
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rel}><sheets><sheet name="log" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f"<worksheet {ns}><sheetData>" + "".join(f"<row>{cells(r)}</row>" for r in rows) + "</sheetData></worksheet>")


def test_workbook(spark, tmp_path):
    _workbook(tmp_path / "log.xlsx", [["e_code", "user_id"], ["a", "1"], ["b", "2"]])
    (table,) = files.ingest(spark, [tmp_path / "log.xlsx"])
    assert [(r.e_code, r.user_id, r._source_sheet) for r in table.collect()] == [("a", "1", "log"), ("b", "2", "log")]
    with pytest.raises(ValueError, match="xls"):
        files.read_workbook(spark, str(tmp_path / "old.xls"))


def test_sheets_are_read_row_by_row(tmp_path):
    """A large sheet takes little more memory than a small one."""
    import tracemalloc

    _workbook(tmp_path / "log.xlsx", [["e_code", "user_id"], *([f"code {i}", str(i)] for i in range(60_000))])
    book, n = files.Workbook((tmp_path / "log.xlsx").read_bytes()), 0
    tracemalloc.start()
    for n, row in enumerate(book.rows(0)):
        assert row == (["e_code", "user_id"] if n == 0 else [f"code {n - 1}", str(n - 1)])
    assert n == 60_000 and tracemalloc.get_traced_memory()[1] < 4_000_000
    tracemalloc.stop()


def test_roles_by_name_and_value(spark):
    columns = ("acct", "log_at", "content", "sku", "krw", "queue_seconds", "state")
    found = roles.infer(roles.profile(spark.createDataFrame([("x",) * 7], ", ".join(f"{c} string" for c in columns))))
    assert tuple(found.whole()[r] for r in ("uid", "timestamp", "content_id", "product_id", "amount", "result", "event")) == (
        "acct", "log_at", "content", "sku", "krw", "state", None)
    rows = [(f"user-{i}", "2026-05-28 10:00:00", ("go_in", "go_out")[i % 2], ("fail", "success")[i % 2], str(i), None) for i in range(40)]
    by_value = roles.infer(roles.profile(spark.createDataFrame(rows, "c1 string, c2 string, c3 string, c4 string, c5 string, c6 string")))
    assert tuple(by_value[r] for r in ("uid", "timestamp", "event", "result", "amount")) == ("c1", "c2", "c3", "c4", "c5")


def test_profile_of_columns(spark):
    rows = [(" 7 ", "2026/5/28 10:00", "a", None), ("-1.5e3", "28.5.2026", "a", ""), ("7", "10:30", "b_1", " "), ("12d", "no date", "가", None), ("", "1/2/2026", None, None)]
    got = {r.name: r for r in roles.profile(spark.createDataFrame(rows, "n string, `d``t` string, w string, e string")).collect()}
    n, d, w, e = (got[c] for c in ("n", "d`t", "w", "e"))
    assert (n.filled, n["distinct"], n.numeric, round(n.positive, 4), n.worded) == (4, 0.75, 0.75, 0.6667, 0.5)
    assert (d.filled, d.dated, d.numeric) == (5, 0.8, 0.0)
    assert (w.filled, w["distinct"], w.worded, w.dated) == (4, 0.75, 1.0, 0.0)
    assert (e.filled, e["distinct"], e.numeric, e.worded, e.dated, e.result) == (0, 0, 0, 0, 0, 0)
    assert roles.infer(roles.profile(spark.createDataFrame([], "uid string, x string"))) == {"uid": "uid"}


def test_pipeline_end_to_end(spark, tmp_path):
    log = tmp_path / "log.csv"
    log.write_text(HEAD + "u1,2026-05-28 10:00:00,login,,,,,,\nu1,2026-05-28 10:00:00,login,,,,,,\nu1,2026-05-28 10:05:00,pkg_starter_buy,,starter_pack,9900,,,\n"
                   "u2,2026-05-29 10:00:00,arena_enter,arena,,,,,\nu2,2026-05-29 10:02:00,mystery,arena,,,,45,timeout\n,2026-05-28 10:00:00,login,,,,,,\nu3,,login,,,,,,\n")
    words = tmp_path / "words.json"
    language = Language()
    language.put_event("login", "접속", "session_start", None)
    language.contents["arena"] = {"label": "아레나", "type": "pvp"}
    words.write_text("\ufeff" + json.dumps(language.stored()), encoding="utf-8")
    steps = []
    got = pipeline.run_pipeline(spark, [log], tmp_path / "out", words, run_id="r1", store=str(tmp_path / "store"), progress=lambda p, s, m: steps.append(p))
    s, q = got["summary"], got["data_quality"]
    assert (s["active_users"], s["events"], s["revenue"], s["paying_users"]) == (3, 6, 9900.0, 1)
    assert (q["input_rows"], q["normalized_rows"], q["missing_uid_rows"], q["missing_timestamp_rows"], q["duplicate_events"]) == (7, 6, 1, 1, 1)
    assert [c["group"] for c in got["content_health"]] == ["아레나", "상품"] or {c["group"] for c in got["content_health"]} == {"아레나", "상품"}
    assert got["summary_by_date"]["unknown_timestamp_events"] == 1 and steps == sorted(steps)
    assert json.loads((tmp_path / "out/summary.json").read_text())["revenue"] == 9900.0
    assert warehouse.snapshot(spark, str(tmp_path / "store"), "r1")["summary_validation"] == {"status": "match", "differences": []}
    store = str(tmp_path / "store")
    assert warehouse.count_rows(spark, store, "r1", "raw_files") == 1 and warehouse.count_rows(spark, store, "none", "raw_files") == 0
    assert warehouse.read_run(spark, store, "r1", "daily_summaries").count() == 2
    parts = {r.artifact_type: json.loads(r.payload_json) for r in warehouse.read_run(spark, store, "r1", "run_artifacts").collect()}
    assert parts["summary"]["revenue"] == 9900.0 and len(parts["ai_context"]["briefing_rules"]) == 4
    report = q["files"][0]
    assert (report["source_file"], report["rows"], report["missing_uid_rows"], report["fields"]["uid"]) == ("log.csv", 7, 1, "uid")
    issue = next(i for i in got["issues"]["content"] if i["type"] == "content_friction")
    assert issue["title"] == "아레나 대기/매칭 지연 의심" and issue["evidence"][0] == "평균 대기시간 45.0초" and issue["confidence_label"] == "유력"
    mapped = got["issues"]["content"][0]
    assert got["engine_version"] and got["language"]["needs_confirmation_count"] == q["inferred_rows"] == 3 and mapped["type"] == "log_mapping_needed"
    assert got["alerts"][0]["top_evidence"] and got["totals"]["content_health"] == len(got["content_health"])
    assert got["behavior_flow"]["user_samples"][0]["top_codes"][0] == {"code": "login", "label": "접속", "count": 2}
    assert spark.read.json(str(tmp_path / "out/lists/language_suggestions")).count() == got["totals"]["language_suggestions"]
    assert not (tmp_path / "out/work").exists()
    pipeline.run_pipeline(spark, [log], tmp_path / "out", words, run_id="r1", store=str(tmp_path / "store"))
    assert warehouse.read_run(spark, str(tmp_path / "store"), "r1", "standard_events").count() == 6
    assert warehouse.snapshot(spark, str(tmp_path / "store"), "none")["status"] == "missing"


def test_writers_of_one_run_and_what_readers_see(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    one, two, three = (spark.range(n).withColumn("uid", F.lit("u")) for n in (1, 2, 3))
    assert warehouse.snapshot(spark, store, "r")["status"] == "empty" and warehouse.count_rows(spark, store, "r", "a") == 0
    put = lambda df, run="r": warehouse.store_run(spark, store, run, {"a": df, "b": df}, {}, [])
    put(one)
    assert warehouse.snapshot(spark, store, "other")["status"] == "missing"
    # Both writers have seen the same last commit; the slower one takes the next number.
    seen = warehouse.last_commit(spark, store)
    put(two)
    with monkeypatch.context() as m:
        m.setattr(warehouse, "last_commit", lambda *_: seen)
        put(three)
    assert warehouse.last_commit(spark, store) == 3
    sizes = lambda at=None: [warehouse.read_run(spark, store, "r", t, at).count() for t in ("a", "b")]
    assert sizes() == [3, 3] and sizes(1) == [1, 1] and sizes(2) == [2, 2]
    # A failure between two tables leaves the run as it was, and an orphan.
    with pytest.raises(Exception, match="no_such_column"):
        warehouse.store_run(spark, store, "r", {"a": two, "b": two.withColumn("x", F.expr("raise_error('no_such_column')"))}, {}, [])
    assert sizes() == [3, 3] and warehouse.last_commit(spark, store) == 3
    assert warehouse.remove_orphans(spark, store) == []
    gone = warehouse.remove_orphans(spark, store, older_than_hours=-1, keep_from=2)
    assert len(gone) == 4 and sizes() == [3, 3] and sizes(2) == [2, 2]
    put(two)
    assert sizes() == [2, 2] and warehouse.last_commit(spark, store) == 4


def test_codes_to_map_lead_the_issues_and_are_among_the_alerts(spark, tmp_path):
    (tmp_path / "log.csv").write_text("uid,event_time,event_name\nu1,2026-05-28 10:00:00,510101\nu1,2026-05-28 10:01:00,570202\n")
    got = pipeline.run_pipeline(spark, [tmp_path / "log.csv"], tmp_path / "out")
    assert [i["type"] for i in got["issues"]["content"]] == ["log_mapping_needed"]
    assert [a["title"] for a in got["alerts"]] == ["로그 코드 매핑 필요", "결제 데이터 없음"] and got["ai_context"]["top_alerts"] == got["alerts"]
    stored = [json.loads(x) for f in (tmp_path / "out/lists/issues").glob("*.json") for x in f.read_text().splitlines()]
    assert {i["type"] for i in stored} == {"log_mapping_needed", "revenue_missing"}


def test_compare_and_plain():
    assert warehouse.compare({}, {"events": 1})["status"] == "missing"
    assert warehouse.compare({"revenue": 1.005}, {"revenue": 1.0})["status"] == "match"
    assert warehouse.compare({"events": 2}, {"events": 1})["differences"][0]["metric"] == "events"
    assert exports.plain({"a": float("nan"), 1: (1, 2)}) == {"a": None, "1": [1, 2]}


def test_synthetic_log(spark):
    log = synthetic.synthetic_log(spark, 120, 12)
    assert log.count() == 120 and log.select("uid").distinct().count() == 12
    r = log.where("_src = 30").first()
    assert (r.uid, r.event_time, r.event_name, r.product_id, r.amount) == ("u000006", "2026-05-28 00:00:15", "pkg_starter_buy", "starter_pack", 9900)
