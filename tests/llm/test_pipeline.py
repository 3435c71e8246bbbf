"""Each stage of the corpus pipeline on its own input."""

from __future__ import annotations

import random

import pytest
from helpers import DATA
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from eventlens.llm import common, decontaminate, mixing, quality, simhash

BY_NAME = dict(pipeline.STAGES)


def test_stages_are_in_order():
    assert [name for name, _ in pipeline.STAGES] == [
        "quality rules", "SimHash near-dedup", "benchmark decontamination", "source mixing", "sharding"]


def test_every_stage_takes_odd_and_empty_tables(spark, odd_docs, no_docs):
    words = {None: 0} | {r.text: len(r.text.encode().split()) for r in odd_docs.where("text is not null").collect()}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        assert stage(spark, no_docs, DATA).count() == 0
        got = []
        for docs in (odd_docs, odd_docs.withColumns({"target": F.lit("own"), "__words": F.lit(1), "failures": F.lit("x")})):
            out = stage(spark, docs, DATA)
            assert out.columns[: len(docs.columns)] == docs.columns and (k == 4 or out.columns == docs.columns)
            got.append(sorted((str(r.doc_id), r.text or "", str(r.source)) for r in out.collect()))
        assert got[0] == got[1]
        all_rows = sorted((str(r.doc_id), r.text or "", str(r.source)) for r in odd_docs.collect())
        blank = [r for r in got[0] if not words[r[1] if r[1] else None]]
        if name in ("benchmark decontamination", "sharding"):
            assert got[0] == all_rows
        elif name == "SimHash near-dedup":
            assert len(blank) == 1 and len(got[0]) == len(set(got[0]))
        elif name == "quality rules":
            assert not blank and set(got[0]) < set(all_rows)
        else:
            assert set(got[0]) <= set(all_rows)


def test_quality_stage_keeps_what_its_policy_keeps(spark, odd_docs):
    kept = BY_NAME["quality rules"](spark, odd_docs, DATA)
    want = quality.apply_policy(quality.ledger(odd_docs), "corpus").where("kept").count()
    assert 0 < kept.count() == want < odd_docs.count()


def test_near_stage_drops_copies_and_keeps_the_first(spark, odd_docs):
    kept = [r.doc_id for r in BY_NAME["SimHash near-dedup"](spark, odd_docs, DATA).collect()]
    assert 1 in kept and not {2, 7, None} & set(kept) and {15, 16, 20, 21, 22} <= set(kept) and kept.count(1) == 1


def test_near_stage_equals_brute_force_on_documents(spark):
    docs = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet")
    first: dict = {}
    for i, t in sorted((r.doc_id, r.text) for r in docs.collect()):
        first.setdefault(frozenset(simhash.shingles(t, 5)), i)
    sets, group = list(first), dict(zip(first, first, strict=True))
    places: dict = {}
    for s in sets:
        for shingle in s:
            places.setdefault(shingle, []).append(s)
    for a, b in {(a, b) for found in places.values() for k, a in enumerate(found) for b in found[k + 1:]}:
        if 10 * len(a & b) >= 8 * len(a | b) and group[a] != group[b]:
            group = {s: group[a] if g == group[b] else g for s, g in group.items()}
    want = {min(first[s] for s in sets if group[s] == g) for g in set(group.values())}
    assert len(want) < len(sets) and {r.doc_id for r in BY_NAME["SimHash near-dedup"](spark, docs, DATA).collect()} == want


def test_decontamination_stage_drops_leaks_alone(spark, odd_docs, duck):
    items = [t for (t,) in duck.sql("SELECT text FROM benchmark ORDER BY item_id LIMIT 5").fetchall()]
    rng = random.Random(8)
    leaky = []
    for i, t in enumerate(items):
        chars = list(t)
        for at in rng.sample(range(len(chars)), 2):
            chars[at] = "#"
        leaky.append((1000 + i, "before. " + "".join(chars) + " after", "en", "s", 1))
    docs = odd_docs.unionByName(spark.createDataFrame(leaky, odd_docs.schema))
    kept = BY_NAME["benchmark decontamination"](spark, docs, DATA)
    assert sorted(map(str, kept.collect())) == sorted(map(str, odd_docs.collect()))


def test_mixing_stage_repeats_rows_as_the_mix_says(spark, odd_docs):
    out = BY_NAME["source mixing"](spark, odd_docs, DATA)
    sized = odd_docs.withColumn("size", mixing.word_count(F.col("text")))
    assert out.count() == mixing.mix(sized).agg(F.sum("copies")).first()[0]


def test_run_equals_its_stages_and_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    docs, seen = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for i, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
    want = sorted(map(tuple, docs.collect()))

    def watched(i, stage, broken=()):
        def run(*given):
            seen.append(i)
            if i in broken:
                raise RuntimeError("lost")
            return stage(*given)
        return run

    def staged(*broken):
        monkeypatch.setattr(pipeline, "STAGES", [(n, watched(i, f, broken)) for i, (n, f) in enumerate(stages)])

    stages, run_id = pipeline.STAGES, tmp_path.name
    staged(3)
    with pytest.raises(RuntimeError, match="lost"):
        pipeline.run(spark, DATA, run_id)
    staged()
    got = pipeline.run(spark, DATA, run_id)
    assert seen == [0, 1, 2, 3, 3, 4] and sorted(map(tuple, got.collect())) == want
    assert got.columns[-2:] == ["slot", "shard"] and len(want) > 0
    assert decontaminate.leaks(got, spark.read.parquet(f"{DATA}/benchmark.parquet")).count() == 0
    folder = f"{common.shared_dir(spark)}/eventlens/pipeline-{run_id}"
    assert [common.exists(spark, f"{folder}/{i}") for i in range(4)] == [False, False, False, True]

