"""Centroid clusters, phrases and exact duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlens.llm import clusters, exact, phrases

# --- clusters ------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def lloyd(rows: list[tuple], count: int, rounds: int, seed: int) -> tuple[list, list]:
    """(cluster, distance) of each row, and the centroids, by measuring all."""
    order = sorted(range(len(rows)), key=lambda i: (hashlib.sha256(f"{seed}:{rows[i][0]}".encode()).hexdigest(), rows[i][1]))
    centroids = [list(rows[i][1]) for i in order[:count]]
    for step in range(rounds + 1):
        own = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids)) for _, v in rows]
        if step < rounds:
            for k in range(len(centroids)):
                mine = [v for (_, v), (_, o) in zip(rows, own, strict=True) if o == k]
                if mine:
                    centroids[k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [(k, d) for d, k in own], centroids


@pytest.mark.parametrize(("n", "spread", "count", "width"), [(300, 3, 12, 3), (200, 1, 9, 2), (150, 1000, 20, 5), (60, 50, 1, 4), (40, 50, 2, 4), (5, 9, 8, 3), (80, 1 << 26, 7, 6)])
def test_clusters_equal_plain_rounds(spark, n, spread, count, width):
    rng = random.Random(n)
    rows = [(i, [rng.randint(-spread, spread) for _ in range(width)]) for i in range(n)]
    rows += rows[:5]
    state, centroids = clusters.cluster(spark.createDataFrame(rows, "vec_id long, v array<long>"), count, 5, 2)
    got = Counter((r.vec_id, r.cluster, r.distance) for r in clusters.assignments(state, centroids).collect())
    want, final = lloyd(rows, count, 5, 2)
    assert got == Counter((i, k, d) for (i, _), (k, d) in zip(rows, want, strict=True))
    assert centroids.tolist() == final


def test_bounds_hold_while_centroids_move(spark):
    """Every bound is below the true distance, and most are never measured."""
    rng = np.random.default_rng(3)
    middles = rng.integers(-300, 300, (12, 8))
    x = middles[rng.integers(0, 12, 2000)] + rng.integers(-20, 20, (2000, 8))
    c = x[:12].copy()
    own, upper, near, lower, rest = clusters._ranked(clusters.squared(x, c), 3)
    scans = 0
    for _ in range(6):
        after = np.array([x[own == k].sum(0) // max((own == k).sum(), 1) if (own == k).any() else c[k] for k in range(12)])
        moved = np.sqrt(((after - c) ** 2).sum(1)) * (1 + clusters.SLACK)
        c = after
        own, upper, near, lower, rest, used = clusters.reassign(x, own, upper, near, lower, rest, clusters.Moves(c, moved), 3)
        scans += (used == 3).sum()
        far = clusters.squared(x, c)
        roots = np.sqrt(far)
        assert (own == np.lexsort((np.tile(np.arange(12), (2000, 1)), far), axis=1)[:, 0]).all()
        assert (upper >= roots[np.arange(2000), own]).all() and (lower <= np.take_along_axis(roots, near, 1) + 1e-6).all()
        others = roots.copy()
        np.put_along_axis(others, np.column_stack([own, near]), np.inf, 1)
        assert (rest <= others.min(1) + 1e-6).all()
    assert scans < 6 * 2000 / 2


def test_only_whole_vectors_are_kept(spark):
    good, nan = [0.5, -0.004], float("nan")
    rows = [(1, good, 0), (2, [0.5], 0), (3, [0.5, None], 0), (4, [nan, 1.0], 0), (5, [float("inf"), 1.0], 0), (6, None, 0), (None, good, 1), (8, [], 0), (1, good, 0)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({"v": F.lit("x"), "cluster": F.lit(1)})
    kept = clusters.whole_vectors(df, dimensions=2)
    assert Counter((r.vec_id, tuple(r.v)) for r in kept.collect()) == Counter({(1, (128, -2)): 2, (None, (128, -2)): 1})
    found = clusters.assignments(*clusters.cluster(kept, 2)).collect()
    assert [(r.cluster, r.distance, r.inertia, r.centroid_sha256) for r in found] == [(0, 0, 0, hashlib.sha256(b"128,-2").hexdigest())] * 3
    assert clusters.assignments(*clusters.cluster(kept.where("false"), 2)).count() == 0
    with pytest.raises(Exception, match="pass 64 bits"):
        clusters.whole_vectors(spark.createDataFrame([(1, [1e30, 0.0], 0)], VECTORS), dimensions=2).collect()


# --- phrases -------------------------------------------------------------------


def phrases_of(rows: list[tuple], least: int, longest: int = 5) -> dict:
    """(lang, phrase) -> (a, l, r, n, score) by counting everything."""
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            counts.update((lang, tuple(words[i: i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    candidates = {x: a for x, a in counts.items() if len(x[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in candidates.items():
        if any(o == lang and len(q) > len(p) and b >= a and any(q[i: i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (o, q), b in candidates.items()):
            continue
        cuts = [(1000 * a * total[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out[lang, " ".join(p)] = (a, counts[lang, p[:k]], counts[lang, p[k:]], total[lang], score)
    return out


def texts(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    fixed = ["new york city", "a a a", "of the", "Größe über alles", "x\x00y z", "to be or not to be"]
    return [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice([*fixed, "a", "the", "b\tc", "The", "q"]) + rng.choice([" ", "  ", ". ", ",", "\n", " \t", "\r\n", ""])
                                                           for _ in range(rng.randint(0, 40)))) for _ in range(n)]


@pytest.mark.parametrize(("block_words", "many"), [(50, 120), (1000, 120), (4_000_000, 120)])
def test_phrases_equal_counting_everything(spark, monkeypatch, block_words, many):
    rows = [*texts(block_words, many), (None, None), ("en", ""), ("", "one two " * 9)]
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({"block": F.lit(1), "phrase": F.lit("x"), "words": F.lit("y")}).repartition(3)
    monkeypatch.setattr(phrases, "RANGE_BITS", 6)
    found = phrases.scored(*phrases.levels(df, frequent=5, block_words=block_words)).collect()
    got = {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score) for r in found}
    assert len(got) == len(found) > 50 and got == phrases_of(rows, 5)


def test_a_level_is_a_join_of_lists_by_position():
    # a b c at 0..2, b c at 4, 5; words a, b, c.
    counts, positions = np.array([1, 2, 2], np.int32), np.array([0, 1, 4, 2, 5], np.int32)
    heads, tails, many, at = phrases.adjacent(np.array([70, 71, 72]), counts, positions)
    assert (heads.tolist(), tails.tolist(), many.tolist(), at.tolist()) == ([70, 71], [71, 72], [1, 2], [0, 1, 4])
    heads, *_, at = phrases.adjacent(np.array([71, 72]), *phrases.kept(counts, positions, np.array([1, 2])))
    assert heads.tolist() == [71] and at.tolist() == [1, 4]
    assert [x.tolist() for x in phrases.kept(counts, positions, np.array([2, 0]))] == [[2, 1], [2, 5, 0]]
    assert all(not len(x) for x in phrases.adjacent(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)))


def test_packed_lists_come_back():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(0, 1 << k, 50) for k in range(1, 62)])
    assert phrases.unpacked(phrases.packed(x)).tolist() == x.tolist() and len(phrases.unpacked(phrases.packed(x[:0]))) == 0
    lists = [sorted(rng.choice(10_000, n, replace=False).tolist()) for n in (3, 0, 1, 700, 0, 2)]
    flat, counts = np.array([x for row in lists for x in row]), np.array([len(row) for row in lists])
    assert phrases.summed(phrases.steps(flat, counts), counts).tolist() == flat.tolist()
    full = counts[counts > 0]
    back, sizes = phrases._unpacked_lists(phrases._packed_lists(flat, full))
    assert back.tolist() == flat.tolist() and sizes.tolist() == full.tolist()


@pytest.mark.parametrize("frequent", [3, 255, 256, 700])
def test_buckets_rule_out_rare_phrases_only(spark, frequent):
    """Of lists dealt over blocks, each that is frequent is in a heavy bucket."""
    rng = np.random.default_rng(frequent)
    rows, totals = [], Counter()
    for block in range(40):
        offsets = np.unique(rng.integers(0, 60, 30))
        counts = rng.choice([1, 2, 20, 400], len(offsets))
        totals.update(dict(zip(((block % 3, o) for o in offsets.tolist()), counts.tolist(), strict=True)))
        rows.append((block, block % 3, bytearray(phrases.packed(np.diff(offsets, prepend=0))), bytearray(np.minimum(counts, 255).astype(np.uint8).tobytes())))
    got = phrases.heavy(spark.createDataFrame(rows, "block long, range long, offsets binary, lengths binary"), frequent).collect()
    kept = {(r.range, o) for r in got for o in np.cumsum(phrases.unpacked(bytes(r.offsets))).tolist()}
    assert kept >= {k for k, n in totals.items() if n >= frequent} and (frequent > 256 or kept < set(totals) or frequent == 3)


def test_no_phrases_of_no_texts(spark, no_docs):
    assert phrases.scored(*phrases.levels(no_docs)).count() == 0
    one = spark.createDataFrame([("en", "only word " * 3)], "lang string, text string")
    assert phrases.scored(*phrases.levels(one)).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    kinds = "lang string, phrase string, last string, f long, number long, head long, tail long"
    a, x, y, n = 3_000_000_019, 5_000_000_029, 4_000_000_007, 90_000_000_000_000_007
    found = [spark.createDataFrame([("en", "p", "p", x, 0, None, None), ("en", "q", "q", y, 1, None, None)], kinds),
             spark.createDataFrame([("en", "p q", "q", a, 0, 0, 1)], kinds)]
    (row,) = phrases.scored(spark.createDataFrame([("en", n)], "lang string, n long"), found).collect()
    assert row.score == 1000 * a * n // (x * y)


# --- exact duplicates ----------------------------------------------------------


def groups_of(rows: list[tuple]) -> Counter:
    """(doc_id, keep_id, group_size, sha256) of each row by comparing texts."""
    same: dict = {}
    for i, t in rows:
        same.setdefault(t or "", []).append(i)
    return Counter((i, max((x for x in same[t or ""] if x is not None), default=None), len(same[t or ""]), hashlib.sha256((t or "").encode()).digest()) for i, t in rows)


def weak(text):
    """Eight values for all texts, so that most texts collide."""
    return F.unhex(F.lpad(F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 1), 16, 10).cast("int").bitwiseAND(7).cast("string"), 2, "0"))


def checked(found, rows: list[tuple]) -> None:
    got = found.collect()
    digests = [hashlib.sha256((r.text or "").encode()).digest() for r in got] if "text" in found.columns else [bytes(r.digest) for r in got]
    assert Counter((r.doc_id, r.keep_id, r.group_size, d) for r, d in zip(got, digests, strict=True)) == groups_of(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({t or "" for _, t in rows}) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_groups_of_odd_rows(spark, odd_docs, odd_rows, as_table):
    rows = [(r[0], r[1]) for r in odd_rows]
    clashing = odd_docs.withColumns({"digest": F.lit("x"), "own": F.lit(1), "n": F.lit(2), "file": F.lit("f"), "_metadata": F.lit("m")}).repartition(5)
    checked(exact.deduplicate(spark, f"{as_table(clashing)}/documents.parquet"), rows)


def test_exact_groups_step_by_step(spark, odd_docs, odd_rows, as_table):
    """One file a step: later steps meet what the state has retained."""
    rows = [(r[0], r[1]) for r in odd_rows]
    checked(exact.deduplicate(spark, f"{as_table(odd_docs.repartition(4))}/documents.parquet", step_bytes=1), rows)


def test_full_bytes_tell_colliding_digests_apart(spark, odd_docs, odd_rows, as_table):
    rows = [(r[0], r[1]) for r in odd_rows]
    path = f"{as_table(odd_docs.repartition(4))}/documents.parquet"
    found = exact.deduplicate(spark, path, digest=weak)
    place = spark.read.parquet(path)
    texts = place.select("text", place.metadataColumn("_metadata")["file_path"].alias("file"), place.metadataColumn("_metadata")["row_index"].alias("row"))
    checked(found.join(texts, ["file", "row"]), rows)


def test_state_is_kept_between_calls(spark, tmp_path):
    schema, first = "doc_id long, text string", [(1, "a"), (2, "b"), (3, "a")]
    path, state = str(tmp_path / "docs"), f"file://{tmp_path}/state"
    spark.createDataFrame(first, schema).write.parquet(path)
    checked(exact.deduplicate(spark, path, state), first)
    more = [(9, "b"), (0, "a"), (4, "c")]
    spark.createDataFrame(more, schema).write.mode("append").parquet(path)
    checked(exact.deduplicate(spark, path, state), first + more)
    steps = spark.read.parquet(f"{state}/changed")
    # The second call's steps read three rows only.
    assert steps.where("step > 0").agg(F.sum("n")).first()[0] <= 3 + 2 + 1 and steps.agg(F.max("n")).first()[0] == 3


def test_no_documents_no_rows(spark, no_docs, as_table):
    assert exact.deduplicate(spark, f"{as_table(no_docs)}/documents.parquet").count() == 0
