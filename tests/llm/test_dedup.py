"""Duplicate operators against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventlens.llm import components, near, passages, simhash, substrings, windows


def spans_removed(rows, tokens, size):
    """Brute force: for each row the flags of its removed tokens."""
    last = 1 << 63
    cut = [(last if i is None else i, tokens(t)) for i, t, *_ in rows]
    first: dict = {}
    for doc, seq in cut:
        for k in range(len(seq) - size + 1):
            w = tuple(seq[k: k + size])
            first[w] = min(first.get(w, last), doc)
    out = []
    for doc, seq in cut:
        gone = [False] * len(seq)
        for k in range(len(seq) - size + 1):
            if first[tuple(seq[k: k + size])] < doc:
                gone[k: k + size] = [True] * size
        out.append((seq, gone))
    return out


def test_passages_equal_brute_force(spark, odd_rows, odd_docs):
    want = sorted((str(i), len(s), sum(g), b" ".join(w for w, x in zip(s, g, strict=True) if not x).decode())
                  for (i, *_), (s, g) in zip(odd_rows, spans_removed(odd_rows, lambda t: (t or "").encode().split(), 50), strict=True))
    got = sorted((str(r.doc_id), r.n_words, sum(s["to"] - s["from"] for s in r.spans), r.kept)
                 for r in passages.remove_passages(odd_docs.withColumn("print", F.lit("clash"))).collect())
    assert got == want and any(n for _, _, n, _ in got)


def test_words_at_the_source_decide(spark, odd_docs, monkeypatch):
    """Spans that hashes only seem to match are kept."""
    true = passages.repeated_spans

    def lying(docs):
        spans = true(docs)
        wrong = spans.withColumn("source", F.struct("source.doc", "source.print", (F.col("source.start") + 1).alias("start")))
        return wrong

    monkeypatch.setattr(passages, "repeated_spans", lying)
    done = passages.remove_passages(odd_docs).collect()
    assert len(done) == odd_docs.count() and not any(r.spans for r in done)


def test_substrings_equal_brute_force(spark, odd_rows, odd_docs):
    want = sorted((str(i), len(s), sum(g), bytes(b for b, x in zip(s, g, strict=True) if not x))
                  for (i, *_), (s, g) in zip(odd_rows, spans_removed(odd_rows, lambda t: (t or "").encode(), 50), strict=True))
    got = sorted((str(r.doc_id), r.n_bytes, sum(s["to"] - s["from"] for s in r.spans), bytes(r.kept))
                 for r in substrings.remove_substrings(odd_docs.withColumn("body", F.lit(1))).collect())
    assert got == want and any(n for _, _, n, _ in got)


def test_a_hot_gram_is_split_up_without_loss(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 500)
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdef ") for _ in range(n))
    label, tails = text(60), [text(40) for _ in range(5)]
    rows = [(i, text(rng.randint(0, 60)) + label + rng.choice(tails) + text(rng.randint(0, 60))) for i in range(150)]
    rows += [(200 + i, label[i:] + text(30)) for i in range(40)] + [(None, label), (3, label + tails[0]), (300, " " * 300), (301, " " * 400)]
    want = sorted((str(i), bytes(b for b, x in zip(s, g, strict=True) if not x)) for (i, *_), (s, g) in zip(
        rows, spans_removed(rows, lambda t: t.encode(), 50), strict=True))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    # In the last ones no gather sees a hot gram, and the task that has its bucket does.
    for gather, hot, held in ((40, 3, 1 << 21), (400, 8, 1 << 21), (1 << 18, None, 1 << 21), (30, 12, 50), (60, 20, 200), (1 << 18, 5, 1)):
        done = substrings.remove_substrings(df, gather=gather, hot_from=hot, held=held)
        assert sorted((str(r.doc_id), bytes(r.kept)) for r in done.collect()) == want
    docs = substrings.keyed(df)
    states = {r.state for r in substrings.suffixes(docs, 16, 400, 8).select("state").distinct().collect()}
    assert states == {substrings.OPEN, substrings.GONE, substrings.SPLIT}


def test_refinement_sorts_by_later_buckets_within_earlier_ones():
    rng = np.random.default_rng(3)
    x = substrings.Suffixes(*rng.integers(0, 4, (3, 400)), rng.integers(0, 50, 400), *np.zeros((2, 400), np.int64), np.ones(400, np.int64))
    got, first = substrings._refine(x)
    keys = list(zip(got.bucket, got.behind, got.front, got.doc, strict=True))
    assert keys == sorted(keys)
    least = {k: min(d for *j, d in keys if tuple(j) == k) for k in {tuple(k[:3]) for k in keys}}
    assert [least[tuple(k[:3])] for k in keys] == list(first)


def test_long_texts_are_cut_into_pieces_without_loss(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 300)
    monkeypatch.setattr(passages, "CHUNK", 60)
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abc") for _ in range(3)) for _ in range(500))
    lengths = list(map(len, [text.encode(), b"x" * 49, b"y" * 50]))
    assert sum(b - a - 49 for g in substrings._pieces(lengths) for _, a, b in g) == sum(max(0, n - 49) for n in lengths)
    assert sum(b - a - 49 for g in passages.pieces([500, 49, 50], 60, 50) for _, a, b in g) == 452


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=0, max_size=200), st.integers(3, 9))
def test_runs_cover_every_window_once(values, window):
    tokens = windows.scramble(np.array(values, np.uint64) + np.uint64(1))
    half = len(tokens) // 2
    got, _ = windows.runs(tokens, np.array([0, half, len(tokens)]), window, 2)
    spans = windows.Spans(tokens)
    covered = sorted(i for s, c in zip(got.start, got.count, strict=True) for i in range(s, s + c))
    assert covered == [i for a, b in ((0, half), (half, len(tokens))) for i in range(a, b - window + 1)]
    ids = {}
    for s, c, pivot in zip(got.start, got.count, got.pivot, strict=True):
        for i in range(s, s + c):  # equal windows have equal pivots
            assert ids.setdefault(tuple(values[i: i + window]), pivot) == pivot
    same = spans.all(window) if len(tokens) >= window else []
    assert len(set(map(int, same))) == len({tuple(values[i: i + window]) for i in range(len(same))})


@pytest.mark.parametrize("code", [simhash.golay(), simhash.hamming()])
def test_codes_are_perfect(code):
    points = np.random.default_rng(0).integers(0, 1 << code.n, 500)
    row, anchor, beyond = code.anchors(points)
    far = np.bitwise_count(points[row] ^ anchor)
    assert (code.syndrome(anchor) == 0).all() and (np.bincount(row[~beyond], minlength=500) == 1).all()
    assert ((far <= code.radius) == ~beyond).all() and (far <= code.radius + 1).all()


def test_close_fingerprints_share_an_anchor():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    y = x ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    (ra, aa), (rb, ab) = (simhash.product_anchors(v.view(np.int64)) for v in (x, y))
    assert all(set(aa[ra == i]) & set(ab[rb == i]) for i in range(300))


def fingerprint(text: str | None) -> int:
    found = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(found[i: i + 3]) for i in range(max(1, len(found) - 2))] if found else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_equals_brute_force(spark, odd_rows, odd_docs):
    prints = [fingerprint(t) for _, t, *_ in odd_rows]
    group = list(range(len(prints)))
    for _ in prints:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 2:
                    group[i] = group[j] = min(group[i], group[j])
    named = {g: min((i for (i, *_), h in zip(odd_rows, group, strict=True) if h == g and i is not None), default=None) for g in group}
    want = sorted((str(i), p, str(named[g])) for (i, *_), p, g in zip(odd_rows, prints, group, strict=True))
    got = sorted((str(r.doc_id), r.fp % (1 << 64), str(r.component_id)) for r in simhash.link(odd_docs.withColumn("fp", F.lit(0))).collect())
    assert got == want


def test_many_bits_are_counted_right():
    hashes = np.random.default_rng(2).integers(0, 1 << 64, 70_001, dtype=np.uint64)
    want = 2 * np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) > len(hashes)
    assert (simhash.majority(hashes) == want).all()


def test_components_of_a_chain_a_star_and_pairs(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(7001, 7000), (7000, 7001), (5, 5)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, **{200 + i: 100 for i in range(30)}, 7000: 7000, 7001: 7000}


def jaccard(a: str, b: str) -> float:
    x, y = (set(simhash.shingles(t, 5)) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_near_groups_keep_one_of_each(spark, no_docs):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, clean, copies = [], [], []
    for k in range(40):
        base = [word() for _ in range(300)]
        rows.append((10 * k, " ".join(base), "en", "s", 1))
        clean.append(10 * k)
        for c in range(3):
            other = list(base)
            for at in rng.sample(range(300), 1 + c):
                other[at] = word()
            rows.append((10 * k + c + 1, " ".join(other), "en", "s", 1))
            copies.append((10 * k + c + 1, jaccard(" ".join(base), " ".join(other))))
    docs = spark.createDataFrame([*rows, rows[0], (None, None, None, None, None)], no_docs.schema)
    kept = [r.doc_id for r in near.keep_one(docs.withColumn("doc", F.lit(0))).collect()]
    assert set(clean) <= set(kept) and kept.count(0) == 1 and None in kept
    close = [i for i, j in copies if j >= 0.8]
    assert len(set(close) & set(kept)) <= 0.05 * len(close)


def test_near_groups_equal_brute_force_at_the_limit(spark, no_docs, monkeypatch):
    monkeypatch.setattr(near, "PART", 16, raising=False)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts, seen = {}, {"under": 0, "over": 0}
    for k in range(120):
        base = [word() for _ in range(200)]
        # A run of changed words takes as many shingles and four more.
        run = rng.randint(6, 40)
        other = base[:100] + [word() for _ in range(run)] + base[100 + run:]
        texts[2 * k], texts[2 * k + 1] = " ".join(base), " ".join(other)
        j = jaccard(texts[2 * k], texts[2 * k + 1])
        seen["over"] += 0.8 <= j < 0.9
        seen["under"] += 0.6 <= j < 0.8
    assert min(seen.values()) > 20
    # Many texts that look alike to the fingerprints, of which none is near another.
    base = [word() for _ in range(300)]
    for k in range(1000, 1050):
        texts[k] = " ".join(base[:255] + [word() for _ in range(45)])
    texts[1050] = texts[1000] + " " + " ".join(word() for _ in range(10))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts.items()], no_docs.schema)
    kept = {r.doc_id for r in near.keep_one(docs).collect()}
    group = {i: i for i in texts}
    pairs = [(2 * k, 2 * k + 1) for k in range(120)] + [(i, j) for i in range(1000, 1051) for j in range(i + 1, 1051)]
    for i, j in pairs:
        if jaccard(texts[i], texts[j]) >= 0.8:
            low, high = sorted((group[i], group[j]))
            group = {x: low if g == high else g for x, g in group.items()}
    want = {i for i in texts if group[i] == i}
    assert kept == want


def test_forest_joins_the_same_groups_with_few_links():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 62, (3, 4)).astype(np.uint64)
    prints = np.concatenate([np.repeat(base[:1], 50, 0), base[1:]])
    links, nearest = near.forest(np.arange(52), prints)
    assert len(links) == 49 and {x for p in links for x in p} == set(range(50))
    assert {a for a, _, _ in nearest} == set(range(50)) and all(a != b and bits == 0 for a, b, bits in nearest)


def test_nearest_of_several_tiles(monkeypatch):
    monkeypatch.setattr(near, "TILE", 7)
    rng = np.random.default_rng(6)
    prints = np.repeat(rng.integers(0, 1 << 62, (1, 4)).astype(np.uint64), 40, 0)
    prints[:, 0] ^= rng.integers(0, 1 << 12, 40).astype(np.uint64)
    apart = np.bitwise_count(prints[:, None, :] ^ prints[None, :, :]).sum(axis=2).astype(int) + 1000 * np.eye(40, dtype=int)
    links, nearest = near.forest(np.arange(40), prints)
    assert {a: bits for a, _, bits in nearest} == dict(enumerate(apart.min(axis=1).tolist())) and all(apart[a, b] == bits for a, b, bits in nearest)
    assert len(links) == 39


def test_a_large_group_is_linked_through_its_hub(spark, no_docs, monkeypatch):
    """Copies that are near the first text only, and a few that hang on another."""
    monkeypatch.setattr(near, "PART", 16)
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(200)]
    texts = {1: base}
    for k in range(2, 150):
        at = rng.randrange(0, 160)
        texts[k] = base[:at] + [word() for _ in range(14)] + base[at + 14:]
    texts[200] = texts[7][:180] + [word() for _ in range(20)]
    joined = {i: " ".join(t) for i, t in texts.items()}
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in joined.items()], no_docs.schema)
    group = {i: i for i in joined}
    for i in joined:
        for j in joined:
            if group[i] != group[j] and jaccard(joined[i], joined[j]) >= 0.8:
                low, high = sorted((group[i], group[j]))
                group = {x: low if g == high else g for x, g in group.items()}
    assert {r.doc_id for r in near.keep_one(docs).collect()} == set(group.values())


def test_empty_tables(spark, no_docs, as_table):
    folder = as_table(no_docs)
    for query in (simhash.op2_simhash_dedup, substrings.op3_substring_dedup, passages.op7_passage_dedup):
        assert query(spark, folder).count() == 0
    assert near.keep_one(no_docs).count() == 0


def test_query_digests(spark, odd_docs, odd_rows, as_table):
    folder = as_table(odd_docs)
    got = {r.doc_id: r for r in passages.op7_passage_dedup(spark, folder).collect()}
    assert got[1].kept_sha256 == hashlib.sha256(" ".join(odd_rows[3][1].split()).encode()).hexdigest()
    got = {r.doc_id: r for r in substrings.op3_substring_dedup(spark, folder).collect()}
    assert got[11].kept_sha256 == hashlib.sha256(b"").hexdigest() and got[11].n_bytes == 0
