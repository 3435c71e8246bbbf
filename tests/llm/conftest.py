"""Documents with all the odd cases, and brute force to hold results against."""

from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows() -> list[tuple]:
    """Nulls, empty and long texts, copies, near copies, shared passages, repeated rows."""
    rng = random.Random(7)
    passage, base, long = words(rng, 80), words(rng, 120), words(rng, 3000)
    near = base.split()
    near[60] = "changed"
    texts = [
        (5, passage + " " + words(rng, 30)), (3, words(rng, 20) + " " + passage + " " + words(rng, 25)), (9, words(rng, 10) + "\n" + passage),
        (1, base), (2, base), (4, " ".join(near)), (7, base), (10, ""), (11, None), (12, "  \n\t "), (13, "one two"), (14, "one two"),
        (15, long), (16, long[:9000] + " " + words(rng, 200)), (17, "ÄÖÜ naïve été " * 30), (18, "x " * 200), (None, base), (None, None),
        (20, words(rng, 60) + " Unicode space is a letter " + words(rng, 60)), (21, words(rng, 120)), (22, words(rng, 120)),
        (23, "# $ | % " * 40), (24, words(rng, 49)), (25, words(rng, 50))]
    rows = [(i, t, "en", ("a", "b", None)[k % 3], len(t or "")) for k, (i, t) in enumerate(texts)]
    return [*rows, rows[3], rows[0]]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def as_table(tmp_path):
    """Write a DataFrame as one table of a data folder."""
    def write(df, name: str = "documents") -> str:
        df.write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)
    return write
