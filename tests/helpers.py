"""Comparison of query results."""

from __future__ import annotations

DATA = "/root/testdata/sf0.001"


def plain(rows: list[tuple]) -> list[tuple]:
    """Rows in an order and form that compare."""
    def value(x):
        if hasattr(x, "item"):
            x = x.item()
        if isinstance(x, float):
            return None if x != x else round(x, 6)
        return x
    return sorted((tuple(value(x) for x in r) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def same(df, con, sql: str) -> None:
    """Assert that a DataFrame and a SQL text give equal rows."""
    columns = sorted(df.columns)
    relation = con.sql(sql)
    assert columns == sorted(relation.columns)
    got = plain([tuple(r[c] for c in columns) for r in df.collect()])
    where = [relation.columns.index(c) for c in columns]
    assert got == plain([tuple(r[i] for i in where) for r in relation.fetchall()])
