"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard

#: More rounds than any graph that fits a cluster needs; each halves its depth.
MAX_ROUNDS = 60


def _least(links: DataFrame) -> DataFrame:
    """The least neighbour, or itself, of every node of (a, b)."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("low"))


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Hang the larger (or smaller) neighbours of each node on its least one.

    The least neighbours are a table of their own, so that both sides of the
    join are dealt out and a hub's links can be split over tasks.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = cut(_least(links), "least")
    side = both.where(F.col("b") > F.col("a") if larger else F.col("b") < F.col("a"))
    hung = side.join(low, side["a"] == low["node"]).select(F.col("b").alias("x"), F.col("low").alias("y"))
    if not larger:
        hung = hung.unionByName(low.where("low < node").select(F.col("node").alias("x"), F.col("low").alias("y")))
    stars = (hung.where("x <> y")
             .select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    done = cut(stars, "stars")
    discard(low)
    return done


def _state(links: DataFrame) -> tuple:
    """What tells a table of links from others."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b).

    A component is named by its least node. Each round hangs larger
    neighbours, then smaller ones, on the least neighbour, until the links are
    stars; a round is a few aggregations and joins on links, and no node's
    neighbours are ever gathered in one place. The table of a round is removed
    when the next one is written.
    """
    links = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _state(links)
    for _ in range(MAX_ROUNDS):
        half = _star(links, larger=True)
        after = _star(half, larger=False)
        discard(links)
        discard(half)
        links, state = after, _state(after)
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
