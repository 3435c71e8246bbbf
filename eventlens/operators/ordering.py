"""A dense order of all rows, and sessions of users of any size, by ranges.

Rows are dealt into ranges of their order, sorted within, and written with
their place. A range is one task's work however its keys repeat, so a user with
a third of all events is cut into as many parts as they need. What crosses a
border between ranges is settled on a table with a row or two for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SESSION_GAP_MINUTES
from ..functions.values import named, seconds
from ..sources.scratch import written

#: Bits of a place that number the rows of a range.
ROW_BITS = 33


def event_keys() -> list[Column]:
    """Users in order, and their events by time, those without one last."""
    return [F.col("uid"), F.col("ts").asc_nulls_last(), F.col("src")]


def in_ranges(df: DataFrame, keys: list[Column], ranges: int | None = None) -> DataFrame:
    """``df`` as a table with ``range`` and ``row``, its place in the order.

    Ranges are as even as a sample makes them; rows with wholly equal keys
    stay together, in any order.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()
    placed = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("__place", place)
    return written(placed.withColumns({"range": F.shiftright("__place", ROW_BITS).cast("int"), "row": F.col("__place").bitwiseAND((1 << ROW_BITS) - 1)})
                   .drop("__place"), "ranges")


def dense_order(df: DataFrame, keys: list[Column], name: str = "event_order", ranges: int | None = None) -> DataFrame:
    """Add the number of each row in the order of all, from zero.

    Only the counts of ranges, one row each, meet in one task.
    """
    placed = in_ranges(df, keys, ranges)
    before = Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(F.col("range").alias("of")).count().select(
        "of", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    return placed.join(F.broadcast(starts), F.col("range") == F.col("of")).withColumn(
        name, F.col("start") + F.col("row")).drop("range", "row", "of", "start")


def _opens(ts: Column, before: Column, gap_minutes: float) -> Column:
    """Whether a session opens between two events that follow one another."""
    return (before.isNull() | ts.isNull() | ((seconds(ts) - seconds(before)) / 60.0 > gap_minutes)).cast("long")


def sessionize_in_ranges(events: DataFrame, gap_minutes: float = SESSION_GAP_MINUTES, ranges: int | None = None) -> DataFrame:
    """What ``sessionize`` adds, for users of any size.

    Each part of a user, the rows in one range, is numbered on its own; the
    parts of users that cross borders, two for each border at most, are then
    stitched: a part starts where those before it end, and its first event opens
    a session if it is far from the last one before it.
    """
    placed = in_ranges(events, event_keys(), ranges)
    part = Window.partitionBy("range", "uid").orderBy("row")
    so_far = part.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    index = F.row_number().over(part).cast("long") - 1
    own = placed.withColumns({"__index": index, "__before": F.lag("ts").over(part)}).withColumn(
        "__opens", F.when(F.col("__index") == 0, F.lit(0).cast("long")).otherwise(_opens(F.col("ts"), F.col("__before"), gap_minutes))).withColumn(
        "__sessions", F.sum("__opens").over(so_far))
    moved = F.broadcast(_borders(placed, own, gap_minutes))
    joined = own.join(moved, (own["range"] == moved["at"]) & own["uid"].eqNullSafe(moved["who"]), "left")
    whole = lambda own, ahead: F.col(own) + F.coalesce(ahead, F.lit(0).cast("long"))
    session = whole("__sessions", F.col("sessions_before"))
    return joined.withColumns({"user_event_index": whole("__index", F.col("events_before")), "session_index": session}).withColumn(
        "session_id", F.concat_ws("-", "uid", F.col("session_index").cast("string"))).select(
        *[named(c) for c in events.columns], "user_event_index", "session_index", "session_id")


def _borders(placed: DataFrame, own: DataFrame, gap_minutes: float) -> DataFrame:
    """(at, who, events_before, sessions_before) of the parts of users that
    lie in more than one range."""
    ends = placed.groupBy("range").agg(F.min_by(F.struct("uid"), "row")["uid"].alias("first"), F.max_by(F.struct("uid"), "row")["uid"].alias("last"))
    along = Window.orderBy("range")
    crossing = ends.withColumn("next", F.lead(F.struct("first")).over(along)).where(
        F.col("next").isNotNull() & F.col("last").eqNullSafe(F.col("next.first"))).select(F.col("last").alias("who")).distinct()
    rows = own.join(F.broadcast(crossing), F.col("uid").eqNullSafe(F.col("who")))
    parts = rows.groupBy("range", "who").agg(F.count("*").alias("n"), F.sum("__opens").alias("inner"), F.min_by(F.struct("ts"), "row")["ts"].alias("first_ts"),
                                             F.max_by(F.struct("ts"), "row")["ts"].alias("last_ts"))
    user = Window.partitionBy("who").orderBy("range")
    ahead = user.rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(user) == 1
    opened = parts.withColumn("opened", F.when(first, F.lit(1).cast("long")).otherwise(
        _opens(F.col("first_ts"), F.lag("last_ts").over(user), gap_minutes)))
    none = F.lit(0).cast("long")
    return opened.select(F.col("range").alias("at"), "who", F.coalesce(F.sum("n").over(ahead), none).alias("events_before"),
                         (F.coalesce(F.sum(F.col("inner") + F.col("opened")).over(ahead), none) + F.col("opened") - 1).alias("sessions_before"))
