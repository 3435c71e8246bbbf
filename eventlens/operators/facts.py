"""Facts about sessions, users, failures and purchases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ENTER_TYPES, FAILURE_TYPES, LOOKBACK_EVENTS, LOOKBACK_MINUTES
from ..functions.values import filled, ratio, seconds

AT = "user_event_index"


def is_purchase() -> Column:
    return F.col("event_type") == "purchase"


def is_failure() -> Column:
    return F.col("event_type").isin(*FAILURE_TYPES)


def first_of(c: str, where: Column | None = None) -> Column:
    """The value at the first event (of those in question), null or not."""
    at = F.col(AT) if where is None else F.when(where, F.col(AT))
    return F.min_by(F.struct(c), at)[c]


def last_of(c: str) -> Column:
    return F.max_by(F.struct(c), F.col(AT))[c]


def _money() -> list[Column]:
    return [F.count_if(is_purchase()).alias("purchase_count"),
            F.coalesce(F.sum(F.when(is_purchase(), F.col("amount")).otherwise(0.0)), F.lit(0.0)).alias("revenue")]


def session_facts(ordered: DataFrame) -> DataFrame:
    """One row per session; content_groups by their first appearance.

    A session's groups are reduced to the place where each began before they
    are gathered; both aggregations and their join share one partitioning.
    """
    groups = _session_groups(ordered).select("uid", "session_index", F.transform(F.array_sort("groups"), lambda g: g["group"]).alias("content_groups"))
    found = ordered.groupBy("uid", "session_index", "session_id").agg(
        first_of("ts").alias("start"), last_of("ts").alias("end"), F.count("*").alias("event_count"),
        first_of("event_label").alias("first_event"), last_of("event_label").alias("last_event"),
        last_of("event_type").alias("last_event_type"), *_money()).join(groups, ["uid", "session_index"], "left").withColumn(
        "content_groups", F.coalesce("content_groups", F.array().cast("array<string>")))
    passed = F.greatest(F.lit(0), seconds(F.col("end")) - seconds(F.col("start")))
    return found.select(
        "session_id", "uid", "start", "end", F.coalesce(passed, F.lit(0)).cast("long").alias("duration_sec"), "event_count",
        "first_event", "last_event", "last_event_type", "content_groups", "purchase_count", "revenue",
        F.coalesce(F.col("last_event_type").isin(*FAILURE_TYPES), F.lit(False)).alias("ended_after_failure"))


def _session_groups(ordered: DataFrame) -> DataFrame:
    """(uid, session_index, groups): each group once, with its first place."""
    return ordered.where(F.col("group") != "").groupBy("uid", "session_index", "group").agg(F.min(AT).alias("first")).groupBy(
        "uid", "session_index").agg(F.collect_list(F.struct("first", "group")).alias("groups"))


def user_journeys(ordered: DataFrame) -> DataFrame:
    """One row per user, in one aggregation."""
    entered = F.col("group").isNotNull() & F.col("event_type").isin(*ENTER_TYPES)
    return ordered.groupBy("uid").agg(
        first_of("ts").alias("first_seen"), last_of("ts").alias("last_seen"), F.count("*").alias("event_count"),
        (F.max("session_index") + 1).alias("session_count"), first_of("event_label").alias("first_event"),
        first_of("content_label", entered).alias("first_content"),
        first_of("event_label", is_failure()).alias("first_failure"), first_of("group", is_failure()).alias("first_failure_group"),
        first_of("product_label", is_purchase()).alias("first_purchase_product"), *_money(),
        last_of("event_label").alias("last_event"), last_of("group").alias("last_group"), last_of("event_type").alias("last_event_type"))


def failure_contexts(ordered: DataFrame) -> DataFrame:
    """Failures by group, and how many of their users tried again.

    A user tried again if any event of the group comes after the user's first
    failure in it: two small aggregates meet, the events never meet themselves.
    """
    failed = ordered.where(is_failure()).groupBy(
        "uid", F.coalesce(filled(F.col("group")), filled(F.col("content_label")), F.lit("unknown")).alias("group")).agg(
        F.min(AT).alias("first_failure"), F.count("*").alias("failures"))
    latest = ordered.where("group is not null").groupBy("uid", "group").agg(F.max(AT).alias("latest"))
    return failed.join(latest, ["uid", "group"], "left").groupBy("group").agg(
        F.count("*").alias("failure_users"), F.sum("failures").alias("failure_events"),
        F.count_if(F.col("latest") > F.col("first_failure")).alias("retry_users"),
    ).withColumn("retry_after_failure_rate", ratio(F.col("retry_users"), F.col("failure_users")))


def purchases_with_past(ordered: DataFrame, events: int = LOOKBACK_EVENTS, minutes: float = LOOKBACK_MINUTES) -> DataFrame:
    """Every purchase with the events that came shortly before it, in order."""
    past = Window.partitionBy("uid").orderBy(AT).rowsBetween(-events, -1)
    entry = F.struct(F.col(AT).alias("prior_index"), F.col("ts"), F.col("event_label"), F.col("group").alias("content_group"))
    limit = F.col("ts") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(int(minutes)), F.lit((minutes % 1) * 60))
    near = F.filter("past", lambda p: F.col("ts").isNull() | p["ts"].isNull() | (p["ts"] >= limit))
    return ordered.withColumn("past", F.collect_list(entry).over(past)).where(is_purchase()).select(
        "uid", F.col(AT).alias("purchase_index"), "session_id", "ts", "event_label",
        F.coalesce(filled(F.col("product_label")), F.col("product_id")).alias("product"), "amount", near.alias("past"))


def prior_events(ordered: DataFrame, events: int = LOOKBACK_EVENTS, minutes: float = LOOKBACK_MINUTES) -> DataFrame:
    """A row for every purchase and event shortly before it."""
    return purchases_with_past(ordered, events, minutes).withColumn("p", F.explode("past")).select(
        "uid", "purchase_index", "product", "amount", "p.event_label", "p.content_group", "p.prior_index")


def top_prior(prior: DataFrame, column: str, limit: int = 10) -> DataFrame:
    """The most frequent labels or groups before purchases."""
    return prior.where(F.col(column) != "").groupBy(F.col(column).alias("value")).count().orderBy(
        F.col("count").desc(), "value").limit(limit)


def product_contexts(prior: DataFrame, limit: int = 5) -> DataFrame:
    """The most frequent groups before purchases of each product."""
    counted = prior.where((F.col("content_group") != "") & (F.col("product") != "")).groupBy("product", "content_group").count()
    place = F.row_number().over(Window.partitionBy("product").orderBy(F.col("count").desc(), "content_group"))
    return counted.withColumn("place", place.cast("long")).where(F.col("place") <= limit)


def purchase_examples(ordered: DataFrame, limit: int = 10, **past: float) -> DataFrame:
    """The first purchases by user and order, with the labels before each."""
    return purchases_with_past(ordered, **past).orderBy("uid", "purchase_index").limit(limit).select(
        "uid", "purchase_index", "product", "amount",
        F.filter(F.transform("past", lambda p: p["event_label"]), lambda x: x.isNotNull()).alias("previous_events"))


def revenue_after_content(ordered: DataFrame) -> DataFrame:
    """Each purchase shared by the groups its session has seen so far.

    A session's groups are gathered once, with the place where each began;
    purchases meet them on the partitioning by user that both have already.
    """
    groups = _session_groups(ordered)
    bought = ordered.where(is_purchase()).select("uid", "session_index", AT, "amount")
    seen = F.filter("groups", lambda g: g["first"] <= F.col(AT))
    return (
        bought.join(groups, ["uid", "session_index"]).withColumn("seen", seen).where(F.size("seen") > 0)
        .select((F.coalesce("amount", F.lit(0.0)) / F.size("seen")).alias("share"), F.explode("seen.group").alias("group"))
        .groupBy("group").agg(F.sum("share").alias("revenue_after_content")))
