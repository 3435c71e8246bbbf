"""Summaries and health of content, products and users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import ratio
from .facts import failure_contexts, is_failure, is_purchase, product_contexts, revenue_after_content


def _rates(df: DataFrame) -> DataFrame:
    return df.select(
        *[c for c in ("date",) if c in df.columns], "active_users", "events",
        F.coalesce("sessions", F.lit(0)).cast("long").alias("sessions"),
        F.round(F.coalesce("avg_session_duration_sec", F.lit(0.0)), 2).alias("avg_session_duration_sec"),
        F.round("revenue", 2).alias("revenue"), "paying_users",
        ratio(F.col("paying_users"), F.col("active_users"), 4).alias("conversion_rate"),
        ratio(F.col("revenue"), F.col("paying_users"), 2).alias("arppu"))


def _events(df: DataFrame, *keys: str) -> DataFrame:
    """Counts by the keys; users are counted by a first grouping with them,
    so that no event is expanded once for each distinct count."""
    by_user = df.groupBy(*keys, "uid").agg(F.count("*").alias("n"), F.max(is_purchase()).alias("paid"),
                                           F.sum(F.when(is_purchase(), F.col("amount"))).alias("amount"))
    return by_user.groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("events"), F.count("uid").alias("active_users"),
                                      F.count_if("paid").alias("paying_users"), F.round(F.coalesce(F.sum("amount"), F.lit(0.0)), 6).alias("revenue"))


def run_summary(ordered: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row for everything."""
    totals = sessions.agg(F.count("*").alias("sessions"), F.avg("duration_sec").alias("avg_session_duration_sec"))
    return _rates(_events(ordered).crossJoin(totals))


def daily_summary(ordered: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row per day that has events; sessions count on their first day."""
    day = F.to_date("ts").cast("string")
    starts = sessions.where("start is not null").groupBy(F.to_date("start").cast("string").alias("date")).agg(
        F.count("*").alias("sessions"), F.avg("duration_sec").alias("avg_session_duration_sec"))
    return _rates(_events(ordered.where("ts is not null").withColumn("date", day), "date").join(starts, "date", "left"))


def content_facts(ordered: DataFrame) -> DataFrame:
    """Health of every content group, from what each user did in it."""
    waits = (F.col("event_type") == "match_issue") | (F.coalesce("wait_time_sec", F.lit(0.0)) > 0)
    spent, waited = F.nullif("duration_sec", F.lit(0.0)), F.nullif("wait_time_sec", F.lit(0.0))
    sums = {"spent": spent, "wait": F.when(waits, waited), "held": F.when(waits, spent)}
    counts = {"success_events": F.col("event_type") == "content_success", "fail_events": is_failure(), "rewards": F.col("event_type") == "reward_claim",
              "waited": F.col("wait_time_sec") > 0}
    by_user = ordered.where("group is not null").groupBy("group", "uid").agg(
        F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in counts.items()],
        *[f for k, c in sums.items() for f in (F.sum(c).alias(k), F.count(c).alias(f"{k}_n"))])
    mean = lambda k: F.sum(k) / F.nullif(F.sum(f"{k}_n"), F.lit(0))
    base = by_user.groupBy("group").agg(
        F.count("*").alias("participant_users"), F.sum("n").alias("event_count"), mean("spent").alias("avg_duration"),
        F.sum("success_events").alias("success_events"), F.sum("fail_events").alias("fail_events"),
        F.count_if(F.col("rewards") > 0).alias("reward_users"), F.count_if(F.col("success_events") > 0).alias("success_users"),
        mean("wait").alias("wait"), F.sum("waited").alias("waited"), mean("held").alias("wait_duration"))
    active = ordered.agg(F.count_distinct("uid").alias("active_users"))
    return (
        base.crossJoin(active).join(revenue_after_content(ordered), "group", "left")
        .join(failure_contexts(ordered).select("group", "retry_after_failure_rate"), "group", "left")
        .select("group", "participant_users", ratio(F.col("participant_users"), F.col("active_users"), 4).alias("participant_rate"),
                "event_count", F.round(F.round("avg_duration", 6), 2).alias("avg_duration_sec"), "success_events", "fail_events",
                ratio(F.col("fail_events"), F.col("success_events") + F.col("fail_events"), 4).alias("failure_rate"),
                ratio(F.col("reward_users"), F.col("success_users"), 4).alias("reward_claim_rate"),
                F.round(F.round(F.when(F.col("waited") > 0, F.col("wait")).otherwise(F.col("wait_duration")), 6), 2).alias("avg_wait_sec"),
                F.round(F.coalesce("retry_after_failure_rate", F.lit(0.0)), 4).alias("retry_after_failure_rate"),
                F.round(F.round(F.coalesce("revenue_after_content", F.lit(0.0)), 6), 2).alias("revenue_after_content")))


def product_facts(ordered: DataFrame) -> DataFrame:
    """Sales of every product."""
    return ordered.where(is_purchase()).withColumn("product", F.coalesce("product_label", "product_id")).where(
        "product is not null").groupBy("product").agg(
        F.count_distinct("uid").alias("buyers"), F.count("*").alias("purchase_count"),
        F.round(F.sum("amount"), 2).alias("revenue"), F.round(F.round(F.avg("amount"), 6), 2).alias("avg_amount"))


def product_performance(ordered: DataFrame, prior: DataFrame) -> DataFrame:
    """Sales with the groups most seen before them."""
    groups = product_contexts(prior).groupBy("product").agg(F.array_sort(F.collect_list(
        F.struct("place", F.col("content_group").alias("group"), "count"))).alias("found"))
    return product_facts(ordered).join(groups, "product", "left").withColumn(
        "top_context_groups", F.coalesce(F.transform("found", lambda x: F.struct(
            x["group"].alias("group"), x["count"].alias("count"))), F.array())).drop("found")


def buyers(ordered: DataFrame) -> DataFrame:
    return ordered.where(is_purchase()).select("uid").distinct()


def segment_sizes(ordered: DataFrame) -> DataFrame:
    """How many users bought, and how many did not."""
    by_user = ordered.groupBy("uid").agg(F.max(is_purchase()).alias("buyer"))
    return by_user.groupBy(F.when(F.col("buyer"), "buyer").otherwise("non_buyer").alias("segment")).agg(F.count("*").alias("users"))


def segment_group_rates(ordered: DataFrame, limit: int = 10) -> DataFrame:
    """The groups each segment touches most, per user of the segment."""
    by_user = ordered.groupBy("uid", "group").agg(F.count("*").alias("n"), F.max(is_purchase()).alias("bought"))
    segment = F.when(F.max("bought").over(Window.partitionBy("uid")), "buyer").otherwise("non_buyer")
    counted = by_user.withColumn("segment", segment).where("group is not null").groupBy("segment", "group").agg(F.sum("n").alias("count"))
    place = F.row_number().over(Window.partitionBy("segment").orderBy(F.col("count").desc(), "group"))
    return counted.withColumn("place", place.cast("long")).where(F.col("place") <= limit).join(
        segment_sizes(ordered), "segment").select("segment", "group", "count", ratio(F.col("count"), F.col("users"), 4).alias("rate"), "place")


def revenue_by_user(ordered: DataFrame) -> DataFrame:
    return ordered.where(is_purchase()).groupBy("uid").agg(F.sum("amount").alias("revenue"))


def top_spenders(ordered: DataFrame, limit: int = 5) -> DataFrame:
    return revenue_by_user(ordered).orderBy(F.col("revenue").desc(), "uid").limit(limit).select("uid", F.round("revenue", 2).alias("revenue"))


#: Up to this many rows are simply sorted to find the first few per cent.
SORTED = 10_000


def revenue_concentration(ordered: DataFrame, share: float = 0.05, at_once: int = SORTED) -> DataFrame:
    """Shares of revenue of the first payer and of the first few per cent.

    Of very many payers those well above the cut are only summed; a quantile
    that is right to a ten-thousandth leaves a thin band around it. Payers of
    one sum count together there, so what is put in order is different sums.
    """
    paid = revenue_by_user(ordered)
    edges = F.percentile_approx("revenue", F.array(F.lit(1 - share - 0.0005), F.lit(1 - share + 0.0005)), F.lit(10_000))
    payers, total, most, (low, high) = paid.agg(
        F.count("*"), F.sum("revenue"), F.max("revenue"), F.coalesce(edges, F.array(F.lit(0.0), F.lit(0.0)))).first()
    if not payers or not total:
        return ordered.sparkSession.range(1).select(F.lit(0.0).alias("top_1_user_share"), F.lit(0.0).alias("top_5pct_share"))
    top, above, spent = max(1, int(payers * share)), 0, 0.0
    if payers > at_once:
        above, spent = paid.agg(F.count_if(F.col("revenue") > high), F.sum(F.when(F.col("revenue") > high, F.col("revenue")))).first()
        paid = paid.where(F.col("revenue").between(low, high))
    sums = paid.groupBy("revenue").agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy(F.col("revenue").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = F.greatest(F.lit(0), F.least(F.col("n"), F.lit(top - above) - F.col("ahead")))
    rest = sums.withColumn("ahead", ahead).agg(F.sum(taken * F.col("revenue")).alias("rest"))
    return rest.select(F.round(F.lit(most / total), 4).alias("top_1_user_share"),
                       F.round((F.coalesce("rest", F.lit(0.0)) + F.lit(spent or 0.0)) / F.lit(total), 4).alias("top_5pct_share"))


DUPLICATE_KEY = ("uid", "ts", "event_raw", "content_id", "product_id", "amount")


def duplicate_events(events: DataFrame) -> DataFrame:
    """Events beyond the first of those that agree in the identifying columns."""
    return events.groupBy(*DUPLICATE_KEY).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_events"))


def data_quality(raw_rows: int, missing_uid: int, events: DataFrame) -> DataFrame:
    """Counts of what is missing or repeated, and a score of 0 to 1."""
    counts = events.agg(F.count("*").alias("normalized_rows"), F.count_if(F.col("ts").isNull()).alias("missing_timestamp_rows"),
                        F.count_if(F.col("language_source") == "inferred").alias("inferred_rows")).crossJoin(duplicate_events(events))
    known = counts.select(F.lit(raw_rows).cast("long").alias("input_rows"), "normalized_rows",
                          F.lit(missing_uid).cast("long").alias("missing_uid_rows"), "missing_timestamp_rows", "duplicate_events", "inferred_rows")
    whole = F.greatest("input_rows", "normalized_rows", F.lit(1))
    lost = (F.col("missing_uid_rows") * 0.35 + F.col("missing_timestamp_rows") * 0.25 + F.col("duplicate_events") * 0.2
            + F.col("inferred_rows") * 0.2) / whole
    return known.withColumn("quality_score", F.greatest(F.lit(0.0), F.round(1 - lost, 3)))


def content_risk(content: DataFrame) -> DataFrame:
    """Risk of each content group from failures, waits and lacking retries."""
    risk = (F.col("failure_rate") * 0.5 + F.least(F.coalesce("avg_wait_sec", F.lit(0.0)) / 60, F.lit(1.0)) * 0.32
            + (1 - F.col("retry_after_failure_rate")) * 0.18)
    shown = content.where("group <> '상품'")
    most = F.col("most")
    return shown.crossJoin(F.broadcast(shown.agg(F.max("revenue_after_content").alias("most")))).select(
        "group", F.round(risk, 4).alias("risk"),
        F.when(risk >= 0.62, "danger").when(risk >= 0.4, "warning").otherwise("normal").alias("level"),
        F.round(F.when(most > 0, F.col("revenue_after_content") / most).otherwise(0.0), 4).alias("revenue_scale"))


