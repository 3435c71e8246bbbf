"""Raw logs to standard events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import FAIL_RESULTS, SUCCESS_RESULTS, TIMEOUT_RESULTS, Language, Roles
from ..functions import lexicon
from ..functions.values import filled, named, number, text, timestamp
from ..sources.scratch import written

STANDARD = ["uid", "ts", "event_raw", "event_label", "event_type", "group", "content_id", "content_label", "content_type", "product_id",
            "product_label", "product_category", "amount", "duration_sec", "wait_time_sec", "result", "source_file", "language_source"]


def result_key(result: Column) -> Column:
    return F.regexp_replace(F.lower(result), "[^a-z0-9가-힣]+", "")


def row_shape_type() -> Column:
    """The type of an event of unknown meaning, by what its row holds."""
    product, content = filled(F.col("product_id")), F.coalesce(filled(F.col("content_id")), filled(F.col("group")))
    key = result_key(F.col("result"))
    return (
        F.when(F.col("event_type") != "event", F.col("event_type"))
        .when(product.isNotNull() & (F.col("amount") > 0), "purchase")
        .when((F.col("wait_time_sec") > 0) | key.isin(*TIMEOUT_RESULTS), "match_issue")
        .when(content.isNotNull() & key.isin(*FAIL_RESULTS), "content_fail")
        .when(content.isNotNull() & key.isin(*SUCCESS_RESULTS), "content_success")
        .when(product.isNotNull(), "product_view").when(content.isNotNull(), "content_enter").otherwise("event"))


def _dictionary(spark: SparkSession, rows: dict[str, dict], names: tuple[str, ...], key: str) -> DataFrame:
    """A dictionary as a table; it is as small as the file it was read from."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (key, *(f"d_{key}_{n}" for n in names))])
    texts = [tuple(None if x is None else str(x) for x in row) for row in Language.as_rows(rows, names)]
    return spark.createDataFrame(texts, schema).dropDuplicates([key])


def raw_rows(raw: DataFrame, roles: Roles, *more: Column) -> DataFrame:
    """The columns of raw rows by role, read as what they are, and ``more``.

    Rows without a user are left in, with a blank uid, so that they can be
    counted; ``with_user`` drops them.
    """
    def of(role: str) -> Column:
        return named(roles[role]) if roles.get(role) else F.lit(None).cast("string")

    return raw.select(
        F.col("_src").alias("src"), F.coalesce(F.trim(of("uid").cast("string")), F.lit("")).alias("uid"), timestamp(of("timestamp")).alias("ts"),
        F.coalesce(text(of("event")), F.lit("event")).alias("event_raw"), text(of("content_id")).alias("content_id"),
        text(of("product_id")).alias("product_id"), number(of("amount")).alias("amount"), number(of("duration_sec")).alias("duration_sec"),
        number(of("wait_time_sec")).alias("wait_time_sec"), text(of("result")).alias("result"), F.col("_source_file").alias("source_file"), *more)


def code_dictionary(codes: DataFrame, language: Language) -> DataFrame:
    """What each different ``event_raw`` of ``codes`` means, once: by the
    dictionary, else by its parts, with the source and how sure it is."""
    configured = _dictionary(codes.sparkSession, language.events, ("label", "event_type", "group", "confidence"), "event_raw").withColumn("known", F.lit(True))
    each = codes.select("event_raw").distinct().join(configured, "event_raw", "left")
    known, code = F.coalesce("known", F.lit(False)), F.col("event_raw")
    return each.select(
        "event_raw", F.when(known, "dictionary").otherwise("inferred").alias("language_source"),
        F.when(known, F.coalesce("d_event_raw_label", code)).otherwise(lexicon.readable(code)).alias("event_label"),
        F.when(known, F.coalesce("d_event_raw_event_type", F.lit("event"))).otherwise(lexicon.event_type_of(code)).alias("code_type"),
        F.when(known, F.col("d_event_raw_group")).otherwise(lexicon.group_of(code)).alias("code_group"),
        F.col("d_event_raw_confidence").try_cast("double").alias("set_by_hand"),
    ).withColumn("confidence", F.coalesce("set_by_hand", lexicon.confidence(F.col("language_source"), F.col("code_type")))).drop("set_by_hand")


def meant(rows: DataFrame, language: Language) -> DataFrame:
    """Standard events of raw rows, by a dictionary of their different codes.

    Each code is classified once, however many rows have it; the dictionaries
    are joined by key, and Spark broadcasts those it knows to be small. That
    of codes is written first, so that its size is known and the rows of a
    frequent code needn't meet in one task.
    """
    spark = rows.sparkSession
    codes = written(code_dictionary(rows, language).drop("confidence"), "codes")
    contents = _dictionary(spark, language.contents, ("label", "type"), "content_id")
    products = _dictionary(spark, language.products, ("label", "category"), "product_id")
    joined = rows.join(codes, "event_raw", "left").join(contents, "content_id", "left").join(products, "product_id", "left")
    known = F.col("language_source") == "dictionary"
    return joined.withColumn("plain_group", F.when(known, F.col("code_group")).otherwise(F.coalesce("code_group", "content_id"))).withColumns({
        "event_type": F.col("code_type"),
        "group": F.when(~known & F.col("d_content_id_label").isNotNull(), F.col("d_content_id_label")).otherwise(F.col("plain_group")),
        "content_label": F.when(F.col("content_id").isNull(), F.col("plain_group")).otherwise(
            F.coalesce("d_content_id_label", "plain_group", "content_id")),
        "content_type": F.col("d_content_id_type"),
        "product_label": F.when(F.col("product_id").isNotNull(), F.coalesce("d_product_id_label", lexicon.readable(F.col("product_id")))),
        "product_category": F.col("d_product_id_category"),
    }).withColumn("event_type", row_shape_type()).select("src", *STANDARD)


def standardize(raw: DataFrame, roles: Roles, language: Language) -> DataFrame:
    """Standard events, with ``src`` from the raw rows' ``_src``."""
    return meant(raw_rows(raw, roles), language)


def with_user(events: DataFrame) -> DataFrame:
    return events.where("trim(uid) <> ''")
