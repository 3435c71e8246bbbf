"""The whole analysis of raw logs: facts, issues, files and warehouse.

The ordered events are written once, in buckets by user, and everything else
reads them from there: what groups or orders by user needs no shuffle of
events any more. Results of any length are written by Spark as lists of their
own; the JSON document holds at most ``LISTED`` rows of each, in the order
that matters most, beside its total.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Language
from ..functions.values import named
from ..operators import diagnosis, facts, flow, metrics
from ..operators.sessions import sessionize
from ..sources import exports, files, roles, scratch, warehouse
from .standardize import meant, raw_rows, with_user

SPLIT = ("summary", "language", "issues", "journeys_sample", "sessions_sample", "behavior_flow", "content_health", "product_performance", "purchase_contexts")
ENGINE_VERSION = "0.1.0"
#: Bytes of raw rows to a bucket of events by user.
BUCKET_BYTES = 256 << 20
#: Rows of a list that the JSON document holds; the whole list is beside it.
LISTED = 1000


def load_language(spark: SparkSession, path: object | None) -> Language:
    """The dictionary at a path, or an empty one."""
    if path is None:
        return Language()
    text = "\n".join(r.value for r in spark.read.text(str(path), wholetext=True).collect())
    return Language(json.loads(text.removeprefix("\ufeff")))


@dataclass
class Understood:
    """Raw rows of all inputs by role, and how each table was understood."""

    rows: DataFrame
    tables: list[dict]

    def reports(self) -> list[dict]:
        """How each file was understood, with its rows; from the raw rows as
        they are written, in one grouping."""
        counts = self.rows.groupBy("table", "place").agg(
            F.min("source_file").alias("file"), F.count("*").alias("rows"), F.count_if(F.trim("uid") == "").alias("missing")).orderBy("place", "table").collect()
        return [{"source_file": r.file, "source_sheet": self.tables[r.table]["sheet"], "columns": self.tables[r.table]["columns"],
                 "fields": self.tables[r.table]["fields"], "execution_engine": "spark", "rows": r.rows, "missing_uid_rows": r.missing} for r in counts]


def understand(spark: SparkSession, inputs: Iterable[object], language: Language, work: str | None = None) -> Understood:
    """Read raw logs once: their rows by role are a table that all else reads.

    There is a plan branch for each layout, not for each file; without
    ``work``, a folder for the table, the rows aren't written.
    """
    whole, tables = None, []
    for number, table in enumerate(files.ingest(spark, inputs)):
        columns = [c for c in table.columns if c not in files.OWN]
        found = roles.infer(roles.profile(table.select(*[named(c) for c in columns])), language)
        part = raw_rows(table, found, F.lit(number).alias("table"), F.col("_source_place").alias("place"))
        sheet = table.select("_source_sheet").first() if "_source_sheet" in table.columns else None
        whole = part if whole is None else whole.unionByName(part)
        tables.append({"columns": columns, "fields": found.whole(), "sheet": sheet[0] if sheet else None})
    if whole is None:
        raise ValueError("the inputs hold no table")
    if work:
        whole.write.parquet(f"{work}/raw_rows")
        whole = spark.read.schema(whole.schema).parquet(f"{work}/raw_rows")
    return Understood(whole, tables)


def standard_events(spark: SparkSession, inputs: Iterable[object], language: Language) -> DataFrame:
    """Standard events of all inputs; rows without a user are left in."""
    return meant(understand(spark, inputs, language).rows, language)


def by_user(ordered: DataFrame, folder: str, buckets: int) -> tuple[DataFrame, str]:
    """The events written once, in buckets by user; and the table's name."""
    spark, name = ordered.sparkSession, f"eventlens_{uuid.uuid4().hex}"
    ordered.repartition(buckets, "uid").write.bucketBy(buckets, "uid").sortBy("uid", "user_event_index").option("path", f"{folder}/{name}").saveAsTable(name)
    return spark.table(name), name


def buckets_for(spark: SparkSession, folder: str) -> int:
    """Buckets for the events of a table, by its bytes, and no fewer than the
    session's partitions."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))


def analyse(spark: SparkSession, inputs: Iterable[object], work: str, dictionary: object | None = None, sample: int = 20,
            progress: Callable[[float, str, str], None] | None = None) -> tuple[dict, dict[str, DataFrame], str]:
    """The analysis as a nested result, its tables and lists, and the name of
    the table of events that they read; ``work`` is a folder for it."""
    say = progress or (lambda *_: None)
    say(0.08, "config", "reading the dictionary")
    language = load_language(spark, dictionary)
    say(0.28, "normalize", "standardising events")
    raw = understand(spark, inputs, language, work)
    reports = raw.reports()
    ordered = sessionize(with_user(meant(raw.rows, language)), language.session_gap_minutes)
    events, name = by_user(ordered, work, buckets_for(spark, f"{work}/raw_rows"))
    return *_analysed(spark, events, reports, sample, say, work), name


def _analysed(spark: SparkSession, ordered: DataFrame, reports: list[dict], sample: int, say, work: str) -> tuple[dict, dict]:
    def once(name: str, df: DataFrame) -> DataFrame:
        """A result that several others read, worked out once."""
        df.write.parquet(f"{work}/{name}")
        return spark.read.schema(df.schema).parquet(f"{work}/{name}")

    input_rows, missing_uid = (sum(r[k] for r in reports) for k in ("rows", "missing_uid_rows"))
    say(0.6, "facts", "working out facts")
    sessions, journeys = once("sessions", facts.session_facts(ordered)), once("journeys", facts.user_journeys(ordered))
    failures, prior = once("failures", facts.failure_contexts(ordered)), once("prior", facts.prior_events(ordered))
    content, products = once("content", metrics.content_facts(ordered)), once("products", metrics.product_performance(ordered, prior))
    moved, daily = flow.coded(ordered), once("daily", metrics.daily_summary(ordered, sessions))
    quality = once("quality", metrics.data_quality(input_rows, missing_uid, ordered))
    suggestions = once("suggestions", diagnosis.language_suggestions(ordered))
    contexts = once("contexts", facts.product_contexts(prior))
    rows, totals = exports.records, {}

    def listed(name: str, df: DataFrame, *order) -> list[dict]:
        totals[name] = df.count()
        return rows(df.orderBy(*order).limit(LISTED))

    found_quality = rows(quality)[0]
    payload: dict = {
        "engine_version": ENGINE_VERSION,
        "run_id": uuid.uuid4().hex,
        "summary": rows(metrics.run_summary(ordered, sessions))[0],
        "summary_by_date": {"dates": listed("dates", daily, F.col("date").desc())[::-1], "unknown_timestamp_events": ordered.where("ts is null").count()},
        "data_quality": found_quality | {"files": reports},
        "language": {"suggestions": listed("language_suggestions", suggestions, *diagnosis.language_order()),
                     "needs_confirmation_count": found_quality["inferred_rows"]},
        "content_health": listed("content_health", content, "participant_rate", F.col("revenue_after_content").desc(), "group"),
        "product_performance": listed("product_performance", products, F.col("revenue").desc(), "product"),
        "failure_contexts": listed("failure_contexts", failures, F.col("failure_events").desc(), "group"),
        "purchase_contexts": {
            "top_preceding_events": rows(facts.top_prior(prior, "event_label")), "top_preceding_groups": rows(facts.top_prior(prior, "content_group")),
            "product_contexts": listed("product_contexts", contexts, F.col("count").desc(), "product", "place"),
            "examples": rows(facts.purchase_examples(ordered))},
        "segments": {"sizes": rows(metrics.segment_sizes(ordered)), "group_rates": rows(metrics.segment_group_rates(ordered).orderBy("segment", "place"))},
        "revenue_concentration": rows(metrics.revenue_concentration(ordered))[0] | {"top_users": rows(metrics.top_spenders(ordered))},
        "behavior_flow": {
            "participation": rows(flow.code_participation(moved)), "transition_rates": rows(flow.transition_rates(moved)),
            "loop_patterns": rows(flow.loop_patterns(moved)), "short_interval_repeats": rows(flow.short_interval_repeats(moved)),
            "common_paths": rows(flow.common_paths(moved)), "content_participation": rows(flow.content_participation(moved)),
            "entry_events": rows(flow.end_codes(moved, last=False)), "exit_events": rows(flow.end_codes(moved, last=True)),
            "outliers": rows(flow.outliers(moved)), "user_samples": rows(flow.sequences(moved)), "session_samples": rows(flow.sequences(moved, "session_id"))},
        "journeys_sample": {"total": journeys.count(), "rows": rows(journeys.orderBy("uid").limit(sample))},
        "sessions_sample": {"total": sessions.count(), "rows": rows(sessions.orderBy("session_id").limit(sample))},
    }
    payload["language_suggestions"] = payload["language"]["suggestions"]
    say(0.78, "diagnosis", "looking for issues")
    issues = once("issues", diagnosis.found_issues(content, ordered, prior, quality, suggestions))
    told = diagnosis.as_told(issues)
    payload["issues"] = {"content": listed("issues", diagnosis.as_told(issues.where("part < 2")), *diagnosis.as_found()),
                         "revenue": rows(diagnosis.as_told(issues.where("part = 2")).orderBy(*diagnosis.as_found()))}
    payload["alerts"] = rows(diagnosis.told_alerts(issues))
    payload["ai_context"] = {"briefing_rules": list(diagnosis.BRIEFING_RULES), "top_alerts": payload["alerts"]}
    payload["totals"] = totals
    tables = {"standard_events": ordered.drop("src"), "session_facts": sessions, "user_journeys": journeys, "failure_contexts": failures,
              "purchase_prior_events": prior, "content_facts": content, "product_facts": products, "daily_summaries": daily,
              "language_suggestions": suggestions, "product_contexts": contexts, "issues": told}
    return payload, tables


#: Results of any length that a run writes as lists of their own.
LISTS = {"language_suggestions": "language_suggestions", "product_facts": "product_performance", "failure_contexts": "failure_contexts",
         "product_contexts": "product_contexts", "content_facts": "content_health", "daily_summaries": "summary_by_date", "issues": "issues"}


def run_pipeline(spark: SparkSession, inputs: Iterable[object], out: object, dictionary: object | None = None,
                 run_id: str | None = None, store: str | None = None, sample: int = 20,
                 progress: Callable[[float, str, str], None] | None = None) -> dict:
    """Analyse logs and write the result: JSON, lists, CSV, and the warehouse.

    All paths may be of any file system that Spark reads and writes.
    """
    inputs, folder = [str(i) for i in inputs], str(out).rstrip("/")
    payload, tables, name = analyse(spark, inputs, f"{folder}/work", dictionary, sample, progress)
    try:
        payload["run_id"] = run_id or payload["run_id"]
        for table, label in LISTS.items():
            exports.write_list(tables[table], f"{folder}/lists/{label}")
        exports.write_events_csv(spark.table(name), f"{folder}/normalized_events")
        if store:
            reports = payload["data_quality"]["files"]
            stored = {t: tables[t] for t in warehouse.TABLES if t in tables} | {
                "raw_files": warehouse.raw_files(spark, reports),
                "run_artifacts": warehouse.artifacts(spark, {k: payload[k] for k in (*SPLIT, "alerts", "ai_context", "data_quality")})}
            payload["warehouse"] = {"inserted_rows": warehouse.store_run(
                spark, str(store), payload["run_id"], stored, payload["summary"], [files.name_of(p) for p in files.discover(spark, inputs)])}
        exports.write_json(spark, f"{folder}/analysis.json", payload)
        for part in SPLIT:
            exports.write_json(spark, f"{folder}/{part}.json", payload[part])
    finally:
        spark.sql(f"DROP TABLE {name}")
        scratch.remove(spark, f"{folder}/work")
    return payload
