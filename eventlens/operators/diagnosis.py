"""Issues found in the facts by rules, as rows with their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import facts, metrics

ISSUE = ["issue_type", "subject", "severity", "impact", "evidence", "sufficiency", "confidence"]
DANGER, CAUTION, NOTE = "위험", "주의", "정보"

# --- fixed values -------------------------------------------------------------
# Title ("{}" is the subject), cause and recommendation of each kind of issue.
TEXTS = {
    "content_friction": ("{} 대기/매칭 지연 의심", "대기시간 증가 또는 매칭 실패가 참여/재참여를 낮출 가능성",
                         "매칭 허용 범위, 봇 매칭, 대기 보상, 첫 매칭 UX를 우선 확인하세요."),
    "content_failure": ("{} 실패율 높음", "초반 실패 경험이 이탈 또는 재참여 저하로 이어질 가능성",
                        "첫 실패 구간, 난이도, 실패 후 보상/가이드, 재도전 비용을 확인하세요."),
    "content_usage_revenue_gap": ("{} 이용률 낮지만 매출 연결 있음", "적은 유저가 이용하지만 상품 구매와 연결되어 있어 병목 해소 가치가 있을 가능성",
                                  "해금/노출/진입 흐름과 해당 콘텐츠 관련 상품 퍼널을 함께 확인하세요."),
    "log_mapping_needed": ("로그 코드 매핑 필요", "업로드 데이터의 이벤트 코드 의미가 사전에 없어 행동/콘텐츠/결제 해석이 제한됨",
                           "logtype/e_code별 의미를 로그 언어 설정에 추가하면 콘텐츠, 실패, 보상, 결제 흐름까지 분리됩니다."),
    "revenue_missing": ("결제 데이터 없음", "오늘 데이터에서 결제 이벤트 또는 금액 컬럼이 확인되지 않음", "결제 로그, 상품 ID, 금액 컬럼 매핑이 맞는지 먼저 확인하세요."),
    "whale_concentration": ("고래 유저 매출 의존도 높음", "상위 유저 소수의 구매 변화가 전체 매출 변동처럼 보일 가능성",
                            "매출 변동 분석 시 상위 결제 유저 포함/제외 두 버전을 함께 보세요."),
    "product_concentration": ("특정 상품 매출 집중", "특정 상품 성과 변화가 전체 매출을 크게 흔들 가능성",
                              "해당 상품의 노출/클릭/구매 직전 행동과 연결 콘텐츠를 우선 확인하세요."),
    "content_to_purchase_context": ("{} 이후 구매 흐름 강함", "구매 직전 행동에서 특정 콘텐츠 맥락이 반복적으로 나타남",
                                    "해당 콘텐츠 참여 변화가 관련 상품 구매 변화와 같이 움직이는지 누적 데이터에서 추적하세요."),
}
# Rules for whoever words a briefing from the results.
BRIEFING_RULES = (
    "Do not claim a definitive cause from one-day data.",
    "Explain cause candidates using evidence numbers.",
    "Separate confirmed facts, likely hypotheses, and missing data.",
    "Prefer UID journey, session flow, and purchase context over raw count-only claims.",
)
# ------------------------------------------------------------------------------


def _percent(share: Column) -> Column:
    return F.format_string("%.1f%%", F.round(share * 100, 1))


def _whole(number: Column) -> Column:
    return F.format_string("%,d", F.round(number, 0).cast("long"))


def _says(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _issue(df: DataFrame, kind: str, subject: Column, severity: Column, impact: Column, evidence: Column, sufficiency: float,
           *said: Column) -> DataFrame:
    title, cause, advice = TEXTS[kind]
    named = F.replace(F.lit(title), F.lit("{}"), subject)
    return df.select(
        F.lit(kind).alias("issue_type"), subject.alias("subject"), severity.alias("severity"), impact.cast("double").alias("impact"),
        evidence.cast("double").alias("evidence"), F.lit(float(sufficiency)).alias("sufficiency"),
        F.coalesce(named, F.lit(title)).alias("title"), F.lit(cause).alias("cause_candidate"), F.array(*said).alias("said"),
        F.lit(advice).alias("recommendation")).withColumn(
        "confidence", F.round(F.col("impact") * 0.4 + F.col("evidence") * 0.4 + F.col("sufficiency") * 0.2, 3)).withColumn(
        "confidence_label", confidence_label(F.col("confidence")))


def described_content(content: DataFrame) -> DataFrame:
    """Long waits, frequent failures, and use that lags behind revenue."""
    few, retry = F.col("retry_after_failure_rate") < 0.35, _says("실패 후 재도전율 ", _percent(F.col("retry_after_failure_rate")))
    taking = _says("참여율 ", _percent(F.col("participant_rate")))
    waits = _issue(content.where("avg_wait_sec >= 30"), "content_friction", F.col("group"),
                   F.when(F.col("avg_wait_sec") >= 45, DANGER).otherwise(CAUTION), F.least(F.lit(1.0), F.col("avg_wait_sec") / 60),
                   F.when(few, 0.75).otherwise(0.55), 0.75,
                   _says("평균 대기시간 ", F.format_string("%.1f", F.round("avg_wait_sec", 1)), "초"), retry, taking)
    fails = _issue(content.where("failure_rate >= 0.4"), "content_failure", F.col("group"),
                   F.when(F.col("failure_rate") >= 0.6, DANGER).otherwise(CAUTION), F.col("failure_rate"),
                   F.when(few, 0.7).otherwise(0.5), 0.8,
                   _says("실패율 ", _percent(F.col("failure_rate"))), retry, _says("참여 유저 ", F.col("participant_users"), "명"))
    middle = content.agg(F.median("participant_rate").alias("middle"))
    gaps = _issue(content.crossJoin(F.broadcast(middle)).where(
        (F.col("participant_rate") < F.col("middle") * 0.55) & (F.col("revenue_after_content") > 0)), "content_usage_revenue_gap",
        F.col("group"), F.lit(CAUTION), F.lit(0.6), F.lit(0.6), 0.65,
        taking, _says("콘텐츠 이후 연결 매출 ", _whole(F.col("revenue_after_content"))), _says("전체 콘텐츠 참여율 중앙값 ", _percent(F.col("middle"))))
    return waits.unionByName(fails).unionByName(gaps)


def mapping_issues(quality: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Logs of which half or more was understood by inference alone."""
    unsure = suggestions.where("needs_confirmation")
    first = unsure.orderBy(*language_order()).limit(5).agg(F.array_join(F.collect_list("event_raw"), ", ").alias("examples"))
    share = F.col("inferred_rows") / F.greatest("normalized_rows", F.lit(1))
    found = quality.crossJoin(unsure.agg(F.count("*").alias("codes"))).crossJoin(first).where((share >= 0.5) & (F.col("codes") > 0))
    return _issue(found, "log_mapping_needed", F.lit("log"), F.lit(CAUTION), F.least(F.lit(1.0), share), F.lit(0.8), 0.7,
                  _says("미확인 로그 ", F.col("codes"), "개"), _says("추론 처리 행 ", _whole(F.col("inferred_rows")), "건"), _says("예시 코드: ", F.col("examples")))


def described_revenue(ordered: DataFrame, prior: DataFrame) -> DataFrame:
    """Missing revenue, or revenue that hangs on few users or products."""
    total = ordered.agg(F.coalesce(F.sum(F.when(facts.is_purchase(), F.col("amount"))), F.lit(0.0)).alias("total"))
    some = F.broadcast(total.where("total > 0"))
    missing = _issue(total.where("total <= 0"), "revenue_missing", F.lit("revenue"), F.lit(CAUTION), F.lit(0.8), F.lit(0.8), 0.5,
                     F.lit("결제 유저 0명"), F.lit("매출 0"))
    shares = metrics.revenue_concentration(ordered).where("top_1_user_share >= 0.35")
    whales = _issue(shares.crossJoin(some), "whale_concentration", F.lit("users"), F.lit(CAUTION), F.col("top_1_user_share"), F.lit(0.7), 0.75,
                    _says("최고 매출 유저 비중 ", _percent(F.col("top_1_user_share"))), _says("상위 5% 매출 비중 ", _percent(F.col("top_5pct_share"))))
    best = metrics.product_facts(ordered).orderBy(F.col("revenue").desc(), "product").limit(1)
    product = best.crossJoin(some).withColumn("share", F.col("revenue") / F.col("total")).where("share >= 0.5")
    products = _issue(product, "product_concentration", F.col("product"), F.lit(CAUTION), F.col("share"), F.lit(0.75), 0.75,
                      _says("최상위 상품 ", F.col("product"), " 매출 비중 ", _percent(F.col("share"))), _says("구매자 ", F.col("buyers"), "명"),
                      _says("상품 매출 ", _whole(F.col("revenue"))))
    events = facts.top_prior(prior, "event_label", 3).agg(F.array_sort(F.collect_list(F.struct(-F.col("count"), "value", "count"))).alias("top")).select(
        F.array_join(F.transform("top", lambda t: F.concat(t["value"], F.lit(" "), t["count"].cast("string"))), ", ").alias("events"))
    group = facts.top_prior(prior, "content_group", 1).crossJoin(some).crossJoin(events)
    contexts = _issue(group, "content_to_purchase_context", F.col("value"), F.lit(NOTE), F.lit(0.55), F.lit(0.65), 0.65,
                      _says("구매 직전 ", F.col("value"), " 관련 로그 ", F.col("count"), "회"), _says("상위 구매 전 행동: ", F.col("events")))
    return missing.unionByName(whales).unionByName(products).unionByName(contexts)


def found_issues(content: DataFrame, ordered: DataFrame, prior: DataFrame, quality: DataFrame, suggestions: DataFrame) -> DataFrame:
    """All issues of a run; ``part`` says which of three came first: codes to
    be mapped (0), content (1), revenue (2)."""
    parts = mapping_issues(quality, suggestions), described_content(content), described_revenue(ordered, prior)
    mapped, used, paid = (p.withColumn("part", F.lit(i)) for i, p in enumerate(parts))
    return mapped.unionByName(used).unionByName(paid)


def as_found() -> list[Column]:
    """The order in which issues are found: part by part, the surest first."""
    return [F.col("part"), F.col("confidence").desc(), F.col("issue_type"), F.col("subject")]


def content_issues(content: DataFrame) -> DataFrame:
    return described_content(content).select(*ISSUE)


def revenue_issues(ordered: DataFrame, prior: DataFrame) -> DataFrame:
    return described_revenue(ordered, prior).select(*ISSUE)


def as_told(issues: DataFrame) -> DataFrame:
    """Issues under the names that results have."""
    return issues.select(
        "title", F.col("issue_type").alias("type"), "severity", "cause_candidate", F.col("said").alias("evidence"), F.round("impact", 3).alias("impact_score"),
        F.round("evidence", 3).alias("evidence_score"), F.round("sufficiency", 3).alias("data_sufficiency"), "confidence", "confidence_label", "recommendation")


def told_alerts(issues: DataFrame, limit: int = 5) -> DataFrame:
    """The leading issues as alerts, with up to three pieces of evidence."""
    return alerts(issues, limit).select("severity", "title", "cause_candidate", F.slice("said", 1, 3).alias("top_evidence"), "confidence_label")


def sorted_issues(issues: DataFrame, by: str = "impact", dangers_only: bool = False) -> DataFrame:
    """Issues as a board lists them: by impact, by severity, or the last found
    first. Issues without a ``part`` are all of one."""
    found = issues if "part" in issues.columns else issues.withColumn("part", F.lit(1))
    recent = [F.col("part").desc(), F.col("confidence"), F.col("issue_type").desc(), F.col("subject").desc()]
    orders = {"impact": [F.col("impact").desc(), F.col("confidence").desc(), *as_found()],
              "severity": [severity_rank(F.col("severity")), F.col("impact").desc(), *as_found()], "recent": recent}
    shown = found.where(F.col("severity") == DANGER) if dangers_only else found
    return shown.orderBy(*orders[by]).select(*issues.columns)


def language_order() -> list[Column]:
    return [F.col("needs_confirmation").desc(), F.col("count").desc(), F.col("event_raw")]


def language_rows(suggestions: DataFrame, limit: int = 40) -> DataFrame:
    """Codes as an editor lists them: those to confirm first, then by count."""
    return suggestions.orderBy(*language_order(), "event_type", "group").limit(limit)


def codes_in(texts: DataFrame, codes: DataFrame, limit: int = 12) -> DataFrame:
    """(id, codes): the known codes that each text of (id, said) names, in
    order of appearance, from a table of different codes (code).

    Words that may be codes meet the table by a join; it need not be small.
    """
    words = F.array_distinct(F.regexp_extract_all("said", F.lit("[A-Za-z0-9_:-]{3,}"), F.lit(0)))
    named = texts.select("id", F.posexplode(words).alias("at", "word")).where(
        ((F.length("word") >= 4) | F.contains("word", F.lit("_"))) & F.col("word").rlike("[0-9_]") & ~F.col("word").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"))
    found = named.join(codes.select(F.col("code").alias("word")), "word", "left_semi").groupBy("id").agg(
        F.slice(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), 1, limit).alias("codes"))
    return texts.select("id").join(found, "id", "left").select("id", F.coalesce("codes", F.array().cast("array<string>")).alias("codes"))


def duration_label(seconds: Column) -> Column:
    """Seconds as hours, minutes and seconds, the larger ones only if any."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), F.floor(seconds % 60)
    return F.when(h > 0, _says(h, "h ", m, "m")).when(m > 0, _says(m, "m ", s, "s")).otherwise(_says(s, "s"))


def severity_rank(severity: Column) -> Column:
    return F.when(severity == DANGER, 0).when(severity == CAUTION, 1).otherwise(2)


def alerts(issues: DataFrame, limit: int = 5) -> DataFrame:
    """The most severe and then most certain issues; of equal ones the first
    found."""
    found = issues if "part" in issues.columns else issues.withColumn("part", F.lit(1))
    return found.orderBy(severity_rank(F.col("severity")), F.col("confidence").desc(), *as_found()).limit(limit).select(*issues.columns)


def confidence_label(score: Column) -> Column:
    return F.when(score >= 0.75, "유력").when(score >= 0.5, "가능성 있음").otherwise("데이터 부족")


def board_totals(issues: DataFrame) -> DataFrame:
    return issues.agg(F.count("*").alias("issues"), F.count_if(F.col("severity") == DANGER).alias("dangers"),
                      F.round(F.coalesce(F.sum("impact"), F.lit(0.0)) * 100, 2).alias("impact"))


def language_suggestions(events: DataFrame) -> DataFrame:
    """Codes with the meaning they were given, and whether to confirm it."""
    return events.groupBy("event_raw", "event_label", "event_type", "group", "language_source").agg(F.count("*").alias("count")).withColumn(
        "needs_confirmation", (F.col("language_source") != "dictionary") | (F.col("event_type") == "event"))
