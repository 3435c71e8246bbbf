"""Meaning of event codes, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import TOKEN_GROUPS, TOKEN_LABELS

NOT_WORD = "[^A-Za-z0-9가-힣]+"


def tokens(raw: Column) -> Column:
    """Parts of a code in lower case; camel case is taken apart."""
    snake = F.regexp_replace(raw, "([a-z0-9])([A-Z])", "$1_$2")
    return F.filter(F.transform(F.split(snake, NOT_WORD), F.lower), lambda t: t != "")


def group_of(raw: Column, content: Column | None = None) -> Column:
    """The content group a code names, else the content itself."""
    text = F.array_join(tokens(raw), " ")
    rules = [F.when(F.contains(text, F.lit(part)), F.lit(group)) for part, group in TOKEN_GROUPS]
    known = content if content is not None else F.lit(None).cast("string")
    return F.coalesce(*rules, F.when((known != "") & (F.lower(known) != "nan"), known))


def _any(found: Column, *names: str) -> Column:
    return F.arrays_overlap(found, F.array(*[F.lit(n) for n in names]))


def event_type_of(raw: Column) -> Column:
    """The kind of event a code names, by its first rule that holds."""
    found = tokens(raw)
    shop = _any(found, "pkg", "package", "shop", "product")
    rules = (
        (_any(found, "purchase", "buy", "pay", "iap"), F.lit("purchase")),
        (_any(found, "click"), F.when(shop, "product_click").otherwise("click")),
        (_any(found, "view"), F.when(shop, "product_view").otherwise("view")),
        (_any(found, "timeout") | (_any(found, "wait") & _any(found, "match")), F.lit("match_issue")),
        (_any(found, "fail", "failed", "lose", "loss"), F.lit("content_fail")),
        (_any(found, "clear", "success", "win"), F.lit("content_success")),
        (_any(found, "claim"), F.lit("reward_claim")),
        (_any(found, "spend"), F.lit("currency_spend")),
        (_any(found, "gain", "earn"), F.lit("currency_gain")),
        (_any(found, "enter", "start", "open"),
         F.when(group_of(raw).isNotNull(), "content_enter").otherwise("session_start")),
        (_any(found, "exit", "end", "drop"), F.lit("exit")),
    )
    return reduce(lambda rest, rule: F.when(rule[0], rule[1]).otherwise(rest), reversed(rules), F.lit("event"))


def readable(raw: Column) -> Column:
    """A label for a code, part by part; the code itself if none is left."""
    table = F.create_map(*[F.lit(x) for pair in TOKEN_LABELS.items() for x in pair])
    parts = F.filter(F.transform(tokens(raw), lambda t: F.coalesce(F.element_at(table, t), t)), lambda t: t != "")
    return F.when(F.size(parts) > 0, F.array_join(parts, " ")).otherwise(raw)


def confidence(source: Column, event_type: Column) -> Column:
    return F.when(source == "dictionary", 1.0).when(event_type == "event", 0.55).otherwise(0.75)
