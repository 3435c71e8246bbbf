"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements
and one bit per failed rule, and is stored without the texts, so that a policy
(a versioned set of rules) is a mask and changing it never reads a text again.
Ablations come from the stored bits alone: which documents a rule rejects, and
which it alone rejects. The bits are counted by value first, and there are few
values, so an ablation is an aggregation over a small table.

Only DataFrame functions run here; the text never leaves the JVM.

Defined results: a null, empty or blank text has no words and every count is
0, so it fails the base rules and ``no_words``. Rows that repeat are judged
one by one. Other columns pass through ``ledger`` untouched, except that a
column with the name of a measurement is replaced. An empty table gives an
empty ledger, and an ablation that counts nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, cut, table, words

#: A window of this many words is compared with the others of its text.
REPEAT_WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """``fails`` is a SQL condition over the measurements of one document."""

    name: str
    fails: str


# The most frequent function words of four languages, for ``few_stop_words``.
STOP_WORDS = ("the be to of and that have with le la les de et un une des que der die und in den von zu das mit el los y en").split()

#: The position of a rule is its bit; new rules are added at the end.
RULES = (
    Rule("too_few_words", "n_words < 20"),
    Rule("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbol_heavy", "10 * n_symbols > n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 25 * n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("stuttering", "100 * n_stutter_words > 30 * n_words"),
    Rule("few_letters", "10 * n_letter_words < 7 * n_words"),
    Rule("bullet_lines", "10 * n_bullet_lines > 9 * n_lines"),
    Rule("ellipsis_lines", "10 * n_ellipsis_lines > 3 * n_lines"),
    Rule("no_words", "n_words = 0"),
    Rule("too_many_words", "n_words > 100000"),
    Rule("mean_word_length", "word_chars < 3 * n_words OR word_chars > 10 * n_words"),
    Rule("few_stop_words", "n_stop_words < 2"),
    Rule("open_lines", "100 * n_closed_lines <= 12 * n_lines"),
    Rule("short_lines", "100 * n_short_lines >= 67 * n_lines"),
    Rule("braces", "n_braces > 0"),
    Rule("placeholder", "n_placeholders > 0"),
)

_FIRST = tuple(rule.name for rule in RULES[:6])
_SECOND = (*_FIRST, "stuttering", "few_letters", "bullet_lines", "ellipsis_lines")

#: Policies by version: the rules that reject a document.
POLICIES = {
    "base": ("too_few_words", "repeated_words"),
    "v1": _FIRST,
    "v2": _SECOND,
    # Short documents are no worse than others; only empty ones go.
    "corpus": (*_SECOND[1:], "no_words"),
    "strict": tuple(rule.name for rule in RULES),
}
#: What ``op8`` and the corpus pipeline decide by.
CURRENT, CORPUS = "v2", "corpus"


def mask(policy: str) -> int:
    """The bits of the rules in ``policy``."""
    bit = {rule.name: 1 << i for i, rule in enumerate(RULES)}
    return sum(bit[name] for name in POLICIES[policy])


def repeated_words(tokens: Column) -> Column:
    """Words inside a window of eight that its text holds more than once.

    Windows are compared by 64-bit hashes, made of those of two halves, which
    are made of those of two quarters, and so on. A text
    without a repeated window, the usual case, needs only the hashes; in
    others the windows are sorted so that equal ones are neighbours, and the
    words under them are counted along their positions.
    """
    size = REPEAT_WINDOW

    def joined(hashes: Column, by: int) -> Column:
        """Each hash with the one ``by`` places on."""
        n = F.size(hashes) - by
        return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(by + 1), n), lambda x, y: F.xxhash64(x, y))

    def windows(hashed: Column) -> Column:
        return _let(_let(joined(hashed, 1), lambda h: joined(h, 2)), lambda h: joined(h, 4))

    def count(found: Column) -> Column:
        return F.when(
            F.size(F.array_distinct(found)) == F.size(found), F.lit(0).cast("long"),
        ).otherwise(_covered(found))

    counted = _let(_let(F.transform(tokens, lambda w: F.xxhash64(w)), windows), count)
    return F.when(F.size(tokens) < size, F.lit(0).cast("long")).otherwise(counted)


def _covered(windows: Column) -> Column:
    size = REPEAT_WINDOW
    ordered = F.array_sort(F.transform(
        windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def with_neighbours(pairs: Column) -> Column:
        n = F.size(pairs)
        return F.array_sort(F.transform(
            F.filter(
                F.transform(pairs, lambda p, k: F.struct(
                    p["i"].alias("i"),
                    ((k > 0) & (F.get(pairs, k - 1)["h"] == p["h"])).alias("before"),
                    ((k < n - 1) & (F.get(pairs, k + 1)["h"] == p["h"])).alias("after"))),
                lambda x: F.coalesce(x["before"], F.lit(False)) | F.coalesce(x["after"], F.lit(False))),
            lambda x: x["i"]))

    def count(starts: Column) -> Column:
        gaps = F.transform(starts, lambda s, k: F.least(
            F.lit(size), F.coalesce(F.get(starts, k + 1) - s, F.lit(size))))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, g: a + g)

    return _let(_let(ordered, with_neighbours), count)


def _let(value: Column, body) -> Column:
    """``body`` over ``value``, which is worked out once."""
    return F.transform(F.array(value), body)[0]


SYMBOLS, BRACES = "#*$%&|<>", "{}"
#: Ends of a line that close a sentence; a short line has fewer characters.
CLOSED, SHORT_LINE = r'[.!?"\x{201d}\x{3002}]$', 30
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutter_words", "n_letter_words", "n_stop_words",
            "n_bullet_lines", "n_ellipsis_lines", "n_closed_lines", "n_short_lines", "n_braces", "n_placeholders")


def _occurrences(text: Column, characters: str) -> Column:
    """How many of the characters a text has."""
    left = text
    for c in characters:
        left = F.replace(left, F.lit(c))
    return F.length(text) - F.length(left)


def measured(text: Column) -> Column:
    """All measurements of a text as one value, for which its words and lines
    are worked out once."""
    body = F.coalesce(text.cast("string"), F.lit(""))
    count_if = lambda values, test: F.size(F.filter(values, test))

    def found(tokens: Column, whole: Column, trimmed: Column) -> Column:
        values = {
            "n_words": F.size(tokens), "word_chars": F.length(F.array_join(tokens, "")), "n_symbols": _occurrences(body, SYMBOLS),
            "n_lines": F.size(whole), "n_dup_lines": F.size(whole) - F.size(F.array_distinct(whole)), "n_repeat_words": repeated_words(tokens),
            "n_stutter_words": count_if(tokens, lambda w, i: (i > 0) & (w == F.get(tokens, i - 1))),
            "n_letter_words": count_if(tokens, lambda w: w.rlike("\\p{L}")),
            "n_stop_words": F.size(F.array_intersect(F.transform(tokens, F.lower), F.array(*[F.lit(w) for w in STOP_WORDS]))),
            "n_bullet_lines": count_if(trimmed, lambda x: x.rlike("^[-*\\x{2022}]")),
            "n_ellipsis_lines": count_if(trimmed, lambda x: x.endswith("...") | x.endswith("\u2026")),
            "n_closed_lines": count_if(trimmed, lambda x: x.rlike(CLOSED)), "n_short_lines": count_if(trimmed, lambda x: F.length(x) < SHORT_LINE),
            "n_braces": _occurrences(body, BRACES), "n_placeholders": F.contains(F.lower(body), F.lit("lorem ipsum")).cast("long")}
        return F.struct(*[values[name].cast("long").alias(name) for name in MEASURES])

    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return _let(words(text), lambda tokens: _let(lines, lambda whole: _let(
        F.transform(whole, lambda x: F.btrim(x, F.lit(SPACES))), lambda trimmed: found(tokens, whole, trimmed))))


def _of_m(condition: str) -> str:
    return re.sub(r"\b(n_\w+|word_chars)\b", r"m.\1", condition)


#: The bits of the rules that a value ``m`` of measurements fails.
_BITS = " + ".join(f"CASE WHEN {_of_m(rule.fails)} THEN {1 << i}L ELSE 0L END" for i, rule in enumerate(RULES))


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """Measurements plus ``failures``, the bits of the rules that failed.

    The bits refer to the measurements once, so that a filter on them, which
    Spark moves below, measures each text once as well.
    """
    book = df.withColumn("__measured", measured(F.col(text)))
    return book.withColumns({"failures": F.expr(f"transform(array(__measured), m -> {_BITS})[0]"), **{n: F.col(f"__measured.{n}") for n in MEASURES}}).drop("__measured")


def store(book: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The ledger as a stored table of its own, without the texts."""
    return cut(book.select(F.col(key), *MEASURES, "failures") if key in book.columns else book.drop(text), "quality-ledger")


def apply_policy(book: DataFrame, policy: str = CURRENT, column: str = "kept") -> DataFrame:
    """Add whether ``policy`` keeps each document of a ledger."""
    return book.withColumn(column, F.col("failures").bitwiseAND(F.lit(mask(policy))) == 0)


def kept(df: DataFrame, policy: str, text: str = "text") -> DataFrame:
    """The rows of ``df`` that ``policy`` keeps, with their own columns."""
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), F.col(text).alias("__text"))
    return apply_policy(ledger(own, "__text"), policy, "__kept").where("__kept").select("__row.*")


def ablation(book: DataFrame, policies: tuple[str, ...] = tuple(POLICIES)) -> DataFrame:
    """One row per policy and rule: documents it rejects, and alone rejects.

    ``together`` has the bits of all rules of the policy that ever fail along
    with it. Reads the bits of a ledger and nothing else.
    """
    values = book.groupBy("failures").agg(F.count("*").alias("n"))
    wanted = [(p, name, 1 << i, mask(p)) for p in policies for i, name in enumerate(r.name for r in RULES) if name in POLICIES[p]]
    rules = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit"), F.lit(m).cast("long").alias("mask"))
                      for p, name, bit, m in wanted])
    nothing = book.sparkSession.range(1).select(F.lit(0).cast("long").alias("failures"), F.lit(0).cast("long").alias("n"))
    each = values.unionByName(nothing).withColumn("r", F.explode(rules)).select(
        "r.policy", "r.rule", "r.bit", F.col("failures").bitwiseAND(F.col("r.mask")).alias("f"), "n")
    fails = F.col("f").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("policy", "rule", "bit").agg(
        F.coalesce(F.sum(F.when(fails, F.col("n"))), F.lit(0)).alias("rejected"),
        F.coalesce(F.sum(F.when(F.col("f") == F.col("bit"), F.col("n"))), F.lit(0)).alias("rejected_alone"),
        F.coalesce(F.bit_or(F.when(fails, F.col("f"))), F.lit(0)).cast("long").alias("together"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its measurements, failure bits and verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    book = apply_policy(apply_policy(ledger(docs), "base", "__base"))
    return book.select("doc_id", *MEASURES, (~F.col("__base")).alias("base_failed"), "kept", "failures")


def op8_rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy rejects, together and alone."""
    return ablation(store(ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))))


_LEDGER_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS body FROM documents
), w AS (
  SELECT doc_id, body,
    list_filter(regexp_split_to_array(body, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), r AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1
), c AS (
  SELECT doc_id, CAST(sum(least(8, coalesce(nxt - i, 8))) AS BIGINT) AS n_repeat_words FROM (
    SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id
), v AS (
  SELECT *, list_transform(lines, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS trimmed FROM w
), m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(body, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(c.n_repeat_words, 0) AS n_repeat_words,
    CAST(len(list_filter(ws, lambda x, i: i > 1 AND x = ws[i - 1])) AS BIGINT) AS n_stutter_words,
    CAST(len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) AS BIGINT) AS n_letter_words,
    CAST(len(list_intersect(list_transform(ws, lambda x: lower(x)), string_split('STOP', ' '))) AS BIGINT) AS n_stop_words,
    CAST(len(list_filter(trimmed, lambda x: regexp_matches(x, '^[-*\x{2022}]'))) AS BIGINT) AS n_bullet_lines,
    CAST(len(list_filter(trimmed, lambda x: ends_with(x, '...') OR ends_with(x, chr(8230)))) AS BIGINT) AS n_ellipsis_lines,
    CAST(len(list_filter(trimmed, lambda x: regexp_matches(x, '[.!?"\x{201d}\x{3002}]$'))) AS BIGINT) AS n_closed_lines,
    CAST(len(list_filter(trimmed, lambda x: length(x) < 30)) AS BIGINT) AS n_short_lines,
    CAST(len(regexp_extract_all(body, '[{}]')) AS BIGINT) AS n_braces, CAST(contains(lower(body), 'lorem ipsum') AS BIGINT) AS n_placeholders
  FROM v AS w LEFT JOIN c ON w.doc_id IS NOT DISTINCT FROM c.doc_id
), f AS (SELECT *, CAST(BITS AS BIGINT) AS failures FROM m)
""".replace("STOP", " ".join(STOP_WORDS)).replace("BITS", " + ".join(f"(CASE WHEN {rule.fails} THEN {1 << i} ELSE 0 END)" for i, rule in enumerate(RULES)))

QUERIES = {"op8_quality_rules": op8_quality_rules, "op8_rule_ablation": op8_rule_ablation}
ORACLES = {
    "op8_quality_rules": _LEDGER_SQL + f"""
SELECT doc_id, {", ".join(MEASURES)}, (failures & {mask("base")}) <> 0 AS base_failed, (failures & {mask(CURRENT)}) = 0 AS kept, failures FROM f
""",
    "op8_rule_ablation": _LEDGER_SQL + f"""
, b AS (SELECT * FROM (VALUES {", ".join(f"('{p}', '{r.name}', {1 << i}, {mask(p)})" for p in POLICIES for i, r in enumerate(RULES) if r.name in POLICIES[p])})
  AS t(policy, rule, bit, mask))
SELECT policy, rule, CAST(bit AS BIGINT) AS bit,
  CAST(count(*) FILTER (WHERE (failures & bit) <> 0) AS BIGINT) AS rejected,
  CAST(count(*) FILTER (WHERE (failures & mask) = bit) AS BIGINT) AS rejected_alone,
  coalesce(bit_or(failures & mask) FILTER (WHERE (failures & bit) <> 0), 0) AS together
FROM b CROSS JOIN f GROUP BY policy, rule, bit
""",
}
