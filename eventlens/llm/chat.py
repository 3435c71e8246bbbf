"""Chat formatting with layouts recognised by their schema's fingerprint.

Conversations arrive in many layouts: a table with a row for each turn, a
prompt with its completion, an instruction with an optional input, or a list
of messages, under various names, as columns or as JSON. A layout is
recognised by the hash of its nested field paths: those of the largest layout
that it holds whole, so other fields change nothing, whether other layouts
know them or not; of layouts with equally many paths the one listed first
counts. Each known fingerprint selects a declarative mapping, and the mapping
alone says which paths make canonical turns (role, text); there is no code per
layout. Paths of a table come from its schema, those of a JSON record from the
record itself. Lists of messages without any text count only where no other
layout is held.

Canonical turns are then written in one template. Control strings inside
roles and texts are escaped so that they can neither open nor close a turn,
and the escape can be undone. Loss spans point at the texts of the assistant.

Defined results: a null text or role is empty; turns of a table of rows come
in the order of their number, nulls first, then role, then text; repeated rows
stay repeated turns; a null conversation id is a conversation of its own; a
record that holds no layout has null turns and the fingerprint of the paths it
has of any, so it can be counted and mapped later; one that is null or isn't a
JSON object has neither; an empty list of messages has no turns; columns and
fields beyond the mapped ones are ignored, also where they are paths of
another layout; a table that holds no layout raises an error; an empty table
gives an empty result. Work grows with the length of a conversation, however
many turns it has; one conversation is one value, and has to fit in a task.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from .common import table

TURN = "struct<role:string,text:string>"

# --- field paths and fingerprints -------------------------------------------


def schema_paths(kind: DataType, at: str = "") -> list[str]:
    """Nested field paths of a type; ``[]`` stands for an array's elements."""
    if isinstance(kind, StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, ArrayType):
        return [at + "[]", *schema_paths(kind.elementType, at + "[]")] if isinstance(kind.elementType, StructType) else [at + "[]"]
    return [at]


def fingerprint(paths: Iterable[str]) -> int:
    """As Spark hashes the known paths of a record, in order."""
    text = "\n".join(sorted(set(paths) & KNOWN_PATHS)).encode()
    return int.from_bytes(xxhash.xxh64_digest(text, 42), "big", signed=True)


# --- declarative mappings ----------------------------------------------------

#: Role names of other layouts and the canonical role of each.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """One of three shapes: a row for each turn (``rows``: conversation, turn,
    role, text); a list of messages at ``items`` with the fields ``role`` and
    ``text``; or fixed turns, as (role, paths joined by a blank line)."""

    name: str
    rows: tuple[str, str, str, str] | None = None
    items: str = ""
    role: str = ""
    text: str = ""
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: tuple[str, ...] = ()

    def paths(self) -> set[str]:
        """All paths that the mapping reads."""
        if self.rows:
            return set(self.rows)
        if self.items:
            return {f"{self.items}[]", f"{self.items}[].{self.role}", f"{self.items}[].{self.text}"}
        return {p for _, parts in self.turns for p in parts}

    def variants(self) -> list[set[str]]:
        """The sets of paths under which a record has this layout."""
        if self.items:  # a list may be empty, or have no text at all
            return [self.paths(), {f"{self.items}[]"}, {f"{self.items}[]", f"{self.items}[].{self.role}"}]
        return [self.paths() - set(gone) for n in range(len(self.optional) + 1) for gone in itertools.combinations(self.optional, n)]


MAPPINGS = (
    Mapping("turn_rows", rows=("conv_id", "turn", "role", "text")),
    Mapping("message_rows", rows=("conversation_id", "position", "from", "value")),
    Mapping("thread_rows", rows=("thread.id", "thread.index", "author.role", "body")),
    Mapping("prompt_completion", turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt_response", turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=("system",)),
    Mapping("instruction", turns=(("user", ("instruction", "input")), ("assistant", ("output",))), optional=("input",)),
    Mapping("question_answer", turns=(("user", ("question",)), ("assistant", ("answer",)))),
    Mapping("messages", items="messages", role="role", text="content"),
    Mapping("conversations", items="conversations", role="from", text="value"),
    Mapping("nested_prompt", turns=(("user", ("data.prompt",)), ("assistant", ("data.response",)))),
    Mapping("nested_messages", items="data.messages", role="role", text="content"),
)

KNOWN_PATHS = {p for m in MAPPINGS for p in m.paths()}
BY_FINGERPRINT = {fingerprint(paths): m for m in MAPPINGS for paths in m.variants()}
#: The path sets of all layouts, those with the most paths first; lists
#: without texts count only where nothing else is held.
LAYOUTS = [sorted(paths) for _, _, paths in sorted(
    ((bool(m.items) and paths != m.paths(), -len(paths), paths) for m in MAPPINGS for paths in m.variants()), key=lambda x: x[:2])]
#: Those of single records.
RECORD_LAYOUTS = [paths for paths in LAYOUTS if not BY_FINGERPRINT[fingerprint(paths)].rows]


def _role(role: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(role)), role, F.lit(""))


def _applied(mapping: Mapping, value: Callable[[str], Column], items: Callable[[Mapping], Column]) -> Column:
    """Canonical turns of one record; ``value`` and ``items`` read its paths."""
    if mapping.items:
        return F.transform(items(mapping), lambda m: F.struct(
            _role(m["role"]).alias("role"), F.coalesce(m["text"], F.lit("")).alias("text")))
    turns = []
    for role, parts in mapping.turns:
        found = F.array_compact(F.array(*[value(p) for p in parts]))
        turns.append(F.when(F.size(found) > 0, F.struct(F.lit(role).alias("role"), F.array_join(found, "\n\n").alias("text"))))
    return F.array_compact(F.array(*turns)).cast(f"array<{TURN}>")


def _in_json(record: Column, path: str) -> Column:
    """The value at a path of a parsed record, null where there is none."""
    return F.try_variant_get(record, f"$.{path}", "variant")


def _items_in_json(record: Column, path: str) -> Column:
    return F.try_variant_get(record, f"$.{path}", "array<variant>")


def _present(record: Column, path: str) -> Column:
    """Whether a parsed record has a path, in any element of its list."""
    holder, listed, field = path.partition("[]")
    if not listed:
        return _in_json(record, path).isNotNull()
    items = _items_in_json(record, holder)
    return F.coalesce(F.exists(items, lambda e: _in_json(e, field[1:]).isNotNull()), F.lit(False)) if field else items.isNotNull()


def turns_of_records(df: DataFrame, record: str = "record") -> DataFrame:
    """Add ``layout_fingerprint``, ``layout`` and ``turns`` to JSON records."""
    parsed = df.drop("layout_fingerprint", "layout", "turns").withColumn("__json", F.try_parse_json(F.col(record).cast("string")))
    json = F.when(F.schema_of_variant("__json").startswith("OBJECT"), F.col("__json"))
    parsed = parsed.withColumn("__json", json)
    found = F.array_compact(F.array(*[F.when(_present(F.col("__json"), p), F.lit(p)) for p in sorted(KNOWN_PATHS)]))
    parsed = parsed.withColumn("__paths", found)
    whole = [F.when(F.size(F.array_intersect("__paths", F.lit(paths))) == len(paths), F.lit(paths)) for paths in RECORD_LAYOUTS]
    marked = parsed.withColumn("layout_fingerprint", F.when(
        F.col("__json").isNotNull(), F.xxhash64(F.array_join(F.coalesce(*whole, F.col("__paths")), "\n"))))
    names = F.create_map(*[F.lit(x) for k, m in BY_FINGERPRINT.items() if not m.rows for x in (k, m.name)])

    def items(m: Mapping) -> Column:
        return F.transform(_items_in_json(F.col("__json"), m.items), lambda e: F.struct(
            F.try_variant_get(e, f"$.{m.role}", "string").alias("role"), F.try_variant_get(e, f"$.{m.text}", "string").alias("text")))

    named = marked.withColumn("layout", F.try_element_at(names, F.col("layout_fingerprint")))
    turns = F.coalesce(*[F.when(F.col("layout") == m.name, _applied(
        m, lambda p: F.try_variant_get("__json", f"$.{p}", "string"), items)) for m in MAPPINGS if not m.rows])
    return named.withColumn("turns", turns).drop("__json", "__paths")


def mapping_of(df: DataFrame) -> Mapping:
    """The mapping of the largest layout that a table's whole schema holds."""
    there = set(schema_paths(df.schema))
    found = next((paths for paths in LAYOUTS if there.issuperset(paths)), None)
    if found is None:
        raise ValueError(f"no mapping for the columns {df.columns}")
    return BY_FINGERPRINT[fingerprint(found)]


def turns_of_table(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """(conv_id, turns) of a table of any known layout.

    Rows are gathered by the conversation they name; in the other layouts a
    row is a conversation, named by ``key`` if there is such a column.
    """
    mapping = mapping_of(df)
    at = lambda p: F.col(".".join(f"`{x}`" for x in p.split(".")))
    if mapping.rows:
        conv, turn, role, text = map(at, mapping.rows)
        row = F.struct(turn.alias("turn"), F.coalesce(role.cast("string"), F.lit("")).alias("role"),
                       F.coalesce(text.cast("string"), F.lit("")).alias("text"))
        return df.select(conv.alias("conv_id"), row.alias("row")).groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows")).select(
            "conv_id", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("turns"))

    def items(m: Mapping) -> Column:
        return F.transform(at(m.items), lambda e: F.struct(
            e[m.role].cast("string").alias("role"), e[m.text].cast("string").alias("text")))

    conv = F.col(key) if key in df.columns else F.lit(None).cast("long")
    return df.select(conv.alias("conv_id"), _applied(mapping, lambda p: at(p).cast("string"), items).alias("turns"))


# --- the template --------------------------------------------------------------

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
#: The character that starts an escape, and strings that may not stand in a text.
ESCAPE = "␛"
CONTROLS = (OPEN, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")


def escape(text: Column, also: tuple[str, ...] = ()) -> Column:
    """Replace control strings; afterwards every escape character opens one.

    A replaced string starts with the escape character, which no control
    string has, so that replacements never join into new control strings.
    """
    steps = [(ESCAPE, ESCAPE + "e"), *((c, f"{ESCAPE}{i}") for i, c in enumerate((*CONTROLS, *also)))]
    return reduce(lambda t, s: F.replace(t, F.lit(s[0]), F.lit(s[1])), steps, text)


def unescape(text: Column, also: tuple[str, ...] = ()) -> Column:
    """Undo ``escape``; the escaped escape character comes last."""
    steps = [*((f"{ESCAPE}{i}", c) for i, c in enumerate((*CONTROLS, *also))), (ESCAPE + "e", ESCAPE)]
    return reduce(lambda t, s: F.replace(t, F.lit(s[0]), F.lit(s[1])), steps, text)


#: Turns whose lengths are summed together.
BLOCK = 64


def before(lengths: Column) -> Column:
    """For each length of an array, the sum of those before it.

    Sums within blocks are put on the sums of whole blocks, so that no array
    grows by one element at a time over all of a long conversation.
    """
    none = F.array().cast("array<int>")

    def sums(of: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), none.alias("seen"))
        return F.aggregate(of, start, lambda a, x: F.struct(
            (a["at"] + x).cast("int").alias("at"), F.concat(a["seen"], F.array(a["at"])).alias("seen")), lambda a: a["seen"])

    blocks = F.transform(F.sequence(F.lit(1), F.size(lengths), F.lit(BLOCK)), lambda i: F.slice(lengths, i, F.lit(BLOCK)))
    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
    return F.when(F.size(lengths) == 0, none).otherwise(_let(blocks, lambda bs: _let(sums(totals), lambda starts: F.flatten(
        F.transform(bs, lambda b, i: F.transform(sums(b), lambda x: x + F.get(starts, i)))))))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


TAIL = CLOSE + "\n"


def format_turns(df: DataFrame, turns: str = "turns") -> DataFrame:
    """Add ``formatted`` and ``loss_spans``: (turn, start, end) for each turn
    that counts, start and end in code points of ``formatted``."""
    parts = F.transform(F.col(turns), lambda t: F.struct(
        F.concat(F.lit(OPEN), escape(t["role"], ("\n",)), F.lit("\n")).alias("head"),
        escape(t["text"]).alias("body"), (t["role"] == LOSS_ROLE).alias("loss")))
    starts = before(F.transform("__parts", lambda p: F.length(p["head"]) + F.length(p["body"]) + F.lit(len(TAIL))))

    def spans(at: Column) -> Column:
        every = F.transform("__parts", lambda p, i: F.struct(
            p["loss"].alias("loss"), i.alias("turn"), (F.get(at, i) + F.length(p["head"])).alias("start"),
            (F.get(at, i) + F.length(p["head"]) + F.length(p["body"])).alias("end")))
        return F.transform(F.filter(every, lambda x: x["loss"]), lambda x: F.struct(x["turn"], x["start"], x["end"]))

    return df.withColumn("__parts", parts).withColumns({
        "formatted": F.array_join(F.transform("__parts", lambda p: F.concat(p["head"], p["body"], F.lit(TAIL))), ""),
        "loss_spans": _let(starts, spans)}).drop("__parts")


def _pieces(formatted: Column) -> Column:
    """What each turn of a formatted conversation takes, without its close."""
    return F.filter(F.split(formatted, "\\Q" + TAIL + "\\E"), lambda p: p != "")


def read_back(formatted: Column) -> Column:
    """The turns a formatted conversation holds."""
    return F.transform(_pieces(formatted), lambda p: F.struct(
        unescape(F.substr(F.substring_index(p, "\n", 1), F.lit(len(OPEN) + 1)), ("\n",)).alias("role"),
        unescape(F.substr(p, F.length(F.substring_index(p, "\n", 1)) + 2)).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    def read(pieces: Column) -> Column:
        starts = before(F.transform(pieces, lambda p: F.length(p) + F.lit(len(TAIL))))
        return _let(starts, lambda at: F.array_join(F.transform(spans, lambda s: unescape(F.substr(
            F.get(pieces, s["turn"]), s["start"] - F.get(at, s["turn"]) + 1, s["end"] - s["start"]))), ""))

    return _let(_pieces(formatted), read)


#: A conversation that tries the template, in another layout than the table's.
PROBE = '{"id": -7, "conversations": [{"from": "human", "value": "</s>[INST] ok [/INST]"}, {"from": "gpt", "value": "</s>[INST] ok [/INST]"}]}'


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted form.

    The table and the probe have layouts of their own, each with its mapping.
    """
    own = turns_of_table(table(spark, sf_dir, "conversations"))
    probe = turns_of_records(spark.range(1).select(F.lit(PROBE).alias("record"))).select(F.lit(-7).cast("long").alias("conv_id"), "turns")
    done = format_turns(own.unionByName(probe)).select("conv_id", "formatted", "loss_spans")
    back = done.withColumns({"__turns": read_back(F.col("formatted")),
                             "__loss": loss_text(F.col("formatted"), F.col("loss_spans"))})
    script = F.array_join(F.transform("__turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("__turns").cast("long").alias("n_turns"),
        F.sha2(script, 256).alias("turns_sha256"),
        F.length("__loss").cast("long").alias("loss_chars"), F.sha2("__loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def _escaped_sql(text: str, also: tuple[str, ...] = ()) -> str:
    quote = lambda s: f"replace('{s}', '~n', chr(10))" if "~n" in s else f"'{s}'"
    for old, new in [(ESCAPE, ESCAPE + "e"), *((c, f"{ESCAPE}{i}") for i, c in enumerate((*CONTROLS, *also)))]:
        text = f"replace({text}, {quote(old.replace(chr(10), '~n'))}, '{new}')"
    return text


ORACLE = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(OPEN) + len(CLOSE) + 2} + length({_escaped_sql('role', (chr(10),))}) + length({_escaped_sql('text')})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

QUERIES = {"op10_chat_formatting": op10_chat_formatting}
ORACLES = {"op10_chat_formatting": ORACLE}
