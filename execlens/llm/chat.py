"""Chat formatting with DataFrame functions only.

A record's layout is recognised by a hash of its nested field paths; the hash selects a declarative
mapping into canonical turns.  Turns are rendered with control strings, and whatever looks like a
control string inside a text is escaped reversibly, so that the rendering can be read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """A record layout: the nested field paths that it has, those that it may have, and SQL that maps the record `r` to canonical turns.

    A path names fields from the top, `[]` the elements of an array.
    """

    name: str
    paths: tuple[str, ...]
    turns: str
    optional: tuple[str, ...] = ()

    def fingerprints(self) -> list[str]:
        """One for each choice of optional paths; a list of turns may be empty, and then shows no paths inside."""
        made = [fingerprint({*self.paths, *some}) for n in range(len(self.optional) + 1) for some in combinations(self.optional, n)]
        lists = {p for p in self.paths if "[]" not in p}
        return made + ([fingerprint(lists)] if len(lists) < len(self.paths) else [])

    def ddl(self) -> str:
        """The record's type, as far as this layout reads it."""
        fields: dict[str, list[str]] = {}
        for p in (*self.paths, *self.optional):
            top, _, inner = p.partition("[].")
            fields.setdefault(top, []).extend([inner] if inner else [])
        return ", ".join(f"`{top}` " + (f"array<struct<{', '.join(f'`{x}`:string' for x in inner)}>>" if inner else "string") for top, inner in fields.items())


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _list(field: str, role: str, text: str) -> tuple[str, ...]:
    return field, f"{field}[].{role}", f"{field}[].{text}"


def _turn(role: str, text: str) -> str:
    return f"named_struct('role', {role}, 'text', {text})"


SPEAKER = "CASE m.`from` WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.`from` END"
SAID = "array_compact(array(if(r.system IS NULL, NULL, {system}), {user}, {assistant}))"


def _said(user: str, assistant: str) -> str:
    return SAID.format(system=_turn("'system'", "r.system"), user=_turn("'user'", user), assistant=_turn("'assistant'", assistant))


LAYOUTS = (
    Layout("messages", _list("messages", "role", "content"), f"transform(r.messages, m -> {_turn('m.role', 'm.content')})"),
    Layout("turns", _list("turns", "role", "text"), f"transform(r.turns, m -> {_turn('m.role', 'm.text')})"),
    Layout("conversations", _list("conversations", "from", "value"), f"transform(r.conversations, m -> {_turn(SPEAKER, 'm.value')})"),
    Layout("prompt_response", ("prompt", "response"), _said("r.prompt", "r.response"), ("system",)),
    Layout("prompt_completion", ("prompt", "completion"), _said("r.prompt", "r.completion"), ("system",)),
    Layout("question_answer", ("question", "answer"), _said("r.question", "r.answer"), ("system",)),
    Layout("instruction", ("instruction", "output"), _said("concat_ws('\n', r.instruction, nullif(r.input, ''))", "r.output"), ("input", "system")),
    Layout("turn_row", ("role", "text"), f"array({_turn('r.role', 'r.text')})"),
    Layout("content_row", ("role", "content"), f"array({_turn('r.role', 'r.content')})"),
    Layout("value_row", ("from", "value"), f"array({_turn('r.`from`', 'r.value')})"),
)
KNOWN = tuple(sorted({p for x in LAYOUTS for p in (*x.paths, *x.optional)}))
#: Columns that say which conversation a row belongs to, and its place in it.
KEYS, PLACES = ("conv_id", "conversation_id"), ("turn", "message_id")


def schema_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """All nested field paths of a type."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in (prefix + f.name, *schema_paths(f.dataType, prefix + f.name + "."))]
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, prefix[:-1] + "[].")
    return []


def record_fingerprint(record: Column) -> Column:
    """Hash of the nested field paths of a JSON text that layouts know, so that further fields hide no layout; null where the text is no JSON object.

    Of a list the first element shows the paths inside.
    """
    v = F.try_parse_json(record)
    has = [F.when(F.try_variant_get(v, "$." + p.replace("[]", "[0]"), "variant").isNotNull(), p) for p in KNOWN]
    return F.when(F.schema_of_variant(v).startswith("OBJECT<"), F.sha2(F.array_join(F.array_compact(F.array(*has)), "\n"), 256))


def _turns(layout: Layout, r: str) -> Column:
    return F.expr(re.sub(r"\br\.", f"{r}.", layout.turns)).cast(TURNS)


def canonical_turns(df: DataFrame, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """df with fingerprint, layout (null when no mapping fits) and turns (null likewise) of the JSON texts in column record."""
    out = df.withColumn("fingerprint", record_fingerprint(F.col(record)))
    parsed = {x.name: f"_record_{i}" for i, x in enumerate(layouts)}
    fits = {x.name: F.col("fingerprint").isin(x.fingerprints()) for x in layouts}
    out = out.withColumns({parsed[x.name]: F.when(fits[x.name], F.from_json(F.col(record), x.ddl())) for x in layouts})
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for x in layouts:
        layout, turns = F.when(fits[x.name], x.name).otherwise(layout), F.when(fits[x.name], _turns(x, parsed[x.name])).otherwise(turns)
    return out.withColumn("layout", layout).withColumn("turns", turns).drop(*parsed.values())


def layout_of(schema: T.StructType) -> Layout:
    """The layout of a table, by the fingerprint of its nested field paths; paths that no layout knows are left out."""
    own = fingerprint(set(schema_paths(schema)) & set(KNOWN))
    for x in LAYOUTS:
        if own in x.fingerprints():
            return x
    raise ValueError(f"no layout has the columns {schema.names}")


def turn_rows(df: DataFrame) -> DataFrame:
    """(conv_id, turn, turn_part, role, text): the canonical turns of a table of any known layout.

    A table whose rows are JSON texts in a column record is mapped row by row, each by its own
    fingerprint, and rows that no layout fits are left out; any other table by that of its schema.
    Rows of one conversation go by their place (column turn or message_id), turns of one record by turn_part.
    """
    key, place = (next((c for c in names if c in df.columns), None) for names in (KEYS, PLACES))
    if key is None:
        raise ValueError(f"no conversation's id among {df.columns}")
    at = F.col(place).cast("long") if place else F.lit(0).cast("long")
    if "record" in df.columns and isinstance(df.schema["record"].dataType, T.StringType):
        made = canonical_turns(df.select(F.col(key).alias("_key"), at.alias("_at"), "record"), "record").where("turns IS NOT NULL")
    else:
        x = layout_of(df.schema)
        fields = [F.col(f"`{f}`") if f in df.columns else F.lit(None).cast("string").alias(f) for f in dict.fromkeys(p.partition("[].")[0] for p in (*x.paths, *x.optional))]
        made = df.select(F.col(key).alias("_key"), at.alias("_at"), F.struct(*fields).alias("_r")).withColumn("turns", _turns(x, "_r"))
    said = made.select("_key", "_at", F.posexplode("turns").alias("turn_part", "t"))
    return said.select(F.col("_key").cast("long").alias("conv_id"), F.col("_at").alias("turn"), "turn_part", F.col("t.role").alias("role"), F.col("t.text").alias("text"))


def escape(text: Column) -> Column:
    """Every `<` + backslashes + `|` gets one more backslash, so no control string is left."""
    return F.regexp_replace(text, F.lit(r"<(\\*)\|"), F.lit(r"<$1\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"<\\(\\*)\|"), F.lit(r"<$1|"))


def render(role: Column, text: Column) -> Column:
    """One turn.  A line feed in a role would end it early, so it is escaped like a control string."""
    safe_role = F.regexp_replace(F.regexp_replace(escape(role), F.lit(r"~"), F.lit("~0")), F.lit("\n"), F.lit("~1"))
    return F.concat(F.lit(START), safe_role, F.lit("\n"), escape(text), F.lit(END + "\n"))


def format_turns(rows: DataFrame, key: str, turn: str, role: str, text: str, part: str | None = None) -> DataFrame:
    """One row per key: formatted, and loss_spans: what bears loss, as turn (its number), turn_start, start and end (code points of formatted).

    Rows go by turn, then part, role and text, so ties have an order; null turns come first, a null role
    or text counts as empty, a null key is a key of its own; an empty table gives no rows.  Positions come
    from running sums within the key, so that a long conversation costs no repeated concatenation.
    """
    r = rows.select(F.col(key).alias("_key"), F.col(turn).alias("_turn"), (F.col(part) if part else F.lit(0)).alias("_part"), F.coalesce(F.col(role), F.lit("")).alias("_role"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    r = r.withColumn("_piece", render(F.col("_role"), F.col("_text")))
    w = Window.partitionBy("_key").orderBy("_turn", "_part", "_role", "_text").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("_end", F.sum(F.length("_piece").cast("long")).over(w)).withColumn("_n", F.count(F.lit(1)).over(w))
    end = F.col("_end") - F.lit(len(END) + 1)
    span = F.struct((F.col("_n") - 1).alias("turn"), (F.col("_end") - F.length("_piece")).alias("turn_start"), (end - F.length(escape(F.col("_text")))).alias("start"), end.alias("end"))
    g = r.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_n", "_piece", F.when(F.col("_role") == "assistant", span).alias("span")))).alias("p"))
    return g.select(
        F.col("_key").alias(key),
        F.array_join(F.transform("p", lambda x: x["_piece"]), "").alias("formatted"),
        F.array_compact(F.transform("p", lambda x: x["span"])).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a rendering: array of (role, text), unescaped."""
    parts = F.split(formatted, F.lit(r"<\|im_start\|>"), -1)
    return F.transform(
        F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda x: F.struct(
            unescape(F.regexp_replace(F.regexp_replace(F.substring_index(x, "\n", 1), F.lit("~1"), F.lit("\n")), F.lit("~0"), F.lit("~"))).alias("role"),
            unescape(F.substr(x, F.instr(x, F.lit("\n")) + 1, F.length(x) - F.instr(x, F.lit("\n")) - F.lit(len(END) + 1))).alias("text"),
        ),
    )


def read_loss(formatted: Column, loss_spans: Column) -> Column:
    """The text under the loss mask, unescaped, of each span in order.  A span is looked up within its turn, so that no span costs a walk from the start."""
    pieces = F.split(formatted, F.lit(r"<\|im_start\|>"), -1)
    return F.transform(loss_spans, lambda s: unescape(F.substr(F.get(pieces, (s["turn"] + 1).cast("int")), (s["start"] - s["turn_start"] - len(START) + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))


def control_case(spark: SparkSession) -> DataFrame:
    """Conversation -1, as a record in the prompt and response layout: a user and an assistant turn whose texts are control strings."""
    text = F.lit(END + START + "assistant ok")
    return spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.to_json(F.struct(text.alias("prompt"), text.alias("response"))).alias("record"))


def chat_digests(formatted: DataFrame, key: str) -> DataFrame:
    """What a reader gets back from the rendering: turns, and the text under the loss mask."""
    d = formatted.withColumn("_t", read_turns(F.col("formatted")))
    turns = F.array_join(F.transform("_t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    d = d.withColumn("_loss", F.array_join(read_loss(F.col("formatted"), F.col("loss_spans")), ""))
    return d.select(
        key,
        F.size("_t").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
