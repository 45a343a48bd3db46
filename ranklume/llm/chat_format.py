"""Chat formatting by schema fingerprints; DataFrame functions only.

A layout is known by the hash of its nested field paths. A registry maps each
known fingerprint to declarative expressions that give canonical turns
``array<struct<role, text>>``; the turns are then written in one template,
in which control strings of the texts are escaped reversibly.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import unused

#: The template: OPEN role MID text CLOSE for each turn. No escaped role or text has '#' or '<', no escaped role has ':'.
OPEN, MID, CLOSE = "### ", ": ", "</turn>\n"
#: Control characters and their escapes. The backslash is escaped first and restored last.
ESCAPES = [("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c")]
TURNS = "array<struct<role:string,text:string>>"


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths with their leaf types: ``messages[].role:string``."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}".lstrip(".")))
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [f"{at}:{kind.typeName()}"]


def fingerprint(kind: T.DataType) -> str:
    """Hash of the field paths; the order of fields does not matter."""
    return hashlib.sha256("\n".join(field_paths(kind)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Layout:
    """A schema in DDL and the SQL expression that gives TURNS from its fields; {p} stands before a field's name."""

    name: str
    ddl: str
    turns: str

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.ddl)


def _said(role: str, text: str) -> str:
    return f"named_struct('role', {role}, 'text', {text})"


#: The layouts that are known.
LAYOUTS = [
    Layout("prompt_response", "prompt string, response string", f"array({_said("'user'", '{p}prompt')}, {_said("'assistant'", '{p}response')})"),
    Layout("prompt_completion", "prompt string, completion string", f"array({_said("'user'", '{p}prompt')}, {_said("'assistant'", '{p}completion')})"),
    Layout("question_answer", "question string, answer string", f"array({_said("'user'", '{p}question')}, {_said("'assistant'", '{p}answer')})"),
    Layout("instruction_output", "instruction string, output string", f"array({_said("'user'", '{p}instruction')}, {_said("'assistant'", '{p}output')})"),
    Layout("instruction_input_output", "instruction string, input string, output string", f"array({_said("'user'", "concat_ws('\\n\\n', {p}instruction, nullif({p}input, ''))")}, {_said("'assistant'", '{p}output')})"),
    Layout("system_prompt_response", "system string, prompt string, response string", f"array({_said("'system'", '{p}system')}, {_said("'user'", '{p}prompt')}, {_said("'assistant'", '{p}response')})"),
    Layout("messages", "messages array<struct<role:string,content:string>>", f"transform({{p}}messages, m -> {_said('m.role', 'm.content')})"),
    Layout("system_messages", "system string, messages array<struct<role:string,content:string>>", f"concat(array({_said("'system'", '{p}system')}), transform({{p}}messages, m -> {_said('m.role', 'm.content')}))"),
    Layout("from_value", "conversations array<struct<from:string,value:string>>", f"transform({{p}}conversations, m -> {_said("case m.`from` when 'human' then 'user' when 'gpt' then 'assistant' else m.`from` end", 'm.value')})"),
    Layout("message_parts", "messages array<struct<role:string,content:array<struct<type:string,text:string>>>>", f"transform({{p}}messages, m -> {_said('m.role', "array_join(transform(filter(m.content, q -> q.type = 'text'), q -> q.text), '')")})"),
    Layout("turn_rows", "turns array<struct<turn:bigint,role:string,text:string>>", f"transform(array_sort({{p}}turns), m -> {_said('m.role', 'm.text')})"),
]


def known_paths(paths: tuple[str, ...]) -> str:
    """The fingerprint of a set of field names, of which only those that some layout has are given."""
    return hashlib.sha256(",".join(sorted(paths)).encode()).hexdigest()


def named_fields(kind: T.DataType, at: str = "") -> list[str]:
    """Names of fields at any depth, without types: ``messages[].role``. Parts of a content count as the content itself."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in [f"{at}.{f.name}".lstrip("."), *(named_fields(f.dataType, f"{at}.{f.name}".lstrip(".")) if f.name != "content" else [])])
    return named_fields(kind.elementType, f"{at}[]") if isinstance(kind, T.ArrayType) else []


def known_fields() -> list[str]:
    """Every field that some layout has: what a payload has beside them changes no fingerprint."""
    return sorted({p for x in LAYOUTS for p in named_fields(x.schema)})


def _text(content: Column) -> Column:
    """A message's content: a string, or the texts of its parts of type text, joined."""
    parts = F.try_variant_get(content, "$", "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(parts, lambda q: q["type"] == "text"), lambda q: q["text"]), "")
    return F.when(F.schema_of_variant(content).startswith("ARRAY"), joined).otherwise(F.try_variant_get(content, "$", "string"))


def _said_in(value: Column, x: Layout) -> Column:
    """TURNS of a parsed payload by a layout's mapping; of messages each content may be a string or parts."""
    arrays = {f.name for f in x.schema.fields if f.name == "messages"}
    fields = [F.try_variant_get(value, f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in x.schema.fields if f.name not in arrays]
    if arrays:
        mixed = F.try_variant_get(value, "$.messages", "array<struct<role:string,content:variant>>")
        fields.append(F.transform(mixed, lambda m: F.struct(m["role"].alias("role"), _text(m["content"]).alias("content"))).alias("messages"))
    return F.element_at(F.transform(F.array(F.struct(*fields)), lambda p: _mapped(x, p)), 1)


def _mapped(x: Layout, p: Column) -> Column:
    """A layout's mapping over a struct of its fields."""
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("text"))
    if x.name in PAIRS:
        return F.array(*[said(role, p[f]) for role, f in PAIRS[x.name]])
    if x.name == "instruction_input_output":
        asked = F.concat_ws("\n\n", p["instruction"], F.nullif(p["input"], F.lit("")))
        return F.array(said("user", asked), said("assistant", p["output"]))
    if x.name == "from_value":
        names = F.create_map(*[F.lit(v) for kv in SPEAKERS.items() for v in kv])
        return F.transform(p["conversations"], lambda m: F.struct(F.coalesce(F.try_element_at(names, m["from"]), m["from"]).alias("role"), m["value"].alias("text")))
    if x.name == "turn_rows":
        return F.transform(F.array_sort(p["turns"]), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text")))
    turns = F.transform(p["messages"], lambda m: F.struct(m["role"].alias("role"), m["content"].alias("text")))
    return F.concat(F.array(said("system", p["system"])), turns) if x.name == "system_messages" else turns


#: Layouts of single fields, with the role of each, and other names of roles.
PAIRS = {
    "prompt_response": (("user", "prompt"), ("assistant", "response")),
    "prompt_completion": (("user", "prompt"), ("assistant", "completion")),
    "question_answer": (("user", "question"), ("assistant", "answer")),
    "instruction_output": (("user", "instruction"), ("assistant", "output")),
    "system_prompt_response": (("system", "system"), ("user", "prompt"), ("assistant", "response")),
}
SPEAKERS = {"human": "user", "gpt": "assistant"}


def canonical_turns(df: DataFrame, payload: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns, ``layout`` (the mapping's name) and ``turns``, the rows' canonical turns.

    payload None: the schema of df without ``keep`` is fingerprinted, and one mapping serves all rows; an unknown
    layout raises ValueError. payload: a column of JSON strings in mixed layouts, fingerprinted row by row from the
    names of those of its fields that some layout has; other fields are ignored, an empty array of messages is one without
    turns, and unknown or broken JSON gives null for both. Null arrays of turns stay null; null roles
    and texts become empty ones; turns of equal number are ordered by role, then text.
    """
    if payload is None:
        kind = T.StructType([f for f in df.schema.fields if f.name not in keep])
        found = {fingerprint(x.schema): x for x in LAYOUTS}.get(fingerprint(_widened(kind)))
        if found is None:
            raise ValueError(f"no mapping for the layout {field_paths(kind)}")
        return df.select(*keep, F.lit(found.name).alias("layout"), _filled(F.expr(found.turns.format(p=""))).alias("turns"))
    value, key = unused(df, "parsed"), unused(df, "print")
    out = df.withColumn(value, F.try_parse_json(payload))
    there = [F.when(F.try_variant_get(value, "$." + name.replace("[]", "[0]"), "variant").isNotNull(), name) for name in known_fields()]
    out = out.withColumn(key, F.sha2(F.concat_ws(",", *there), 256))
    turns, layout = F.lit(None).cast(TURNS), F.lit(None).cast("string")
    for x in reversed(LAYOUTS):
        names = named_fields(x.schema)
        prints = {known_paths(tuple(names)), known_paths(tuple(n for n in names if "[]" not in n))}
        known = F.col(key).isin(*sorted(prints))
        turns, layout = F.when(known, _said_in(F.col(value), x)).otherwise(turns), F.when(known, F.lit(x.name)).otherwise(layout)
    return out.select(*keep, layout.alias("layout"), _filled(turns).alias("turns"))


def _widened(kind: T.StructType) -> T.StructType:
    """Integer leaves count as long ones."""

    def wide(x: T.DataType) -> T.DataType:
        if isinstance(x, T.StructType):
            return T.StructType([T.StructField(f.name, wide(f.dataType)) for f in x.fields])
        if isinstance(x, T.ArrayType):
            return T.ArrayType(wide(x.elementType))
        return T.LongType() if isinstance(x, (T.IntegerType, T.ShortType, T.ByteType)) else x

    return wide(kind)


def _filled(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))


def escaped(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def formatted(df: DataFrame, turns: str = "turns", learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """df with ``formatted`` and ``loss_spans``, the places (start from 0, length; code points) of texts to learn from.

    Both come from one pass over the turns; null turns give an empty string and no spans.
    """
    parts = F.transform(F.coalesce(F.col(turns), F.array().cast(TURNS)), lambda t: F.struct(F.concat(F.lit(OPEN), escaped(t["role"]), F.lit(MID)).alias("head"), escaped(t["text"]).alias("body"), t["role"].isin(*learned).alias("learn")))
    held = unused(df, "parts")
    out = df.withColumn(held, parts)
    out = out.withColumn("formatted", F.array_join(F.transform(held, lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), ""))
    begun = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        span = F.array(F.struct(start.cast("long").alias("start"), F.length(p["body"]).cast("long").alias("length")))
        return F.struct((start + F.length(p["body"]) + len(CLOSE)).cast("long").alias("at"), F.when(p["learn"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return out.withColumn("loss_spans", F.aggregate(held, begun, step)["spans"]).drop(held)


def turns_of(text: Column) -> Column:
    """Turns read back from a formatted string."""
    pieces = F.filter(F.split(text, CLOSE, -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        cut = F.instr(p, MID)
        return F.struct(unescaped(F.substring(p, F.lit(len(OPEN) + 1), cut - len(OPEN) - 1)).alias("role"), unescaped(F.substring(p, cut + len(MID), F.length(p))).alias("text"))

    return F.transform(pieces, turn)


def masked_text(text: Column, spans: Column) -> Column:
    """All unescaped text under the loss mask, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(text, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
