"""Chat formatting by schema fingerprints.

A record's nested field paths, written as one shape, are hashed; the fingerprint selects the declared layout
that maps prompt, instruction or message records to turns of ``role`` and ``text``. The shape of typed
columns is known from the schema when the plan is made; records held as JSON text are fingerprinted row by row.
Turns are then written into one text with marks around each turn. Marks and other control strings inside texts
are broken by a backslash after their first character, and backslashes are doubled, so that every text
can be read back exactly.

Defined cases: a null role or text counts as empty; turns of a conversation are ordered by turn number (null
first), then role, then text, repeated rows each being a turn; a record of an unknown layout, or that is no
JSON, keeps its row with null turns; a record without turns is an empty text; other columns are ignored.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmart.llm.common import query, read

# Marks of the template and control strings of other common templates.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
CONTROL = (
    OPEN, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|begin_of_text|>",
    "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>", "<|system|>", "<|user|>", "<|assistant|>",
)
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class ListLayout:
    """A list of messages under ``path``, each with its role and text, perhaps with an order."""

    path: str
    role: str
    text: str
    order: str | None = None
    roles: dict[str, str] = field(default_factory=dict)

    def samples(self) -> list[dict]:
        names = [self.role, self.text, *([self.order] if self.order else [])]
        return [{self.path: [dict.fromkeys(names, "")]}, {self.path: []}]

    def turns(self, at) -> Column:
        kind = ",".join(f"`{n}`:{'bigint' if n == self.order else 'string'}" for n in dict.fromkeys([*([self.order] if self.order else []), self.role, self.text]))
        messages = at(self.path, f"array<struct<{kind}>>")
        messages = F.array_sort(messages) if self.order else messages
        return F.transform(messages, lambda m: _turn(self._role(m[self.role]), m[self.text]))

    def _role(self, role: Column) -> Column:
        return reduce(lambda rest, pair: F.when(role == pair[0], F.lit(pair[1])).otherwise(rest), self.roles.items(), role)


@dataclass(frozen=True)
class FieldLayout:
    """One exchange: each part is a role and the fields whose texts, if not empty, make its turn."""

    parts: tuple[tuple[str, tuple[str, ...]], ...]
    optional: tuple[str, ...] = ()

    def samples(self) -> list[dict]:
        fields = [f for _, names in self.parts for f in names]
        masks = range(1 << len(self.optional))
        left_out = [{o for i, o in enumerate(self.optional) if mask >> i & 1} for mask in masks]
        return [{f: "" for f in fields if f not in out} for out in left_out]

    def turns(self, at) -> Column:
        def turn(role, names):
            texts = F.filter(F.array(*(at(n, "string") for n in names)), lambda x: F.coalesce(x, F.lit("")) != "")
            needed = F.lit(not set(names) <= set(self.optional)) | (F.size(texts) > 0)
            return F.when(needed, _turn(F.lit(role), F.array_join(texts, "\n\n")))

        return F.filter(F.array(*(turn(*part) for part in self.parts)), lambda t: t.isNotNull())


LAYOUTS = (
    ListLayout("turns", "role", "text", order="turn"),
    ListLayout("messages", "role", "content"),
    ListLayout("conversations", "from", "value", roles={"human": "user", "gpt": "assistant"}),
    FieldLayout((("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), ("system",)),
    FieldLayout((("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), ("system",)),
    FieldLayout((("user", ("instruction", "input")), ("assistant", ("output",))), ("input",)),
    FieldLayout((("user", ("question",)), ("assistant", ("answer",)))),
)


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _shape(value) -> str:
    """The nested field paths of a sample or a type, written like the shape of a variant."""
    if isinstance(value, T.StructType):
        value = {f.name: f.dataType for f in value.fields}
    if isinstance(value, T.ArrayType):
        value = [value.elementType]
    if isinstance(value, dict):
        return "OBJECT<" + ", ".join(f"{k}: {_shape(v)}" for k, v in sorted(value.items())) + ">"
    if isinstance(value, list):
        return f"ARRAY<{_shape(value[0])}>" if value else "ARRAY<_>"
    return "_"


def _variant_shape(record: Column) -> Column:
    """The same of a variant: its schema with every type of a leaf blotted out."""
    return F.regexp_replace(F.schema_of_variant(record), r"(: |ARRAY<)(?!OBJECT<|ARRAY<)[A-Z]+(?:\([0-9, ]+\))?(?=[,>]|$)", "$1_")


def fingerprint_of(sample) -> str:
    import hashlib

    return hashlib.md5(_shape(sample).encode()).hexdigest()


def canonical_turns(df: DataFrame, record_col: str, layouts=LAYOUTS) -> DataFrame:
    """Adds ``fingerprint`` and ``turns`` to a frame whose ``record_col`` is a struct or JSON text."""
    kind = df.schema[record_col].dataType
    by_print = {fingerprint_of(s): layout for layout in layouts for s in layout.samples()}
    if isinstance(kind, T.StructType):
        found = fingerprint_of(kind)
        layout = by_print.get(found)
        turns = layout.turns(lambda path, to: F.col(record_col)[path].cast(to)) if layout else F.lit(None).cast(TURNS)
        return df.withColumns({"fingerprint": F.lit(found), "turns": turns})
    at = lambda path, to: F.try_variant_get("_record", f"$.{path}", to)
    parsed = df.withColumn("_record", F.try_parse_json(record_col))
    parsed = parsed.withColumn("fingerprint", F.md5(_variant_shape(F.col("_record"))))
    turns = F.lit(None).cast(TURNS)
    for layout in layouts:
        prints = [fingerprint_of(s) for s in layout.samples()]
        turns = F.when(F.col("fingerprint").isin(prints), layout.turns(at).cast(TURNS)).otherwise(turns)
    return parsed.withColumn("turns", turns).drop("_record")


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROL:
        text = F.replace(text, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(df: DataFrame, turns_col: str = "turns", learned: str = "assistant") -> DataFrame:
    """Adds ``formatted`` and ``loss_spans``: code-point ranges of the texts of the learned role, end exclusive."""
    head = lambda t: F.concat(F.lit(OPEN), F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    pieces = F.transform(
        turns_col, lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == learned).alias("learned"))
    )
    tail = CLOSE + "\n"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc, p):
        begin = acc["at"] + F.char_length(p["head"])
        end = begin + F.char_length(p["body"])
        span = F.array(F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end")))
        spans = F.when(p["learned"], F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((end + len(tail)).cast("long").alias("at"), spans.alias("spans"))

    return (
        df.withColumn("_pieces", pieces)
        .withColumn("formatted", F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"], F.lit(tail))), ""))
        .withColumn("loss_spans", F.aggregate("_pieces", start, step, lambda acc: acc["spans"]))
        .drop("_pieces")
    )


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted text."""
    whole = F.split(formatted, r"<\|im_end\|>\n")
    bodies = F.transform(F.slice(whole, 1, F.size(whole) - 1), lambda b: F.substr(b, F.lit(len(OPEN) + 1)))

    def turn(body):
        role = F.regexp_extract(body, r"^((?:[^\\\n]|\\[\s\S])*+)\n", 1)
        return _turn(unescape(role), unescape(F.substr(body, F.char_length(role) + 2)))

    return F.transform(bodies, turn)


def learned_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped; fixed-width characters make each cut as cheap as it is long."""
    wide = F.encode(formatted, "UTF-32")
    cut = lambda s: F.decode(F.substr(wide, (4 * s["start"] + 1).cast("int"), (4 * (s["end"] - s["start"])).cast("int")), "UTF-32")
    return F.array_join(F.transform(spans, lambda s: unescape(cut(s))), "")


def conversation_records(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows by turn as one record per conversation: ``conv_id`` and ``record`` with its list of turns."""
    one = F.struct(F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    turns = rows.select(F.col(conv).alias("conv_id"), one.alias("one")).groupBy("conv_id").agg(F.collect_list("one").alias("turns"))
    return turns.select("conv_id", F.struct("turns").alias("record"))


#: A conversation whose texts are nothing but control strings, in another layout than the table.
PROBE = {"messages": [{"role": r, "content": "</s>[INST] ok [/INST]"} for r in ("user", "assistant")]}

_ESCAPED = "replace({}, chr(92), chr(92) || chr(92))"
for _c in CONTROL:
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}' || chr(92) || '{_c[1:]}')"


@query(
    f"""
    WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
               UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum({len(OPEN) + len(CLOSE) + 2} + length({_ESCAPED.format("role")}) + length(role) - length(replace(role, chr(10), ''))
               + length({_ESCAPED.format("text")}))::BIGINT AS formatted_chars
    FROM r GROUP BY conv_id
    """
)
def op9_chat_formatting(spark, sf_dir):
    typed = canonical_turns(conversation_records(read(spark, sf_dir, "conversations")), "record")
    probe = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(json.dumps(PROBE)).alias("record"))
    probe = canonical_turns(probe, "record")
    turns = typed.select("conv_id", "turns").unionByName(probe.select("conv_id", "turns"))
    done = format_turns(turns).select("conv_id", "formatted", "loss_spans")
    read_back = done.select(
        "conv_id",
        parse_turns(F.col("formatted")).alias("turns"),
        learned_text(F.col("formatted"), F.col("loss_spans")).alias("learned"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
    as_text = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read_back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(as_text, ""), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
    )
