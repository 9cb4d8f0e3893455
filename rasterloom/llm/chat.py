"""Chat formatting by schema fingerprints, with DataFrame functions only.

Records come as VARIANT values of any layout. A record's fingerprint is a hash of its
nested field paths (types left out). A declarative table maps fingerprints to a layout,
which says where the turns are and which fields hold role and text; its rule turns the
record into canonical turns (role, text). A record with an unknown fingerprint has null
turns and `layout` null, so that it can be reported; it is not dropped.

The template writes a turn as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside texts and
roles every ``<`` + n backslashes + ``|`` gets one more backslash, so that no control
string occurs in them, and reading takes it away again. Line feeds and backslashes of a
role are written ``\\n`` and ``\\\\``.

Defined results: null text or role is empty; role names are kept as they are, with the
names of other systems mapped by `ROLE_NAMES`; turns of a conversation that share a
turn number are ordered by role, then text; a null id is a conversation of its own;
repeated rows are turns of their own; an empty table gives an empty one; work grows in
proportion to a conversation's length; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"

#: Names of roles in other layouts.
ROLE_NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

#: layout: (paths of its fields without types, SQL rule from `record` to turns).
LAYOUTS = {
    "turn_row": ("OBJECT<role, text, turn>", "array(struct({s}role AS role, {s}text AS text))"),
    "messages": ("OBJECT<messages: ARRAY<OBJECT<content, role>>>", "transform(try_variant_get(record, '$.messages', 'array<struct<role:string,content:string>>'), x -> struct(x.role AS role, x.content AS text))"),
    "from_value": ("OBJECT<conversations: ARRAY<OBJECT<from, value>>>", "transform(try_variant_get(record, '$.conversations', 'array<struct<`from`:string,value:string>>'), x -> struct(x.from AS role, x.value AS text))"),
    "prompt_response": ("OBJECT<prompt, response>", "array(struct('user' AS role, {s}prompt AS text), struct('assistant' AS role, {s}response AS text))"),
    "prompt_completion": ("OBJECT<completion, prompt>", "array(struct('user' AS role, {s}prompt AS text), struct('assistant' AS role, {s}completion AS text))"),
    "instruction": ("OBJECT<instruction, output>", "array(struct('user' AS role, {s}instruction AS text), struct('assistant' AS role, {s}output AS text))"),
    "instruction_input": ("OBJECT<input, instruction, output>", "array(struct('user' AS role, concat_ws('\\n\\n', {s}instruction, nullif({s}input, '')) AS text), struct('assistant' AS role, {s}output AS text))"),
    "question_answer": ("OBJECT<answer, question>", "array(struct('user' AS role, {s}question AS text), struct('assistant' AS role, {s}answer AS text))"),
}


def _rule(rule: str) -> str:
    import re

    return re.sub(r"\{s\}(\w+)", r"try_variant_get(record, '$.\1', 'string')", rule)


def field_paths(record: Column) -> Column:
    """The record's nested field paths, without types: its layout's shape."""
    kinds = r"(: )?\b(STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|VOID|DATE|TIMESTAMP(_NTZ)?|BINARY|DECIMAL\(\d+,\d+\))(?=[,>]|$)"
    return F.regexp_replace(F.schema_of_variant(record), kinds, "")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(field_paths(record))


def canonical_turns(rows: DataFrame, record: str = "record") -> DataFrame:
    """Adds `layout` and `turns` (array of role, text) to rows with a VARIANT column."""
    # one fingerprint for each layout: literal table, hashed by the same function
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    names = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
    for name, (paths, rule) in LAYOUTS.items():
        hit = F.col("_fingerprint") == F.xxhash64(F.lit(paths))
        layout = F.when(hit, F.lit(name)).otherwise(layout)
        turns = F.when(hit, F.expr(_rule(rule).replace("record", f"`{record}`") if record != "record" else _rule(rule))).otherwise(turns)
    own = F.col("_fingerprint") == F.xxhash64(F.lit(LAYOUTS["turn_row"][0]))  # its roles stay as they are
    clean = F.transform(
        turns,
        lambda x: F.struct(
            F.coalesce(F.when(~own, names[F.coalesce(x["role"], F.lit(""))]), x["role"], F.lit("")).alias("role"),
            F.coalesce(x["text"], F.lit("")).alias("text"),
        ),
    )
    return rows.withColumn("_fingerprint", fingerprint(F.col(record))).withColumn("layout", layout).withColumn("turns", clean).drop("_fingerprint")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    parts = F.split(unescape(role), r"\\\\")  # between escaped backslashes, \n is a line feed
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def format_turns(turns: Column) -> Column:
    """The formatted text of canonical turns."""
    one = lambda x: F.concat(F.lit(START), escape_role(x["role"]), F.lit("\n"), escape(x["text"]), F.lit(END + "\n"))
    return F.array_join(F.transform(turns, one), "")


#: Turns that are summed together, and code points that are cut together, so that work
#: grows with a conversation's length and not with its square.
SUMMED, CUT = 128, 1024


def _bound(value: Column, body) -> Column:
    """`body` of a value that is evaluated once for the row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(sizes: Column) -> Column:
    """Sums of all elements before each one, in groups of `SUMMED`."""
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    groups = lambda xs: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(xs) / SUMMED).cast("int") - 1)), lambda g: total(F.slice(xs, g * SUMMED + 1, F.lit(SUMMED))))
    befores = lambda sums: F.transform(sums, lambda _, g: total(F.slice(sums, F.lit(1), g)))
    place = lambda i: F.floor(i / SUMMED).cast("int")
    each = lambda xs, before: F.transform(xs, lambda _, i: F.get(before, place(i)) + total(F.slice(xs, place(i) * SUMMED + 1, i % SUMMED)))
    return _bound(sizes, lambda xs: _bound(_bound(groups(xs), befores), lambda before: each(xs, before)))


def loss_spans(turns: Column) -> Column:
    """Code point spans [start, end) of the assistants' texts in the formatted text."""
    head = lambda x: (F.length(escape_role(x["role"])) + F.lit(len(START) + 1)).cast("long")
    body = lambda x: F.length(escape(x["text"])).cast("long")
    sized = F.transform(turns, lambda x: F.struct((x["role"] == "assistant").alias("on"), head(x).alias("head"), body(x).alias("body")))

    def spans(xs: Column) -> Column:
        starts = _running(F.transform(xs, lambda x: x["head"] + x["body"] + F.lit(len(END) + 1)))
        both = F.filter(F.arrays_zip(xs.alias("x"), starts.alias("at")), lambda z: z["x"]["on"])
        return F.transform(both, lambda z: F.struct((z["at"] + z["x"]["head"]).alias("start"), (z["at"] + z["x"]["head"] + z["x"]["body"]).alias("end")))

    return _bound(sized, spans)


def read_back(formatted: Column) -> Column:
    """Canonical turns of a formatted text."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")
    cut = lambda p: F.struct(
        unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.regexp_replace(F.regexp_replace(p, r"^[^\n]*\n", ""), r"<\|im_end\|>\n$", "")).alias("text"),
    )
    return F.transform(pieces, cut)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between. The text is cut
    into pieces once, and a span is cut from its pieces."""
    piece = lambda x: F.floor(x / CUT).cast("int")
    near = lambda pieces, s: F.array_join(F.slice(pieces, piece(s["start"]) + 1, piece(s["end"] - 1) - piece(s["start"]) + 1), "")
    cut = lambda pieces, s: F.when(s["end"] > s["start"], unescape(F.substring(near(pieces, s), (s["start"] % CUT + 1).cast("int"), (s["end"] - s["start"]).cast("int")))).otherwise("")
    pieces = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))
    return _bound(pieces, lambda ps: F.array_join(F.transform(spans, lambda s: cut(ps, s)), ""))


def conversations_from_rows(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Rows by turn, with `turns` of one or more canonical turns, gathered by
    conversation: conv_id and `turns` in order. The rows of one conversation are one
    record of the output, so they meet in one row; nothing larger is gathered."""
    place = F.transform("turns", lambda x, i: F.struct(F.col(turn_col).alias("turn"), i.alias("i"), x["role"].alias("role"), x["text"].alias("text")))
    gathered = rows.select(F.col(conv_col).alias("conv_id"), place.alias("part")).groupBy("conv_id").agg(F.sort_array(F.flatten(F.collect_list("part"))).alias("all"))
    return gathered.select("conv_id", F.transform("all", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def format_conversations(convs: DataFrame) -> DataFrame:
    """Adds `formatted` and `loss` (spans) to rows with `turns`."""
    return convs.withColumn("formatted", format_turns(F.col("turns"))).withColumn("loss", loss_spans(F.col("turns")))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
t AS (
  SELECT conv_id, count(*) AS n_turns,
    coalesce(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text), '') AS all_text,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss_text,
    sum(24 + length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')))::BIGINT AS formatted_chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(all_text) AS turns_sha256, length(loss_text)::BIGINT AS loss_chars,
       sha256(loss_text) AS loss_sha256, formatted_chars FROM t
"""
