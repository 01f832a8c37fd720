"""Chat formatting: fingerprints of record layouts select mappings to canonical turns; a reversible template."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.llm.common import running_spans

#: Names that the layout with "from" gives the roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "chatgpt": "assistant", "bot": "assistant", "model": "assistant"}
#: Declarative mappings by layout. "turns": an array and its role and text fields; "roles": other names of roles, any
#: case, where a layout has them; "fields": fields and their roles, in order; empty ones give no turn. A layout is
#: known by the field paths of a record of its kind.
LAYOUTS = {
    "messages": {"turns": ("messages", "role", "content")},
    "conversations": {"turns": ("conversations", "from", "value"), "roles": ROLE_NAMES},
    "turns": {"turns": ("turns", "role", "text")},
    "prompt_completion": {"fields": (("prompt", "user"), ("completion", "assistant"))},
    "prompt_response": {"fields": (("prompt", "user"), ("response", "assistant"))},
    "system_prompt_response": {"fields": (("system", "system"), ("prompt", "user"), ("response", "assistant"))},
    "question_answer": {"fields": (("question", "user"), ("answer", "assistant"))},
    "instruction": {"fields": (("instruction", "user"), ("output", "assistant"))},
    "instruction_input": {"fields": (("instruction", "user"), ("input", "user"), ("output", "assistant"))},
    "system_instruction": {"fields": (("system", "system"), ("instruction", "user"), ("output", "assistant"))},
}
#: A turn is HEAD, its role, a newline, its text and TAIL.
HEAD, TAIL = "### ", "</turn>\n"
HEADER = r"^### ((?:[^\\\n]++|\\(?s:.))*+)\n"
#: The conversation that the query adds: control strings as plain text.
ADDED_ID, ADDED_TEXT = -7, r"\### Assistant: </turn> ok"


def escaped(text: Column) -> Column:
    r"""The text with a backslash before each backslash and inside each control string.

    ``\`` becomes ``\\``, ``##`` becomes ``#\#`` and ``</turn>`` becomes ``<\/turn>``: no control string is left,
    and unescaped() gives the text back.
    """
    once = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(F.regexp_replace(once, "#(?=#)", r"#\\"), "<(?=/turn>)", r"<\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def layout_fingerprint(record: Column) -> Column:
    """Hash of the nested field paths of a JSON record, the same whatever its values; null if it is no object.

    The schema of the record as a variant names the fields of every depth in order; its types are taken away.
    """
    shape = F.schema_of_variant(F.try_parse_json(record))
    paths = F.regexp_replace(shape, r"\b(?:DECIMAL\([0-9, ]*\)|[A-Z_]+)(?=[,>]|$)", "")
    return F.when(shape.startswith("OBJECT<"), F.xxhash64(paths))


def sample_record(layout: dict) -> str:
    """A record of the layout, whose fingerprint is looked up."""
    if "turns" in layout:
        array, role, text = layout["turns"]
        return f'{{"{array}":[{{"{role}":"r","{text}":"t"}}]}}'
    return "{" + ",".join(f'"{field}":"t"' for field, _ in layout["fields"]) + "}"


#: Texts of any length are read.
READ = {"maxStringLen": str((1 << 31) - 1)}


def canonical_turns(record: Column, layout: dict) -> Column:
    """Turns (role, text) of a JSON record of the layout; null roles and texts are empty, roles are as they came."""
    if "turns" in layout:
        array, role, text = layout["turns"]
        found = F.from_json(record, f"struct<`{array}`:array<struct<`{role}`:string,`{text}`:string>>>", READ)[array]
        names = F.create_map(*[F.lit(x) for pair in layout.get("roles", {}).items() for x in pair]).cast("map<string,string>")
        name = lambda r: F.coalesce(F.try_element_at(names, F.lower(r)) if "roles" in layout else r, r, F.lit(""))
        return F.transform(found, lambda t: F.struct(name(t[role]).alias("role"), F.coalesce(t[text], F.lit("")).alias("text")))
    fields = F.from_json(record, "struct<" + ",".join(f"`{field}`:string" for field, _ in layout["fields"]) + ">", READ)
    turns = F.array(*[F.struct(F.lit(role).alias("role"), F.coalesce(fields[field], F.lit("")).alias("text")) for field, role in layout["fields"]])
    return F.filter(turns, lambda t: t["text"] != "")


def with_turns(records: DataFrame, record_col: str, layouts: dict[str, dict] = LAYOUTS, sample_col: str | None = None) -> DataFrame:
    """``records`` with layout and turns; both are null where no layout has the record's field paths.

    The paths are read from the record as a variant, which takes up to 128 MB and strings of up to 20 million
    characters, or from ``sample_col``: a small record of the same paths, for records of any size. The table of
    layouts has one row for each mapping and is broadcast.
    """
    spark = records.sparkSession
    rows = [F.struct(F.lit(name).alias("layout"), F.lit(sample_record(layout)).alias("sample")) for name, layout in layouts.items()]
    known = spark.range(1).select(F.inline(F.array(*rows))).select("layout", layout_fingerprint(F.col("sample")).alias("_known"))
    chosen = records.withColumn("_print", layout_fingerprint(F.col(sample_col or record_col))).join(F.broadcast(known), F.col("_print") == F.col("_known"), "left")
    turns = reduce(lambda other, name: F.when(F.col("layout") == name, canonical_turns(F.col(record_col), layouts[name])).otherwise(other), layouts, F.lit(None).cast("array<struct<role:string,text:string>>"))
    return chosen.withColumn("turns", turns).drop("_print", "_known")


def formatted(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t["role"]), escaped(t["text"]), F.lit(TAIL))), "")


def head(role: Column) -> Column:
    return F.concat(F.lit(HEAD), F.regexp_replace(escaped(role), r"\n", "\\\\\n"), F.lit("\n"))


def loss_spans(turns: Column) -> Column:
    """Spans (start, end) of the assistant's escaped texts in the formatted text, in code points."""
    parts = F.transform(
        turns,
        lambda t, i: F.struct(
            (F.when(i > 0, len(TAIL)).otherwise(0) + F.length(head(t["role"]))).cast("long").alias("gap"), F.length(escaped(t["text"])).cast("long").alias("n"), t["role"].alias("m")
        ),
    )
    masked = F.filter(running_spans(parts), lambda s: s["text"] == "assistant")
    return F.transform(masked, lambda s: F.struct(s["start"], s["end"]))


def read_turns(text: Column) -> Column:
    """The turns of a formatted text."""
    whole = F.split(text, TAIL)
    body = F.slice(whole, F.lit(1), F.size(whole) - 1)
    return F.transform(
        body,
        lambda s: F.struct(
            unescaped(F.regexp_extract(s, HEADER, 1)).alias("role"), unescaped(F.substring(s, F.length(F.regexp_extract(s, HEADER, 0)) + F.lit(1), F.length(s))).alias("text")
        ),
    )


def format_records(records: DataFrame, id_col: str = "conv_id", record_col: str = "record", layouts: dict[str, dict] = LAYOUTS, sample_col: str | None = None) -> DataFrame:
    """One row per JSON record: conv_id, layout, formatted, loss (spans under the loss mask).

    Records of no known layout, broken JSON and null have a null layout and an empty text; where samples of the
    records' paths are given, they are an error. Ids may be null or repeat; a layout may have empty texts and no turns
    at all.
    """
    samples = [F.col(sample_col).alias("sample")] if sample_col else []
    turns = with_turns(records.select(F.col(id_col).alias("conv_id"), F.col(record_col).alias("record"), *samples), "record", layouts, "sample" if sample_col else None)
    none = F.raise_error(F.lit("a record has no known layout or cannot be read")) if sample_col else F.array()
    some = F.coalesce(F.col("turns"), none.cast("array<struct<role:string,text:string>>"))
    return turns.select("conv_id", "layout", formatted(some).alias("formatted"), loss_spans(some).alias("loss"))


#: Roles of conversations that are told as fields, and the layout's fields.
TOLD_AS_FIELDS = ((("user", "assistant"), ("prompt", "completion")), (("system", "user", "assistant"), ("system", "prompt", "response")))


def conversation_records(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` as JSON records in order of turn: conv_id, record, sample; nulls are empty.

    Rows of one turn are ordered by role and text, rows without a turn come first. A question and its answer, with a
    system text or without, are told as fields, all other conversations as messages: the layouts of a table differ, and
    what reads the records finds out. A conversation is one record and so is put together in one place.
    The sample has the record's field paths and no texts.
    """
    message = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    told = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("messages"))

    def record(of: Callable[[Column], Column]) -> Column:
        plain = F.transform("messages", lambda m: F.struct(of(m["role"]).alias("role"), of(m["content"]).alias("content")))
        out = F.to_json(F.struct(plain.alias("messages")))
        roles = F.transform("messages", lambda m: m["role"])
        for wanted, fields in TOLD_AS_FIELDS:
            fits = (roles == F.array(*map(F.lit, wanted))) & F.forall("messages", lambda m: m["content"] != "")
            out = F.when(fits, F.to_json(F.struct(*[of(F.get("messages", i)["content"]).alias(f) for i, f in enumerate(fields)]))).otherwise(out)
        return out

    return told.select("conv_id", record(lambda text: text).alias("record"), record(lambda text: F.substring(text, 1, 0)).alias("sample"))


def op8(conversations: DataFrame) -> DataFrame:
    """What comes back from the formatted text of each conversation, and of the one that the query adds.

    Null roles and texts are empty, a null conv_id is a conversation of its own, repeated rows are turns of their own, and
    an empty table gives the added conversation alone. Further columns play no part.
    """
    spark = conversations.sparkSession
    added = spark.range(1).select(F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role")))).alias("t"))
    added = added.select(F.lit(ADDED_ID).cast("long").alias("conv_id"), F.col("t.turn").cast("long").alias("turn"), "t.role", F.lit(ADDED_TEXT).alias("text"))
    out = format_records(conversation_records(conversations.select("conv_id", "turn", "role", "text").unionByName(added)), sample_col="sample")
    turns = read_turns(F.col("formatted"))
    told = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    under = F.array_join(F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    return out.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(under).cast("long").alias("loss_chars"),
        F.sha2(under, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {ADDED_ID}, 0, 'user', '{ADDED_TEXT}' UNION ALL SELECT {ADDED_ID}, 1, 'assistant', '{ADDED_TEXT}'
), e AS (
  SELECT *, length(text) + length(text) - length(replace(text, chr(92), '')) + (length(text) - length(replace(text, '</turn>', ''))) / 7
    + coalesce(list_sum(list_transform(regexp_extract_all(text, '##+'), lambda x: length(x) - 1)), 0) + 4 + length(role) + 1 + 8 AS n FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
