"""Chat formatting: layouts, round trips, masks."""

from __future__ import annotations

import hashlib
import json
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SMALL, same_rows
from weftwork.llm import chat

ROWS = "conv_id long, turn long, role string, text string"


def expected(rows) -> dict:
    told = defaultdict(list)
    for r in rows:
        told[r["conv_id"]].append((r["turn"] is not None, r["turn"], r["role"] or "", r["text"] or ""))
    told[-7] = [(True, 0, "user", chat.ADDED_TEXT), (True, 1, "assistant", chat.ADDED_TEXT)]
    out = {}
    for conv, turns in told.items():
        turns.sort(key=lambda t: (t[0], t[1] or 0, t[2], t[3]))
        loss = "".join(x for *_, role, x in turns if role == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), digest("".join(f"{role}\n{x}\n" for *_, role, x in turns)), len(loss), digest(loss))
    return out


def check(spark, df):
    out = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.op8(df).collect()}
    assert out == expected(df.collect())


def test_conversations(spark):
    check(spark, spark.read.parquet(f"{SMALL}/conversations.parquet"))


def test_odd_rows(spark):
    rows = [
        (1, 0, "user", "### user\nhi </turn>\n### assistant\n"), (1, 1, "assistant", None), (1, 1, "assistant", "\\</turn>\\\\ ## ### #\\#"), (2, None, None, "x"), (2, 3, "assistant", "é\U0001f600\n\n"),
        (3, 0, "assistant", ""), (4, 0, "we\nird ### role</turn>\\", "t"), (None, 0, "user", "no id"), (5, 0, "assistant", "<" * 50 + "/turn>" + "#" * 99),
    ]
    check(spark, spark.createDataFrame(rows, ROWS))
    check(spark, spark.createDataFrame([], ROWS))


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system"]), st.text(alphabet="#\\</turn>\n ab\u2028é", max_size=30)), min_size=1, max_size=6), min_size=5, max_size=20))
def test_any_text_comes_back(spark, conversations):
    check(spark, spark.createDataFrame([(c, i, role, text) for c, turns in enumerate(conversations) for i, (role, text) in enumerate(turns)], ROWS))


def test_roles_are_kept_and_layouts_are_found(spark, duck):
    """Roles that another layout has other names for; a question with its answer is a record of fields."""
    rows = [(1, 0, "human", "q"), (1, 1, "bot", "r"), (2, 0, "user", "q"), (2, 1, "assistant", "r"), (3, 0, "system", "s"), (3, 1, "user", "q"), (3, 2, "assistant", "r"), (4, 0, "user", "q"), (4, 1, "assistant", ""), (5, 0, "User", "q"), (5, 1, "gpt", "r")]
    df = spark.createDataFrame(rows, ROWS)
    check(spark, df)
    out = chat.with_turns(chat.conversation_records(df), "record", sample_col="sample")
    assert {r["conv_id"]: r["layout"] for r in out.collect()} == {1: "messages", 2: "prompt_completion", 3: "system_prompt_response", 4: "messages", 5: "messages"}
    same_as_sql = duck.cursor()
    same_as_sql.register("rows", df.toPandas())
    same_as_sql.execute("CREATE TEMP VIEW conversations AS SELECT * FROM rows")
    same_rows(chat.op8(df), same_as_sql, chat.SQL)


def test_clashing_columns(spark):
    df = spark.read.parquet(f"{SMALL}/conversations.parquet")
    more = df.select("*", *[F.lit("own").alias(c) for c in ("record", "sample", "layout", "turns", "messages", "formatted", "loss", "_print", "content")])
    assert sorted(map(tuple, chat.op8(more).collect())) == sorted(map(tuple, chat.op8(df).collect()))


def test_long_patterns(spark):
    """Patterns that repeat a group do not pile up calls: a role of lines, a text of signs."""
    rows = spark.createDataFrame([(1, 0, "r\n", "q"), (1, 1, "assistant", "##</turn>\\")], ROWS)
    long = rows.select("conv_id", "turn", F.when(F.col("turn") == 0, F.repeat("role", F.lit(500_000))).otherwise(F.col("role")).alias("role"), F.repeat("text", F.lit(100_000)).alias("text"))
    check(spark, long)


def test_no_control_string_is_left_in_a_text(spark):
    df = spark.createDataFrame([("a ### b </turn> \\### c \\</turn>",)], "t string")
    r = df.select(chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("back"), "t").first()
    assert "</turn>" not in r["e"] and "##" not in r["e"] and r["back"] == r["t"]


def test_layouts(spark):
    u, a, s = ("user", "q"), ("assistant", "r"), ("system", "s")
    records = [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "r"}]}, "messages", [u, a]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]}, "conversations", [u, a]),
        ({"turns": [{"text": "q", "role": "user"}, {"role": "Bot", "text": "r"}]}, "turns", [u, ("Bot", "r")]),
        ({"conversations": [{"from": "Human", "value": "q"}, {"from": "other", "value": "r"}]}, "conversations", [u, ("other", "r")]),
        ({"completion": "r", "prompt": "q"}, "prompt_completion", [u, a]),
        ({"prompt": "q", "response": "r"}, "prompt_response", [u, a]),
        ({"system": "s", "prompt": "q", "response": "r"}, "system_prompt_response", [s, u, a]),
        ({"question": "q", "answer": "r"}, "question_answer", [u, a]),
        ({"instruction": "q", "output": "r"}, "instruction", [u, a]),
        ({"instruction": "q", "input": "", "output": "r"}, "instruction_input", [u, a]),
        ({"instruction": "i", "input": "q", "output": "r"}, "instruction_input", [("user", "i"), u, a]),
        ({"other": 1}, None, None), ([1], None, None),
    ]
    rows = [(i, json.dumps(r)) for i, (r, *_) in enumerate(records)] + [(100, "{broken"), (101, None)]
    df = spark.createDataFrame(rows, "conv_id long, record string")
    out = {r["conv_id"]: r for r in chat.with_turns(df, "record").collect()}
    for i, (_, layout, turns) in enumerate(records):
        assert out[i]["layout"] == layout
        assert (None if out[i]["turns"] is None else [tuple(t) for t in out[i]["turns"]]) == turns
    assert out[100]["layout"] is None and out[101]["layout"] is None
    made = {r["conv_id"]: r for r in chat.format_records(df).collect()}
    assert len(made) == len(rows) and made[101]["formatted"] == "" and made[0]["formatted"].startswith("### user\nq</turn>\n")


def test_fingerprint_sees_names_and_not_values(spark):
    prints = lambda *rs: [r[0] for r in spark.createDataFrame([(json.dumps(x),) for x in rs], "r string").select(chat.layout_fingerprint(F.col("r"))).collect()]
    a, b, c = prints({"prompt": "x", "completion": "y"}, {"completion": "other", "prompt": ""}, {"prompt": "x", "response": "y"})
    assert a == b != c


def test_a_turn_longer_than_a_variant_takes(spark):
    rows = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], ROWS)
    long = rows.withColumn("text", F.when(F.col("role") == "assistant", F.repeat("text", F.lit(20_000_100))).otherwise(F.col("text")))
    out = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.op8(long).collect()}
    assert out[1] == (2, 20_000_100) and out[-7][0] == 2
