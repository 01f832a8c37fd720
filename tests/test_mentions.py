"""Names in texts, against one regular expression a name."""

from __future__ import annotations

import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftwork import storage
from weftwork.operators import maxscore, mentions

NAMES = ["Ring", "ring bearer", "++", "a", "é", "STRASSE", "straße", "", None, "ring", "the ring", "x" * 300]
TEXTS = ["The ring-bearer's ring; Ring bearer", None, "", "strasse a ++a++ É", "x" * 300 + " " + "x" * 301, "\U0001f600 a \U0001f600 ring", "String rings"]


def plain(names, texts) -> set[tuple]:
    fold = lambda t: (t or "").lower().replace("ß", "ss")
    out = set()
    for i, text in enumerate(texts):
        for name in {fold(n) for n in names} - {""}:
            at = [m.start() for m in re.finditer(rf"(?=(?<![a-z0-9]){re.escape(name)}(?![a-z0-9]))", fold(text))]
            if at:
                out.add((i, name, at[0], len(at)))
    return out


@pytest.mark.parametrize("name_chars", [1 << 20, 40])
def test_odd_names_and_texts(spark, name_chars):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    found = mentions.mentions(texts, spark.createDataFrame([(n,) for n in NAMES], "name string"), name_chars=name_chars)
    assert {tuple(r) for r in found.collect()} == plain(NAMES, TEXTS)


def test_empty_tables(spark):
    texts, names = spark.createDataFrame([(1, "a")], "id long, text string"), spark.createDataFrame([("a",)], "name string")
    assert mentions.mentions(texts.limit(0), names).collect() == [] and mentions.mentions(texts, names.limit(0)).collect() == []


def test_very_many_names(spark):
    names = spark.range(100_000).selectExpr("concat('name ', id, ' of many') as name")
    texts = spark.range(50).selectExpr("id", "concat_ws('; ', transform(sequence(0, 20), i -> concat('Name ', id * 1000 + i, ' of many'))) as text")
    found = mentions.mentions(texts, names).collect()
    assert len(found) == 50 * 21 and all(r["n"] == 1 for r in found)


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text(alphabet="ab- ", min_size=1, max_size=4), min_size=1, max_size=6), st.text(alphabet="ab- ", max_size=30))
def test_places(names, text):
    known = sorted(names)
    got = {(0, known[i], start, n) for i, (start, n) in mentions.places(mentions.automaton_of(known), text).items()}
    assert got == plain(known, [text])


def test_matches_of_a_batch_come_in_slices(spark):
    texts = pa.RecordBatch.from_pydict({"id": list(range(1000)), "text": ["a ring and a key, ring"] * 1000})
    known = ["ring", "key", "a"]
    made = list(mentions.found_in([texts], mentions.automaton_of(known), known))
    assert sum(b.num_rows for b in made) == 3000 and max(b.num_rows for b in made) <= 3 * maxscore.SLICE
    mentions.mentions(spark.createDataFrame([(1, "a")], "id long, text string"), spark.createDataFrame([("a",)], "name string"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= storage.BATCH_BYTES
