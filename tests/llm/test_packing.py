"""Packing: pieces against the tokenizer itself, the plan against its rules."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.conftest import SMALL
from tests.llm.helpers import clashing, empty_docs, odd_docs
from weftwork.llm import packing
from weftwork.llm.common import documents

CAPACITY = 1024


def placed(plan):
    """Every piece of a plan: (length, rank, sequence, offset)."""
    return [(r.length, r.first + i, r.sequence + i, r.offset) for r in plan.itertuples() for i in range(r.n)]


def check_sequences(pieces):
    """``pieces`` (length, sequence, offset) fill sequences without gaps, within the capacity, large ones at most in twos."""
    sequences = defaultdict(list)
    for length, sequence, offset in pieces:
        sequences[sequence].append((offset, length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= CAPACITY and sum(n > CAPACITY // 3 for _, n in parts) <= 2
    return sequences


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, CAPACITY), st.integers(1, 40), max_size=25))
def test_plan(counts):
    pieces = placed(packing.packing_plan(counts, CAPACITY))
    assert Counter(n for n, *_ in pieces) == Counter(counts)
    for length, count in counts.items():
        assert sorted(rank for n, rank, *_ in pieces if n == length) == list(range(count))
    sequences = check_sequences([(n, s, o) for n, _, s, o in pieces])
    total = sum(n * c for n, c in counts.items())
    assert len(sequences) >= -(-total // CAPACITY)
    # two sequences that are both at most half full could be one, unless each holds two large pieces
    assert sum(sum(n for _, n in parts) * 2 <= CAPACITY for parts in sequences.values()) <= 1


def test_plan_matches_large_pieces():
    plan = placed(packing.packing_plan({700: 3, 324: 3, 512: 2, 100: 1}, CAPACITY))
    sequences = check_sequences([(n, s, o) for n, _, s, o in plan])
    contents = sorted(sorted(n for _, n in parts) for parts in sequences.values())
    assert contents == [[100], [324, 700], [324, 700], [324, 700], [512, 512]]


def test_pieces_and_sequences(spark):
    for docs in (documents(spark, SMALL), odd_docs(spark)):
        expected = Counter()
        for r in docs.select("doc_id", "text").collect():
            ids = np.array([*tokenizer().encode(r["text"] or "", add_special_tokens=False).ids, 2], dtype="<u4")
            first = len(ids) % CAPACITY or CAPACITY
            starts = [0, *range(first, len(ids), CAPACITY)]
            for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                expected[(r["doc_id"], k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
        out = packing.op2(docs).collect()
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == expected
        sequences = check_sequences([(r["length"], r["sequence_id"], r["offset"]) for r in out])
        assert len(sequences) <= 1.03 * sum(r["length"] for r in out) / CAPACITY + 1


@cache
def tokenizer() -> Tokenizer:
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def plainly(texts: list[str]) -> list[list[int]]:
    return [e.ids for e in tokenizer().encode_batch_fast(texts, add_special_tokens=False)]


def test_both_encoders_agree_on_every_plain_character():
    """Letters, numbers, signs and white space on both sides of each character, and the character beside itself."""
    encode = packing.encoder(packing.vocabulary_paths())
    plain = [c for c in map(chr, range(0x2100)) if not packing.NOT_PLAIN.search(c)]
    assert len(plain) > 300 and not {"\u00a0", "\u0085", "\u0660", "\u4e00"} & set(plain)
    around = ["a", "Z", "é", "7", ".", "'", " ", "\n", "  ", "\t ", ""]
    texts = [f"{x}{c}{y}{c}{c}{x} {c}\n{c}'{c}s{c}'t {x}{y}{c}" for c in plain for x in around for y in around]
    assert [encode(t).tolist() for t in texts] == plainly(texts)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x180), max_size=30), st.integers(0, 120))
def test_plain(text, blanks):
    for x in (text, text + " \t\n\x1c" * (blanks // 4) + " " * (blanks % 4) + "é", text + "<|endoftext|>" + text):
        assert packing.plain(x) == (packing.NOT_PLAIN.search(x) is None)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60), st.text(alphabet="ab 1'st.\n\t éßœ—“€ſ", max_size=60))
def test_any_text_has_the_ids_of_tokenizers(anything, plain):
    encode = packing.encoder(packing.vocabulary_paths())
    for text in (anything, plain, plain + "<|endoftext|>" + anything):
        assert encode(text).tolist() == plainly([text])[0]


def test_special_strings_and_long_white_space(spark):
    texts = ["x <|endoftext|> y", "a", " " * 1_000_000 + "b", "\n" * 99 + "c" + " \t" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in packing.token_pieces(docs, with_ids=True).orderBy("doc_id", "piece").collect():
        got[r["doc_id"]] = got.get(r["doc_id"], []) + r["ids"]
    assert [got[i] for i in range(4)] == [[*ids, 2] for ids in plainly(texts)]
    assert 50256 in got[0]


def test_clashing_columns_and_repeated_rows(spark):
    docs = clashing(odd_docs(spark))
    pieces = lambda df: Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in packing.op2(df).collect())
    assert pieces(docs) == pieces(odd_docs(spark))


def test_ids_are_kept(spark):
    docs = spark.createDataFrame([("a", "one two three"), (None, "four")], "doc_id string, text string")
    rows = {r["doc_id"]: r for r in packing.token_pieces(docs, with_ids=True).collect()}
    assert set(rows) == {"a", None} and rows["a"]["ids"][-1] == 2 and len(rows["a"]["ids"]) == rows["a"]["length"]


def test_salted_ranks(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 50)
    ranked = packing.ranked_by_length(packing.token_pieces(documents(spark, SMALL))).collect()
    by_length = defaultdict(list)
    for r in ranked:
        by_length[r["length"]].append(r["rank"])
    assert all(sorted(ranks) == list(range(len(ranks))) for ranks in by_length.values())


def test_empty_table(spark):
    assert packing.op2(empty_docs(spark)).collect() == []
