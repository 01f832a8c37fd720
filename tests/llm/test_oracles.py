"""The queries that SQL can express, against it; all queries' columns and types against their contracts."""

from __future__ import annotations

import pytest

from tests.conftest import SMALL, same_rows
from weftwork.llm import queries as registered

QUERIES, SQL = registered.queries(), registered.oracle_sql()

#: First columns of each query, in any order; more may follow.
CONTRACTS = {
    "op1": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op2": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op3": {"doc_id": "bigint", "score": "double"},
    "op4": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op5": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op6": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op7": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op8": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
    "op9": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op10": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op11": {"conv_id": "bigint", "depth": "bigint", "parent_conv_id": "bigint", "n_convs": "bigint", "n_children": "bigint", "n_leaves": "bigint", "saved_tokens": "bigint", "ends_sha256": "string"},
    "op12": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op13": {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SMALL), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_contract(spark, name):
    kinds = dict(QUERIES[name](spark, SMALL).dtypes)
    wanted = CONTRACTS[name.split("_")[0]]
    assert {c: kinds.get(c) for c in wanted} == wanted


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
