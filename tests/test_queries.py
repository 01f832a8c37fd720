"""Every registered query of the engine against its SQL."""

from __future__ import annotations

import pytest

from tests.conftest import SMALL, same_rows
from weftwork import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SMALL), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert df.columns and df.count() >= 0


def test_flagship(spark):
    rows = registry.flagship(spark, SMALL).collect()
    per_query = {}
    for r in rows:
        per_query.setdefault(r["query_id"], []).append((r["rank"], r["score"]))
    for ranks in per_query.values():
        ranks.sort()
        assert [k for k, _ in ranks] == list(range(1, len(ranks) + 1)) and len(ranks) <= 6
        assert [s for _, s in ranks] == sorted((s for _, s in ranks), reverse=True)
