"""Every registered query of the library against its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import pytest
from conftest import TABLES, duck

from tessellar.plans import ORACLES, QUERIES


def plain(v):
    if v is None or v != v:
        return None
    return round(v, 6) if isinstance(v, float) else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, TABLES)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        assert got
        return
    found = duck().execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows_of(names, found.fetchall())


def test_entry_without_the_optional_subpackage(spark, monkeypatch):
    import sys

    import __spark_entry__ as e

    for gone in ("tessellar.llm", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, gone, None)
    assert set(e.queries()) == set(QUERIES)
    assert e.oracle_sql() == ORACLES
    assert e.entry(spark).count() > 0
