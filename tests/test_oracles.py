"""Every query with a SQL counterpart against DuckDB on the smallest tables; those without at least run."""

from __future__ import annotations

from collections import Counter

import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
CORE = [q for q in QUERIES if QUERIES[q].__module__ != "panelforge.llm.queries"]


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 7)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in records)


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    got = df.collect()
    if name in ORACLES:
        cur = duck.execute(ORACLES[name])
        columns = [c[0] for c in cur.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows(got, df.columns) == rows(cur.fetchall(), columns)


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
