"""Every registered query against its DuckDB oracle, at sf0.001."""

import math

import duckdb
import pytest

from turnforge.plans.catalog import QUERIES
from turnforge.plans.oracle import oracle_sql
from turnforge.sources.tables import TABLES

from .conftest import SF_SMALL

KEYS = sorted(QUERIES)
SQL = oracle_sql()


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{round(v, 6):.6f}"
    return str(v)


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in recs)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_key_has_an_oracle_or_is_rows_only():
    assert set(KEYS) == set(SQL)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    df = QUERIES[key](spark, SF_SMALL)
    cols = df.columns
    got = [tuple(r) for r in df.collect()]
    assert len(set(cols)) == len(cols)
    if key not in SQL:
        assert got
        return
    cur = con.execute(SQL[key])
    dcols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(dcols)
    assert _rows(cols, got) == _rows(dcols, cur.fetchall())


def test_entry_smoke(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.columns == ["turn", "pct_ended", "pct_new"]
    assert df.count() >= 0


def test_entry_registers_every_key():
    from __spark_entry__ import oracle_sql as registered_sql
    from __spark_entry__ import queries
    assert set(KEYS) <= set(queries()) and set(SQL) <= set(registered_sql())
