"""Every registered query against its DuckDB oracle on sf0.001; the entry query's schema is stable."""

import math

import duckdb
import pytest

import __spark_entry__ as E

from conftest import SF_SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "isoformat") and not isinstance(v, str):
        return v.isoformat()
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, repr(x)) for x in r))


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["ledger_id", "month", "label", "income_total", "expense_total", "opening", "closing"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    rel = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in rel.description]
    assert sorted(sdf.columns) == sorted(dcols)
    s = _rows(sdf.columns, sdf.collect())
    d = _rows(dcols, rel.fetchall())
    assert s == d


def test_every_query_runs(spark):
    for name, fn in E.queries().items():
        if name not in E.oracle_sql():
            fn(spark, SF_SMALL).limit(5).collect()
