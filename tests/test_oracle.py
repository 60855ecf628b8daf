"""Every query with SQL gives DuckDB's rows on the smallest tables; the others run."""

from __future__ import annotations

import math

import duckdb
import pytest

from meridia.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def norm(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    rows = df.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    r = duck.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(norm(x[names.index(k)]) for k in sorted(names)) for x in r.fetchall())
    got = sorted(tuple(norm(x[k]) for k in sorted(names)) for x in rows)
    assert got == want


def test_entry_has_rows(spark):
    assert registry.entry(spark, DATA).count() > 0
