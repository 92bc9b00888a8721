"""Every query against its SQL twin on the smallest tables."""

from __future__ import annotations

import datetime
from pathlib import Path

import duckdb
import pytest

from kartei.plans import registry


def shown(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck(tiny):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in Path(tiny).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_matches_sql(name, spark, tiny, duck):
    df = registry.queries()[name](spark, tiny)
    cols = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in cols) for r in df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(shown(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want
