"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import pytest

from pulsegrid.plans import catalogue

duckdb = pytest.importorskip("duckdb")
DIR = Path("/root/testdata/sf0.001")


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.6g}"
    return str(v)


@pytest.mark.skipif(not DIR.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{DIR}/events.parquet'")
    df = catalogue.QUERIES[name](spark, str(DIR))
    rel = con.sql(catalogue.ORACLE_SQL[name])
    want = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    assert sorted(tuple(norm(x) for x in r) for r in df.collect()) == sorted(tuple(norm(r[c]) for c in df.columns) for r in want)
