"""Each query against its SQL in DuckDB on the smallest tables."""

import glob
import math
import os

import pytest

from gridloom.plans import catalogue
from jobs import queries as jobs

QUERIES, ORACLE_SQL = catalogue.QUERIES | jobs.QUERIES, catalogue.ORACLE_SQL | jobs.ORACLE_SQL
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    return v


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x) if x is not None else (True, "", 0) for x in r))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = ordered(tuple(r) for r in df.select(*cols).collect())
    assert got
    if name not in ORACLE_SQL:
        return
    rel = duck.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    want = ordered(rel.select(*[f'"{c}"' for c in cols]).fetchall())
    kinds = {c: ("float" if t in ("double", "float") else "int" if t in ("int", "bigint", "smallint") else t) for c, t in df.dtypes}
    for c, t in zip(rel.columns, rel.types, strict=True):
        k = str(t)
        assert ("float" if k in ("DOUBLE", "FLOAT") else "int" if k in ("INTEGER", "BIGINT", "SMALLINT") else kinds[c] if k in ("VARCHAR", "BOOLEAN") or k.startswith("TIMESTAMP") else k) == kinds[c], (c, k)
    assert len(got) == len(want)
    assert got == want
