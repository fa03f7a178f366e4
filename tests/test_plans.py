"""Every query of the reference's own operators against its SQL, run by DuckDB on the same tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from briefmill import plans
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FOLDER = os.environ.get("ORACLE_SF_DIR", SF)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, decimal.Decimal):
        return float(f"{float(x):.9g}")
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, list | tuple):
        return tuple(plain(y) for y in x)
    return x


def ordered(rows, names):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


def test_each_query_has_sql():
    without = plans.queries().keys() - plans.oracle_sql().keys()
    assert without <= {"chunk_recursive", "chunk_tokens", "file_moves", "structured_chunks", "section_chunks"}


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = plans.queries()[name](spark, FOLDER)
    told = duck.execute(plans.oracle_sql()[name])
    names = [c[0] for c in told.description]
    assert sorted(got.columns) == sorted(names)
    assert ordered([tuple(r) for r in got.collect()], got.columns) == ordered(told.fetchall(), names)
