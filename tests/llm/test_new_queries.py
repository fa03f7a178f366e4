"""Queries of operators whose rows SQL can make, against that SQL on the smallest tables."""

import duckdb
import pytest

from briefmill.llm import queries
from tests.conftest import SF


@pytest.mark.parametrize("name", ["op11_fill_middle", "op12_divergence"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    told = con.execute(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, SF).select(*[c[0] for c in told.description])
    want = sorted(told.fetchall(), key=repr)
    assert want and sorted((tuple(r) for r in got.collect()), key=repr) == want
