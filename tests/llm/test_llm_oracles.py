import os

import duckdb
import pytest

from pagewarden.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    df = queries.queries()[name](spark, SF)
    r = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in r.description]
    cols = sorted(df.columns)
    assert cols == sorted(names)
    assert sorted(map(repr, (tuple(x[c] for c in cols) for x in df.collect()))) == sorted(map(repr, (tuple(x[names.index(c)] for c in cols) for x in r.fetchall())))
