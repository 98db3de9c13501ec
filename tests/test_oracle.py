"""Every query of the ordered-event operators against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidemark import queries

SF = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.12g}")
    return float(x) if isinstance(x, int) and not isinstance(x, bool) else x


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(plain(v) for v in r) for r in df.select(*columns).collect()]
    if name not in queries.ORACLE_SQL:
        assert got
        return
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})")
    assert sorted(map(repr, got)) == sorted(repr(tuple(plain(v) for v in r)) for r in cur.fetchall())
