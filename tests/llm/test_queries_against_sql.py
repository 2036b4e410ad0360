"""The training-data queries that SQL can express, on whole driver tables."""

import math
import os

import pytest

from assayloom.llm import queries

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = con.sql(queries.ORACLES[name])
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    rows = lambda data, cols: sorted(repr([plain(r[cols.index(c)]) for c in names]) for r in data)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(rel.fetchall(), rel.columns)
