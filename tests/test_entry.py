"""The registered queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from logweir.oracles import ORACLES
from logweir.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"cluster_lines", "detect_formats", "generated_logs"}  # half a minute each; they have tests of their own


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}"
    return f"{v:.9g}" if isinstance(v, int) and not isinstance(v, bool) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    told = con.execute(ORACLES[name])
    columns = [d[0] for d in told.description]
    frame = QUERIES[name](spark, SF)
    assert sorted(frame.columns) == sorted(columns)
    mine = sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in frame.collect())
    theirs = sorted(tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in told.fetchall())
    assert mine == theirs


def test_names():
    assert set(ORACLES) <= set(QUERIES)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
