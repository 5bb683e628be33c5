"""First-wins dedup on ties and nulls, as its SQL."""

from datetime import datetime

import duckdb

from logweir.oracles import ORACLES
from logweir.queries import QUERIES


def test_ties_and_nulls_equal_the_sql(spark, tmp_path):
    early, late = datetime(1996, 1, 2), datetime(1997, 3, 4)
    rows = [(1, 6, p, early) for p in (9, 4, 7)] + [(2, 3, 5, None), (2, 4, 8, late)] + [(3, None, 1, early), (3, 2, 2, early)] + [(4, 1, None, late), (4, 1, 6, late)]
    rows += [(5, None, None, None), (None, 1, 2, late), (None, 1, 1, late)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_shipdate timestamp").repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    con.execute(f"create view lineitem as select * replace (l_shipdate::timestamp as l_shipdate) from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(ORACLES["dedup_keep_first"]).fetchall()
    got = QUERIES["dedup_keep_first"](spark, str(tmp_path))
    assert sorted(map(str, ((r.l_orderkey, r.l_linenumber, r.l_partkey, r.duplicates) for r in got.collect()))) == sorted(str((r[0], r[1], r[2], r[4])) for r in want)
