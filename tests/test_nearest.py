"""The k nearest lines against all pairs, and how many pairs are looked at."""

import math
import random

import pytest
from pyspark.sql import functions as F

from logweir.operators import similar


def all_pairs(queries, candidates, k, spark):
    """By the engine's own vectors, every pair."""
    cand = spark.createDataFrame(candidates, "id long, line string")
    idf, c_rows = similar.fit(cand)
    q_rows = similar.transform(similar.terms(spark.createDataFrame(queries, "id long, line string")), idf).collect()
    c_vec, q_vec = {i: {} for i, _ in candidates}, {i: {} for i, _ in queries}
    for vec, got in ((c_vec, c_rows.collect()), (q_vec, q_rows)):
        for r in got:
            vec[r.id][r.term] = r.w
    told = {}
    for q, x in q_vec.items():
        dots = sorted(((-round(math.fsum(w * y.get(t, 0.0) for t, w in x.items()), 9), c) for c, y in c_vec.items()))
        told[q] = [(c, -d) for d, c in dots[:k]]
    return told, idf, cand


@pytest.mark.parametrize("seed,k", [(0, 3), (1, 1), (2, 5)])
def test_nearest_equals_all_pairs(spark, seed, k):
    rng = random.Random(seed)
    common, rare = [f"word{i}" for i in range(8)], [f"rare{i}" for i in range(60)]
    line = lambda: " ".join([*rng.choices(common, k=rng.randint(0, 6)), *rng.choices(rare, k=rng.randint(0, 2))])
    candidates = [(i, line()) for i in range(300)]
    candidates += [(400 + i, candidates[7][1]) for i in range(40)] + [(500, ""), (501, "42"), (502, None)]
    queries = [*rng.sample(candidates, 40), (900, "unknown thing"), (901, ""), (902, candidates[7][1]), (903, None)]
    queries = list({i: (i, x) for i, x in queries}.values())
    want, idf, cand = all_pairs(queries, candidates, k, spark)
    got = {}
    for r in similar.nearest(spark.createDataFrame(queries, "id long, line string"), cand, idf, k).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.candidate, r.cosine))
    assert got.keys() == want.keys()
    for q, w in want.items():
        assert [round(s, 6) for _, s in got[q]] == [round(s, 6) for _, s in w], q
        clear = [c for c, s in w if sum(abs(s - t) < 1e-9 for _, t in w) == 1]
        assert set(clear) - {w[-1][0]} <= {c for c, _ in got[q]}


def test_pairs_stay_few(spark):
    """Common words look up nobody where rarer ones give k better lines."""
    sizes = []
    for n in (400, 1600):
        lines = spark.range(n).select("id", F.concat_ws(" ", F.lit("pump pressure alarm"), F.concat(F.lit("unit"), (F.col("id") / 4).cast("int")), F.concat(F.lit("site"), (F.col("id") % 3).cast("string"))).alias("line"))
        idf, vectors = similar.fit(lines)
        q = vectors.where("id % 10 = 0")
        ids = lines.select("id", F.array("id").alias("ids"))
        sizes.append(similar.bounded_pairs(q, vectors, 3, ids).count())
    assert sizes[1] <= 4.5 * sizes[0] and sizes[1] < 160 * 60
