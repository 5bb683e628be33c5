"""The similarity queries take every row of their table."""

import math
from collections import Counter

from logweir.queries import QUERIES


def parts(spark, folder, ids):
    rows = [(i, f"{('red', 'blue', 'big')[i % 3]} {('ring', 'bolt')[i // 3 % 2]}", ("SMALL", "LARGE", "ECONOMY")[i // 7 % 3], f"Brand#{i % 5}") for i in ids]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_brand string").write.parquet(f"{folder}/part.parquet")
    return {r[0]: Counter([*r[1].split(), r[2].lower(), "brand"]) for r in rows}


def test_cluster_lines_takes_all_ids(spark, tmp_path):
    terms = parts(spark, tmp_path, [*range(1, 40), *range(5001, 5040)])
    got = QUERIES["cluster_lines"](spark, str(tmp_path)).collect()
    assert sum(r.n for r in got) == len(terms)


def test_nearest_lines_searches_all_rows(spark, tmp_path):
    terms = parts(spark, tmp_path, range(1, 301))
    df = Counter(t for c in terms.values() for t in c)
    n = len(terms)
    idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in df.items() if d <= 0.95 * n}
    vectors = {}
    for i, c in terms.items():
        x = {t: (1 + math.log(k)) * idf[t] for t, k in c.items() if t in idf}
        norm = math.sqrt(sum(v * v for v in x.values()))
        vectors[i] = {t: v / norm for t, v in x.items()}
    want = []
    for q in (100, 200, 300):
        told = sorted((sum(w * v.get(t, 0.0) for t, w in vectors[q].items()) for v in vectors.values()), reverse=True)
        want += [(q, k + 1, round(told[k], 6)) for k in range(3)]
    got = sorted((r.id, r.rank, r.cosine) for r in QUERIES["nearest_lines"](spark, str(tmp_path)).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want] and all(abs(g[2] - w[2]) < 2e-6 for g, w in zip(got, want))
