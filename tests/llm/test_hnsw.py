"""Links and components against brute force; recall of the graph; odd rows."""

import numpy as np
import pytest

from logweir.llm import hnsw


def clustered(rng, n, dim=24):
    base = rng.standard_normal((n // 3, dim))
    rows = [base[rng.integers(len(base))] + rng.standard_normal(dim) * rng.choice((0.01, 0.1, 0.19, 1.0)) for _ in range(n - n // 4)]
    rows += [base[0] + rng.standard_normal(dim) * 0.05 for _ in range(n // 4)]
    return np.array(rows)


@pytest.mark.parametrize("seed", range(3))
def test_recall_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    x = hnsw.unit(clustered(rng, 1500)).astype(np.float32)
    keys = np.sort(rng.integers(-(2**63), 2**63, 1500))
    top = hnsw.levels_of(keys)
    order = np.argsort(-top, kind="stable")
    graph = hnsw.Graph.build(x, top[order])
    row, node = graph.within(x, 0.98, graph.audited(keys, 0.98))
    true = {(int(a), int(b)) for a, b in zip(*np.nonzero(x @ x.T >= 0.98))}
    got = set(zip(row.tolist(), node.tolist()))
    assert len(got & true) >= 0.99 * len(true)
    assert len(row) == len(got)


def slow(rows):
    n = len(rows)
    unit = []
    for _, v, label in rows:
        ok = label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        unit.append(hnsw.unit(np.array([v], float))[0] if ok else None)
    links = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        new = [min([label[i], *(label[j] for j in links[i])]) for i in range(n)]
        if new == label:
            break
        label = new
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[label[i]] = min(rows[i][0], least.get(label[i], rows[i][0]))
    return [(rows[i][0], len(links[i]), least.get(label[i])) for i in range(n)]


def test_rows(spark):
    rng = np.random.default_rng(9)
    rows = [(i * 3, [float(x) for x in v.astype(np.float32)], int(rng.integers(3))) for i, v in enumerate(clustered(rng, 260))]
    rows += [(5000, None, 1), (5001, [0.0] * 24, 1), (5002, [None] * 24, 1), (5003, [float("nan")] * 24, 1), (5004, [float("inf")] * 24, 1), (5005, rows[0][1], None), (5006, [], 1), (5007, [1.0, 2.0], 1), (5008, [2.0, 4.0], 1)]
    rows += [(7000 + i, rows[4][1], rows[4][2]) for i in range(30)] + [rows[7], (None, rows[8][1], rows[8][2])]
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "vec_id long, embedding array<float>, label int, kept string, node string, lowest string").repartition(5)
    want = sorted(map(str, slow(rows)))
    for shards, width in ((4, 50_000), (2, 20)):
        got = hnsw.near_duplicates(frame, shards=shards, shard_rows=width).collect()
        assert sorted(str((r.vec_id, r.n_links, r.component_id)) for r in got) == want
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert hnsw.near_duplicates(frame.where("false")).count() == 0
