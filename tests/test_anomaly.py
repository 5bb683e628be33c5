"""Forests grown on executors against a plain recursion over the same samples."""

import hashlib
import math
import random

import pytest

from logweir.operators import anomaly

SCHEMA = "record_id string, temperature double, pressure double, rf_power double, flow_rate double"


def _rows(n, seed=3):
    rng = random.Random(seed)
    rows = [(str(i), rng.gauss(20, 3), rng.choice([None, 1.0, 2.0]), None, float(rng.randint(0, 5))) for i in range(n)]
    return rows + [("far", 500.0, 40.0, None, 900.0), ("none", None, None, None, None), ("nan", float("nan"), None, None, None), ("twin", 20.0, 1.0, None, 1.0), ("twin", 20.0, 1.0, None, 1.0)]


def _mean_depth(n):
    return 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def _length(tree, rows, x, node, deepest):
    """How deep x comes in a tree over rows, told by recursion without any stored tree."""
    wide = [f for f in range(4) if max(r[f] for r in rows) > min(r[f] for r in rows)]
    if node.bit_length() - 1 >= deepest or not wide:
        return node.bit_length() - 1 + _mean_depth(len(rows))
    told = hashlib.md5(f"42:{tree}:{node}".encode()).hexdigest()
    f = wide[int(told[:8], 16) % len(wide)]
    low, high = min(r[f] for r in rows), max(r[f] for r in rows)
    at = low + int(told[8:16], 16) / 2**32 * (high - low)
    side = x[f] > at
    return _length(tree, [r for r in rows if (r[f] > at) == side], x, 2 * node + side, deepest)


@pytest.mark.parametrize("n", [40, 700])
def test_equals_plain_recursion(spark, n):
    rows, trees, sample = _rows(n), 7, 32
    frame = spark.createDataFrame(rows, SCHEMA)
    forest = anomaly.fit_forest(frame, trees=trees, sample=sample)
    known = [[None if v is None or math.isnan(v) else v for v in r[1:]] for r in rows]
    there = [(r[0], k) for r, k in zip(rows, known) if any(v is not None for v in k)]
    means = []
    for f in range(4):
        own = [k[f] for _, k in there if k[f] is not None]
        means.append(sum(own) / len(own) if own else 0.0)
    assert forest.means == pytest.approx(means)
    filled = [(i, tuple(m if v is None else v for v, m in zip(k, forest.means))) for i, k in there]
    md5 = lambda text: hashlib.md5(text.encode()).hexdigest()
    pool = sorted(filled, key=lambda r: (md5(r[0]), r))[: trees * sample]
    samples = [[x for _, x in sorted(pool, key=lambda r: (md5(f"{t}:{r[0]}"), r))[:sample]] for t in range(trees)]
    size = min(sample, len(there))
    deepest = math.ceil(math.log2(size))
    got = {}
    for r in anomaly.score_records(frame, forest).collect():
        got.setdefault(r.record_id, r.anomaly_score)
    for i, x in filled:
        mean = sum(_length(t, samples[t], x, 1, deepest) for t in range(trees)) / trees
        assert got[i] == pytest.approx(max(-1.0, -2 * 2 ** (-mean / _mean_depth(size))), abs=1e-9)
    assert got["none"] == got["nan"] == 0.0 and got["far"] == min(got.values())


def test_partitions_and_order_change_nothing(spark):
    frame = spark.createDataFrame(_rows(300), SCHEMA)
    one = anomaly.fit_forest(frame.coalesce(1), trees=5, sample=64)
    other = anomaly.fit_forest(frame.orderBy("pressure", "record_id").repartition(7), trees=5, sample=64)
    assert one.trees == other.trees


def test_few_rows_and_ties(spark):
    frame = spark.createDataFrame(_rows(0)[:3], SCHEMA)
    assert anomaly.fit_forest(frame) is None
    same = spark.createDataFrame([(str(i), 1.0, 1.0, 1.0, 1.0) for i in range(20)], SCHEMA)
    forest = anomaly.fit_forest(same, trees=3)
    assert all(t["feature"] == [-1] for t in forest.trees)
    assert len({r.anomaly_score for r in anomaly.score_records(same, forest).collect()}) == 1
    assert anomaly.fit_forest(frame.where("false")) is None
