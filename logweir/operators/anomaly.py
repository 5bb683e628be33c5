"""Isolation forest scores of measurements."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

FEATURES = ("temperature", "pressure", "rf_power", "flow_rate")
TREES, SAMPLE, LEAST, SEED, FLAG = 100, 256, 10, 42, -0.5


def expected_depth(n: np.ndarray | float) -> np.ndarray:
    """The mean depth of an unsuccessful search among n."""
    n = np.asarray(n, float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _draw(seed: int, tree: int, node: int) -> tuple[int, float]:
    """A node's draws, from its name alone: a whole number for the feature and a share in [0, 1) for the threshold."""
    told = hashlib.md5(f"{seed}:{tree}:{node}".encode()).hexdigest()
    return int(told[:8], 16), int(told[8:16], 16) / 2.0**32


def grow(tree: int, x: np.ndarray, deepest: int, seed: int) -> list[tuple[int, int, float, int]]:
    """A tree over the rows of x: (node, feature or -1, threshold, rows) each; node 1 is the root, the children of n are 2n (at most the threshold) and 2n + 1. The draws and so the tree don't depend on the rows' order."""
    out, open_nodes = [], [(1, 0, x)]
    while open_nodes:
        node, depth, rows = open_nodes.pop()
        low, high = rows.min(axis=0), rows.max(axis=0)
        spread = np.flatnonzero(high > low)
        if depth >= deepest or not len(spread):
            out.append((node, -1, 0.0, len(rows)))
            continue
        pick, share = _draw(seed, tree, node)
        f = int(spread[pick % len(spread)])
        at = float(low[f] + share * (high[f] - low[f]))
        goes = rows[:, f] > at
        out.append((node, f, at, len(rows)))
        open_nodes += [(2 * node + side, depth + 1, rows[goes == side]) for side in (0, 1)]
    return out


def deepest(size: int) -> int:
    return math.ceil(math.log2(max(size, 2)))


class Forest:
    """Trees as arrays: feature (-1 in leaves), threshold, children and the leaf's path length."""

    def __init__(self, trees: list[dict[str, list]], size: int, means: list[float]):
        self.trees, self.size, self.means = trees, size, means

    @classmethod
    def of_nodes(cls, nodes: Iterable[tuple[int, int, int, float, int]], means: list[float]) -> Forest:
        """From (tree, node, feature, threshold, rows) of all nodes."""
        by_tree: dict[int, list] = {}
        for tree, *rest in sorted(nodes):
            by_tree.setdefault(tree, []).append(rest)
        trees, size = [], 0
        for _, own in sorted(by_tree.items()):
            place = {n[0]: k for k, n in enumerate(own)}
            size = own[0][3]
            trees.append({
                "feature": [f for _, f, _, _ in own], "at": [at for _, _, at, _ in own],
                "left": [place.get(2 * n, 0) for n, *_ in own], "right": [place.get(2 * n + 1, 0) for n, *_ in own],
                "length": [n.bit_length() - 1 + float(expected_depth(rows)) for n, _, _, rows in own],
            })
        return cls(trees, size, means)

    @classmethod
    def fit(cls, x: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> Forest:
        """On the rows of an array, in this process; fit_forest does it over a table."""
        rng = np.random.default_rng(seed)
        size = min(sample, len(x))
        nodes = [(t, *n) for t in range(trees) for n in grow(t, x[rng.choice(len(x), size, replace=False)], deepest(size), seed)]
        return cls.of_nodes(nodes, [float(m) for m in x.mean(axis=0)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        """In [-1, 0): the lower, the more alone."""
        total = np.zeros(len(x))
        for tree in self.trees:
            feature, at, left, right, length = (np.array(tree[k]) for k in ("feature", "at", "left", "right", "length"))
            place = np.zeros(len(x), int)
            while (feature[place] >= 0).any():
                inner = feature[place] >= 0
                low = x[np.arange(len(x)), np.maximum(feature[place], 0)] <= at[place]
                place = np.where(inner, np.where(low, left[place], right[place]), place)
            total += length[place]
        return -(2.0 ** (-total / len(self.trees) / max(float(expected_depth(self.size)), 1e-12)))

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(2 * self.raw(x), -1.0, 1.0)

    def to_json(self) -> str:
        return json.dumps({"trees": self.trees, "size": self.size, "means": self.means})

    @classmethod
    def from_json(cls, text: str) -> Forest:
        return cls(**json.loads(text))


def samples(records: DataFrame, features: Sequence[str] = FEATURES, trees: int = TREES, sample: int = SAMPLE, key: str = "record_id") -> DataFrame:
    """(tree, features): for each tree the sample records with the least hashes of the tree and their key, out of the trees * sample with the least hashes of their key."""
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    pool = records.select(name.alias("key"), *features).orderBy(F.md5("key"), "key", *features).limit(trees * sample)
    drawn = pool.select("key", *features, F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    order = W.partitionBy("tree").orderBy(F.md5(F.concat_ws(":", F.col("tree").cast("string"), "key")), "key", *features)
    return drawn.withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample).select("tree", *features)


def fit_forest(records: DataFrame, features: Sequence[str] = FEATURES, trees: int = TREES, sample: int = SAMPLE, key: str = "record_id", seed: int = SEED) -> Forest | None:
    """Trees grown on the executors, a group a tree, each from its own sample of the records with any feature; what a record lacks is the column's mean over all records. None with fewer than LEAST records.

    The driver holds the nodes, twice trees * sample at most. The same records give the same forest, in any order and partitioning.
    """
    names = [f"x{i}" for i in range(len(features))]
    numbers = records.select(F.col(key).alias("key"), *[F.nanvl(F.col(f).cast("double"), F.lit(None)).alias(x) for f, x in zip(features, names)])
    there = numbers.where(F.coalesce(*names).isNotNull())
    told = there.agg(F.count("*").alias("n"), *[F.avg(x).alias(x) for x in names]).first()
    if told.n < LEAST:
        return None
    means = [told[x] if told[x] is not None else 0.0 for x in names]
    size = min(sample, told.n)
    filled = there.fillna(dict(zip(names, means)))

    def tree_of(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        return pd.DataFrame([(tree, *n) for n in grow(tree, group[names].to_numpy(float), deepest(size), seed)], columns=["tree", "node", "feature", "at", "rows"])

    grown = samples(filled, names, trees, sample, "key").groupBy("tree").applyInPandas(tree_of, "tree int, node long, feature int, at double, rows int")
    return Forest.of_nodes([tuple(r) for r in grown.collect()], means)


def score_records(records: DataFrame, forest: Forest | None, features: Sequence[str] = FEATURES) -> DataFrame:
    """records with anomaly_score in [-1, 0), or 0 without a forest or any feature; missing features are the means over records."""
    if forest is None:
        return records.withColumn("anomaly_score", F.lit(0.0))
    held = records.sparkSession.sparkContext.broadcast(forest)  # a hundred small trees
    found = records.agg(*[F.avg(F.nanvl(F.col(f).cast("double"), F.lit(None))).alias(f) for f in features]).first()
    means = [found[f] if found[f] is not None else 0.0 for f in features]

    @F.pandas_udf(T.DoubleType())
    def scored(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.fillna(m).to_numpy(float) for c, m in zip(columns, means)])
        return pd.Series(held.value.score(x))

    numbers = [F.nanvl(F.col(f).cast("double"), F.lit(None)) for f in features]
    return records.withColumn("anomaly_score", F.when(F.coalesce(*numbers).isNotNull(), scored(*numbers)).otherwise(0.0))


def annotate(records: DataFrame) -> DataFrame:
    """parse_flags with anomaly_detected where the score is below FLAG."""
    flags = F.coalesce("parse_flags", F.array().cast("array<string>"))
    return records.withColumn("parse_flags", F.when(F.col("anomaly_score") < FLAG, F.array_union(flags, F.array(F.lit("anomaly_detected")))).otherwise(flags))
