"""Connected components by alternating stars over edge tables.

Each round first contracts the edges inside every partition (a task holds its
own edges only), then links every neighbour above a node to the smallest
neighbour (large star) and every neighbour below to the smallest (small star).
The number of edges never grows, a hub meets its edges in an equi-join that can
be split, and every round is a table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index reachable from each of n nodes over the edges a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, jumped := label[label]):
            label = jumped
        if np.array_equal(label, before):
            return label


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = [x for x in batches if len(x)]
    if not parts:
        return
    edges = pd.concat(parts, ignore_index=True)
    nodes, at = np.unique(edges[["u", "v"]].to_numpy(np.int64), return_inverse=True)
    at = at.reshape(-1, 2)
    label = roots(at[:, 0], at[:, 1], len(nodes))
    own = np.flatnonzero(label != np.arange(len(nodes)))
    yield pd.DataFrame({"u": nodes[own], "v": nodes[label[own]]})


def components(edges: DataFrame, scratch: Scratch, small: bool = False) -> DataFrame:
    """edges (u, v) of longs to (u, v): every node that isn't the smallest of its component, with the smallest. small: as for scratch.keep."""
    keep = partial(scratch.keep, small=small)
    found = keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).mapInPandas(_contract, "u long, v long"))
    while True:
        # done when every node has one edge and no centre has an edge of its own
        low = keep(found.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        chained = low.join(found.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count()
        if not chained and not low.where("n > 1").limit(1).count():
            scratch.drop(low)
            return found
        both = found.unionByName(found.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = keep(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))
        scratch.drop(low, least, found)
        least = keep(large.groupBy("u").agg(F.min("v").alias("m")))
        stars = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        found = keep(stars.select("e.u", "e.v").where("u <> v").distinct().mapInPandas(_contract, "u long, v long"))
        scratch.drop(large, least)
