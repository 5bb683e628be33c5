"""What goes to which list and shard: no link is lost, and a vector meets a small part of its label only."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from logweir.llm import hnsw


def spread(rng, n, dim=64):
    x = rng.standard_normal((n, dim))
    x[n // 2 : n // 2 + n // 20] = x[: n // 20] + rng.standard_normal((n // 20, dim)) * 0.14
    return x


def crowded(rng, n, dim=64):
    x = spread(rng, n, dim)
    x[: n // 3] = x[0] + rng.standard_normal((n // 3, dim)) * 0.12
    return x


def flat(rng, n, dim=64):
    return rng.standard_normal((n, 3)) @ rng.standard_normal((3, dim))


def linked(x, shards):
    """(links of each vector, roots, pairs compared) of one label through the operator's own steps."""
    n = len(x)
    nodes = np.random.default_rng(n).permutation(n).astype(np.int64) - n // 2
    n_hubs = int(np.ceil(max(min(4 * n**0.5, 128), 0.5 * n**0.5)))
    drawn = np.random.default_rng(1).permutation(n)
    sample = drawn[: n_hubs + hnsw.PROBES]
    frame = pd.DataFrame({"node": nodes[sample], "vector": list(x[sample]), "shards": shards, "hub": np.arange(len(sample)) < n_hubs})
    row = hnsw._built(0.98)((1, x.shape[1]), frame).iloc[0].to_dict()
    router = hnsw.Router(row | {"place": 0}, 0.98)
    vectors = pa.array(list(x), pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.full(n, 1)), pa.array(np.full(n, x.shape[1])), pa.array(nodes), pa.array(np.ones(n, np.int64)), vectors], ["label", "dim", "node", "weight", "vector"])
    sent = pa.Table.from_batches(list(router.routed(batch))).to_pandas()
    sizes = np.bincount(sent.home[~sent.visitor], minlength=n_hubs)
    compared = sum(sizes[np.frombuffer(r, np.int32)].sum() for r in sent.lists[~sent.visitor])
    rows = sent.assign(place=sent["shard"]).sort_values(["shard", "visitor"], kind="stable")
    told = pa.RecordBatch.from_pandas(rows[["place", "dim", "visitor", "node", "weight", "vector", "home", "lists"]], preserve_index=False)
    found = pd.concat([b.to_pandas() for b in hnsw._matched(0.98)(iter([told.slice(0, n // 2), told.slice(n // 2)]))])
    links = found[found.v.isna()].groupby("u").n.sum().reindex(nodes, fill_value=0).to_numpy()
    edges = found[found.v.notna()]
    at = pd.Series(np.arange(n), nodes)
    return links, hnsw.roots(at[edges.u].to_numpy(), at[edges.v.astype("int64")].to_numpy(), n), compared


@pytest.mark.parametrize("shards", [1, 4])
@pytest.mark.parametrize("made", [spread, crowded, flat])
def test_links_equal_brute_force(made, shards):
    x = made(np.random.default_rng(3), 2400)
    near = (hnsw.unit(x) @ hnsw.unit(x).T >= 0.98) & ~np.eye(len(x), dtype=bool)
    links, label, _ = linked(x, shards)
    assert (links == near.sum(axis=1)).all()
    a, b = np.nonzero(near)
    assert (label == hnsw.roots(a, b, len(x))).all()


def test_a_vector_meets_a_small_part_of_its_label():
    shares = [linked(spread(np.random.default_rng(4), n), 4)[2] / n**2 for n in (1500, 12000)]
    assert shares[1] < 0.1 and shares[1] < shares[0] * 1.2
