"""Embedding near-duplicates over hierarchical navigable small-world graphs.

The layers above the lowest are a graph over the hubs of a label, a hash sample of its vectors. On the lowest
layer every vector is tied to its nearest hub only, so a hub's neighbours there are a list. Each vector
goes through its label's graph once, by beams from the top layer down: the nearest hub met takes it into its
list, and the lists of all hubs that lie little farther are searched for its links. How much farther and how wide
the beams are is settled by an audit: they must find the nearest hub of every sampled vector, and of probes at just the threshold's cosine from
them RECALL must meet the vector's list, or the vector theirs. A query whose whole beam lies that near is repeated with a wider one, so
no vector has a cap on its links. A pair is found if either of its vectors searches the other's list, and counted once.

Lists that lie together are a shard, and a vector visits the shards that it searches besides its own: so a label's work grows
little faster than its vectors. Lists are compared as blocks in single precision, what is close to the threshold
again in double precision. A shard returns a count for each vector and a spanning forest, not pairs. Equal vectors are one node with a weight.

Searches and insertions run in lockstep for a batch of vectors: each step is a few numpy calls.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .components import components, roots
from .scratch import Scratch, Sealed, trim

THRESHOLD = 0.98
DEGREE = 12
BUILD_BEAM = 48
FIRST_BEAM = 16
ENTRY_BEAM = 16
PROBES = 1024
RECALL = 0.999
SLACK = 1.5
NEAR = 3
MARGIN = 1e-4
SHARDS = 1
SHARD_ROWS = 1 << 18
SHARD_BYTES = 3 << 24
SLICE_ROWS = 1 << 14
VISITORS = 1 << 15
CELLS = 1 << 21
MOST_PARTS = 4096
OWN = ("n_links", "component_id", "kept")
_GRAPH = "label {}, dim int, hubs binary, sizes array<int>, adjacency array<binary>, beam int, room double, ranks binary, parts binary"
_SENT = "label {}, dim int, shard int, visitor boolean, node long, weight long, vector array<{}>, home int, lists binary"
_FOUND = "u long, v long, n long"


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision, safe for very large and very small components."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def levels_of(keys: np.ndarray) -> np.ndarray:
    """The top layer of each node: geometric, drawn from its key."""
    x = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    u = ((x >> np.uint64(11)).astype(float) + 1) / (1 << 53)
    return np.minimum(6, (-np.log(u) / math.log(DEGREE)).astype(int))


class Graph:
    """Layers over unit vectors x, which are ordered by falling top layer: layer l holds the first sizes[l] nodes."""

    def __init__(self, x: np.ndarray, sizes: list[int], adjacency: list[np.ndarray]):
        self.x, self.sizes, self.adjacency = x, sizes, adjacency

    @classmethod
    def build(cls, x: np.ndarray, top: np.ndarray) -> Graph:
        sizes = [int((top >= level).sum()) for level in range(int(top[0]) + 1)]
        graph = cls(x, sizes, [np.full((n, DEGREE * (1 if level else 2)), -1, np.int32) for level, n in enumerate(sizes)])
        start, step = 0, 64
        while start < len(x):
            stop = min(len(x), start + step)
            graph._insert(start, stop)
            start, step = stop, min(512, step * 2)
        return graph

    def _insert(self, start: int, stop: int) -> None:
        batch = np.arange(start, stop)
        entry = np.zeros((len(batch), 1), np.int64)
        for level in range(len(self.sizes) - 1, -1, -1):
            here = batch[batch < self.sizes[level]]
            if start:
                ids, sims = self._beam(self.x[batch], entry, BUILD_BEAM if len(here) else ENTRY_BEAM, level, min(start, self.sizes[level]))
                entry = ids
            if not len(here):
                continue
            mates = self.x[here] @ self.x[here].T
            np.fill_diagonal(mates, -np.inf)
            ids_here, sims_here = np.broadcast_to(here, mates.shape), mates
            if start:
                ids_here, sims_here = np.hstack([ids[: len(here)], ids_here]), np.hstack([sims[: len(here)], sims_here])
            chosen = self._select(here, ids_here, sims_here, DEGREE)
            self.adjacency[level][here, :DEGREE] = chosen
            self._back_links(level, here, chosen)

    def _select(self, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates, up to most: from the nearest on, those nearer to the node than to any chosen before."""
        width = min(ids.shape[1], BUILD_BEAM)
        near = np.argsort(-sims, axis=1, kind="stable")[:, :width]
        ids, sims = np.take_along_axis(ids, near, 1), np.take_along_axis(sims, near, 1)
        out = np.full((len(nodes), most), -1, np.int32)
        count = np.zeros(len(nodes), int)
        for rows in np.array_split(np.arange(len(nodes)), max(1, len(nodes) // 128)):
            v = self.x[ids[rows]]
            mutual = v @ v.transpose(0, 2, 1)
            worst = np.full((len(rows), width), -np.inf)  # each candidate's nearest among the chosen
            for k in range(width):
                ok = (sims[rows, k] > -np.inf) & (count[rows] < most) & (sims[rows, k] > worst[:, k])
                take = rows[ok]
                out[take, count[take]] = ids[take, k]
                count[take] += 1
                worst[ok] = np.maximum(worst[ok], mutual[ok, k])
            for k in range(width):  # room left goes to the nearest of the rest
                left = (sims[rows, k] > -np.inf) & (count[rows] < most // 2) & ~(out[rows] == ids[rows, k][:, None]).any(axis=1)
                take = rows[left]
                out[take, count[take]] = ids[take, k]
                count[take] += 1
        return out

    def _back_links(self, level: int, nodes: np.ndarray, chosen: np.ndarray) -> None:
        adjacency = self.adjacency[level]
        most = adjacency.shape[1]
        source, slot = np.nonzero(chosen >= 0)
        target = chosen[source, slot].astype(np.int64)
        source = nodes[source]
        fresh = ~(adjacency[target] == source[:, None]).any(axis=1)
        source, target = source[fresh], target[fresh]
        sims = np.einsum("ij,ij->i", self.x[source], self.x[target])
        order = np.lexsort((-sims, target))
        source, target = source[order], target[order]
        heads, first, count = np.unique(target, return_index=True, return_counts=True)
        wide = min(int(count.max(initial=0)), 2 * BUILD_BEAM)
        take = first[:, None] + np.arange(wide)
        ok = np.arange(wide) < count[:, None]
        extra = np.where(ok, source[np.minimum(take, len(source) - 1)], -1) if len(source) else np.zeros((0, 0), int)
        ids = np.hstack([adjacency[heads], extra]) if len(heads) else np.zeros((0, most), int)
        full = (ids >= 0).sum(axis=1) > most
        for h, row in zip(heads[~full], ids[~full]):
            kept = row[row >= 0]
            adjacency[h, : len(kept)] = kept
        if full.any():
            heads, ids = heads[full], ids[full]
            sims = np.where(ids >= 0, np.einsum("ijk,ik->ij", self.x[ids], self.x[heads]), -np.inf)
            adjacency[heads] = self._select(heads, ids, sims, most)

    def _beam(self, q: np.ndarray, entry: np.ndarray, width: int, level: int, upto: int) -> tuple[np.ndarray, np.ndarray]:
        """Per query, the width best nodes that a beam meets on a layer among its first upto nodes, from the entries on (a row of nodes, -1 for none); id -1 and -inf where there are fewer."""
        b, most = len(q), min(width, upto)
        edges = np.zeros((upto + 1, upto), bool)  # of each node; the last row is none
        node, slot = np.nonzero((self.adjacency[level][:upto] >= 0) & (self.adjacency[level][:upto] < upto))
        edges[node, self.adjacency[level][node, slot]] = True
        sims, done = np.full((b, upto), -np.inf, np.float32), np.zeros((b, upto), bool)
        live = np.arange(b)
        row, col = np.nonzero(entry >= 0)
        node = entry[row, col]
        sims[row, node] = np.einsum("ij,ij->i", self.x[node], q[row])
        step = min(max(4, width // 4), upto)
        while True:
            met = sims[live]
            last = np.partition(met, upto - most, axis=1)[:, upto - most]
            waiting = np.where(done[live] | (met < last[:, None]), -np.inf, met)
            pick = np.argpartition(-waiting, step - 1, axis=1)[:, :step]
            ok = np.take_along_axis(waiting, pick, 1) > -np.inf
            going = ok.any(axis=1)
            live, pick, ok, met = live[going], pick[going], ok[going], met[going]
            if not len(live):
                break
            row, col = np.nonzero(ok)
            done[live[row], pick[row, col]] = True
            pick = np.where(ok, pick, upto)
            near = edges[pick[:, 0]]
            for k in range(1, step):
                near |= edges[pick[:, k]]
            row, node = np.nonzero(near & (met == -np.inf))
            sims[live[row], node] = np.einsum("ij,ij->i", self.x[node], q[live[row]])
        best = np.argpartition(-sims, most - 1, axis=1)[:, :most]
        sims = np.take_along_axis(sims, best, 1)
        left = ((0, 0), (0, width - most))
        return np.pad(np.where(sims > -np.inf, best, -1), left, constant_values=-1), np.pad(sims, left, constant_values=-np.inf)

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and cosines of each query's beam, from the top layer down."""
        entry = np.zeros((len(q), 1), np.int64)
        for level in range(len(self.sizes) - 1, 0, -1):
            entry = self._beam(q, entry, ENTRY_BEAM, level, self.sizes[level])[0]
        return self._beam(q, entry, width, 0, len(self.x))

    def within(self, q: np.ndarray, least: float | Callable[[np.ndarray], np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs of cosine least or more, found by beams that widen until their end lies below it; least may be told from each query's best."""
        n = len(self.x)
        rows, nodes = [], []
        todo = np.arange(len(q))
        while len(todo):
            again = []
            for some in np.array_split(todo, math.ceil(len(todo) * max(width * 4, n // 4) / (1 << 18))):
                if width >= n:  # the widest beam is the whole shard
                    sims = q[some] @ self.x.T
                    row, node = np.nonzero(sims >= self._floor(sims, least))
                else:
                    ids, sims = self.search(q[some], width)
                    floor = self._floor(sims, least)
                    more = sims.min(axis=1) >= floor[:, 0]
                    again.append(some[more])
                    hit = (sims >= floor) & ~more[:, None]
                    row, col = np.nonzero(hit)
                    node = ids[row, col]
                rows.append(some[row])
                nodes.append(node)
            todo = np.concatenate(again) if again else todo[:0]
            width *= 2
        return (np.concatenate(rows), np.concatenate(nodes)) if rows else (np.zeros(0, int), np.zeros(0, int))

    @staticmethod
    def _floor(sims: np.ndarray, least: float | Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        return least(sims.max(axis=1))[:, None] if callable(least) else np.full((len(sims), 1), least)

    def audited(self, keys: np.ndarray, least: float) -> int:
        """The first width at which PROBES nodes, and as many vectors at just the threshold from them, find all nodes that brute force finds."""
        rng = np.random.default_rng(len(keys))
        picked = np.argsort(keys.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93))[:PROBES]
        away = rng.standard_normal((len(picked), self.x.shape[1])).astype(np.float32)
        away -= np.einsum("ij,ij->i", away, self.x[picked])[:, None] * self.x[picked]
        away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
        probes = (least + MARGIN) * self.x[picked] + math.sqrt(1 - (least + MARGIN) ** 2) * away
        probes = np.vstack([probes, self.x[picked]])
        true = int((probes @ self.x.T >= least).sum())
        width = FIRST_BEAM
        while width < len(keys) and len(self.within(probes, least, width)[0]) < true:
            width *= 2
        return width


def chord(sims: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * sims))


def nearby(room: float, threshold: float) -> Callable[[np.ndarray], np.ndarray]:
    """The least cosine of hubs to search, from the nearest hub's: those whose distance is greater by twice room at most. No hub farther by over twice the threshold's distance can have a linked vector, and where the nearest hub is near, all up to there are searched."""
    most = math.sqrt(2 - 2 * threshold)

    def least(best: np.ndarray) -> np.ndarray:
        own = chord(best)
        return 1 - (own + 2 * np.where(own <= NEAR * most, most, room)) ** 2 / 2 - 1e-6

    return least


def nearest(graph: Graph, q: np.ndarray, least: float | Callable[[np.ndarray], np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, hub, cosine) by query, then from the nearest hub on; and where each query begins."""
    row, hub = graph.within(q, least, width)
    sims = np.concatenate([np.einsum("ij,ij->i", q[row[at : at + (1 << 18)]], graph.x[hub[at : at + (1 << 18)]]) for at in range(0, len(row), 1 << 18)])
    order = np.lexsort((hub, -sims, row))
    row = row[order]
    return row, hub[order], sims[order], np.searchsorted(row, np.arange(len(q)))


def settled(graph: Graph, x: np.ndarray, threshold: float) -> tuple[int, float]:
    """The beam that finds the nearest hub of all sampled vectors x, as brute force does, and of whose probes RECALL or more meet the list of the vector that they were made from, or it theirs; and the room that they take. Half of the probes lie in random directions, half towards another vector of x."""
    rng = np.random.default_rng(len(x))
    x = x[np.arange(PROBES) % len(x)]
    away = rng.standard_normal(x.shape).astype(np.float32)
    sims = x @ x.T
    sims[sims > threshold] = -1
    away[::2] = x[sims.argmax(axis=1)][::2]
    away -= np.einsum("ij,ij->i", away, x)[:, None] * x
    size = np.linalg.norm(away, axis=1, keepdims=True)
    probes = np.where(size > 1e-6, threshold * x + math.sqrt(1 - threshold**2) * away / np.maximum(size, 1e-6), x).astype(np.float32)
    most = math.sqrt(2 - 2 * threshold)
    best = (x @ graph.x.T).max(axis=1)
    width = FIRST_BEAM
    while True:
        far = np.full((2, len(x)), np.inf)
        found = [nearest(graph, q, nearby(most, threshold), width) if width >= len(graph.x) else _beams(graph, q, width) for q in (x, probes)]
        for k, (mine, theirs) in enumerate((found, found[::-1])):  # is the one's nearest hub in the other's beam, and how much farther than its own?
            row, hub, sims, begins = theirs
            home = mine[1][mine[3]]
            hit = np.flatnonzero(hub == home[row])
            own = chord(sims[begins[row[hit]]])
            far[k, row[hit]] = np.where(own <= NEAR * most, 0, (chord(sims[hit]) - own) / 2)
        far = far.min(axis=0)
        sure = (found[0][2][found[0][3]] >= best - 1e-5).all()
        if width >= len(graph.x) or sure and (far < np.inf).mean() >= RECALL:
            return width, min(most, float(far[far < np.inf].max(initial=0)) * SLACK + 1e-3)
        width *= 2


def _beams(graph: Graph, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As nearest, whole beams of one width."""
    ids, sims = graph.search(q, width)
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    row, col = np.nonzero(ids >= 0)
    return row, ids[row, col], sims[row, col], np.searchsorted(row, np.arange(len(q)))


def dealt(x: np.ndarray, parts: int) -> np.ndarray:
    """A part for each row: halves along the direction of most variance, again and again."""
    out = np.zeros(len(x), np.int32)
    if parts < 2 or len(x) < 2:
        return out
    centred = x - x.mean(axis=0)
    along = centred @ np.linalg.eigh((centred.T @ centred).astype(float))[1][:, -1]
    left = parts // 2
    order = np.argsort(along, kind="stable")
    cut = round(len(x) * left / parts)
    out[order[:cut]] = dealt(x[order[:cut]], left)
    out[order[cut:]] = left + dealt(x[order[cut:]], parts - left)
    return out


def _built(threshold: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        nodes, x, hub = rows["node"].to_numpy(np.int64), unit(np.stack(rows["vector"].to_numpy()).astype(np.float64)).astype(np.float32), rows["hub"].to_numpy(bool)
        top = levels_of(nodes[hub])
        order = np.argsort(-top, kind="stable")
        graph = Graph.build(x[hub][order], top[order])
        beam, room = settled(graph, x if hub.all() else x[~hub], threshold)
        parts = dealt(graph.x, int(rows["shards"].iloc[0]))
        ranks = np.empty(len(parts), np.int32)
        ranks[np.argsort(parts, kind="stable")] = np.arange(len(parts))
        row = [*key, graph.x.tobytes(), graph.sizes, [a.tobytes() for a in graph.adjacency], beam, room, ranks.tobytes(), np.sort(parts).tobytes()]
        return pd.DataFrame([row], columns=["label", "dim", "hubs", "sizes", "adjacency", "beam", "room", "ranks", "parts"])

    return run


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def lists_of(ranks: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary value for each stretch of ranks."""
    offsets = np.concatenate([[0], ends]).astype(np.int32) * 4
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ranks.astype(np.int32).tobytes())])


class Router:
    """A label's stored graph, ready for blocks of its vectors."""

    def __init__(self, row: dict, threshold: float):
        sizes = list(row["sizes"])
        x = np.frombuffer(row["hubs"], np.float32).reshape(sizes[0], -1)
        self.graph = Graph(x, sizes, [np.frombuffer(a, np.int32).reshape(n, -1) for a, n in zip(row["adjacency"], sizes)])
        self.beam, self.least, self.place, self.dim = row["beam"], nearby(row["room"], threshold), row["place"], row["dim"]
        self.ranks, self.parts = np.frombuffer(row["ranks"], np.int32), np.frombuffer(row["parts"], np.int32)

    def routed(self, some: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Each vector as a member of its own shard, with all lists that it searches, and as a visitor of every other shard that has some of them."""
        n = len(some)
        row, hub, _, begins = nearest(self.graph, unit(matrix(some.column("vector"), self.dim).astype(np.float64)).astype(np.float32), self.least, self.beam)
        home = self.ranks[hub[begins]]
        rank = self.ranks[hub]
        order = np.lexsort((rank, row))
        row, rank = row[order], rank[order]
        yield self._rows(some, self.parts[home], False, home, lists_of(rank, np.append(begins[1:], len(row))))
        part = self.parts[rank]
        away = part != self.parts[home][row]
        if away.any():
            row, rank, part = row[away], rank[away], part[away]
            last = np.append(np.flatnonzero((row[1:] != row[:-1]) | (part[1:] != part[:-1])), len(row) - 1)
            yield self._rows(some.take(pa.array(row[last])), part[last], True, home[row[last]], lists_of(rank, last + 1))

    @staticmethod
    def _rows(some: pa.RecordBatch, shard: np.ndarray, visitor: bool, home: np.ndarray, lists: pa.Array) -> pa.RecordBatch:
        told = [some.column("label"), some.column("dim"), pa.array(shard, pa.int32()), pa.array(np.full(len(some), visitor)), some.column("node"), some.column("weight"), some.column("vector"), pa.array(home, pa.int32()), lists]
        return pa.RecordBatch.from_arrays(told, ["label", "dim", "shard", "visitor", "node", "weight", "vector", "home", "lists"])


def _routed(threshold: float):
    """Sorted rows of a partition: each graph, then the vectors that go through it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = None
        for batch in batches:
            graphs = np.flatnonzero(batch.column("hubs").is_valid().to_numpy(zero_copy_only=False))
            cuts = np.unique(np.r_[0, graphs, len(batch)])
            for start, stop in zip(cuts[:-1], cuts[1:]):
                some = batch.slice(start, stop - start)
                if some.column("hubs")[0].is_valid:
                    router, some = Router(some.slice(0, 1).to_pylist()[0], threshold), some.slice(1)
                if len(some):
                    if router is None or (some.column("place").to_numpy() != router.place).any():
                        raise RuntimeError("vectors without a graph")
                    yield from router.routed(some)

    return run


class Block:
    """Vectors of one shard: members by list, or visitors."""

    def __init__(self, parts: list[pa.RecordBatch], ordered: bool = False):
        """Takes parts over: each is let go as soon as it is copied."""
        get = lambda name: np.concatenate([p.column(name).to_numpy(zero_copy_only=False) for p in parts])
        self.node, self.weight, self.home = get("node"), get("weight"), get("home").astype(np.int64)
        dim = int(parts[0].column("dim")[0].as_py())
        lists = pa.concat_arrays([p.column("lists") for p in parts])
        ends = np.frombuffer(lists.buffers()[1], np.int32, len(lists) + 1, lists.offset * 4) // 4
        self.rank = np.frombuffer(lists.buffers()[2], np.int32)[ends[0] : ends[-1]].astype(np.int64)
        self.row = np.repeat(np.arange(len(lists)), np.diff(ends))
        place = np.arange(len(lists))
        if ordered:
            order = np.lexsort((self.node, self.home))
            place[order] = np.arange(len(order))
            self.node, self.weight, self.home, self.row = self.node[order], self.weight[order], self.home[order], place[self.row]
        vectors = [p.column("vector") for p in parts]
        parts.clear()
        start = 0
        for k in range(len(vectors)):
            v = matrix(vectors[k], dim)
            vectors[k] = None
            if not k:
                self.raw, self.x = np.empty((len(place), dim), v.dtype), np.empty((len(place), dim), np.float32)
            at = place[start : start + len(v)]
            self.raw[at], self.x[at] = v, unit(v.astype(np.float64))
            start += len(v)
        self.links = np.zeros(len(self.node), np.int64)


class Shard:
    """The lists of one shard. Its members come first, then the visitors, in blocks."""

    def __init__(self, place: int, threshold: float):
        self.place, self.threshold = place, threshold
        self.members: Block | None = None
        self.waiting: list[pa.RecordBatch] = []

    def add(self, some: pa.RecordBatch, visitor: bool) -> Iterator[pa.RecordBatch]:
        if visitor and self.members is None:
            if not self.waiting:  # lists that nothing hangs on
                return
            self._settle()
        self.waiting.append(some)
        if visitor and sum(map(len, self.waiting)) >= VISITORS:
            yield from self._visit()

    def finish(self) -> Iterator[pa.RecordBatch]:
        if self.members is None:
            if not self.waiting:
                return
            self._settle()
        yield from self._visit()
        yield self._told(self.members, self.members.node[self.label], self.label != np.arange(len(self.label)))

    def _settle(self) -> None:
        self.members, self.waiting = Block(self.waiting, ordered=True), []
        m = self.members
        self.label = np.arange(len(m.node))
        self.span = 1 + max(int(m.rank.max()), int(m.home.max()))
        self.searched = np.sort(m.row * self.span + m.rank)
        self._match(m, 0)

    def _visit(self) -> Iterator[pa.RecordBatch]:
        if self.waiting:
            block, self.waiting = Block(self.waiting), []
            n = len(self.label)
            self.label = np.concatenate([self.label, np.arange(n, n + len(block.node))])
            self._match(block, n)
            root = self.label[n:]
            self.label = self.label[:n]
            yield self._told(block, self.members.node[np.minimum(root, n - 1)], root < n)

    def _told(self, block: Block, root: np.ndarray, linked: np.ndarray) -> pa.RecordBatch:
        """Counts of those that have links, then the forest."""
        counted = block.links > 0
        u, n = np.r_[block.node[counted], block.node[linked]], np.r_[block.links[counted], np.zeros(linked.sum(), np.int64)]
        v = pa.array(np.r_[block.node[counted], root[linked]], pa.int64(), mask=np.r_[np.ones(counted.sum(), bool), np.zeros(linked.sum(), bool)])
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), v, pa.array(n, pa.int64())], ["u", "v", "n"])

    def _match(self, q: Block, base: int) -> None:
        """Compares each of q with the lists that it searches; base is q's first place among the labels."""
        m = self.members
        order = np.argsort(q.rank, kind="stable")
        heads, first = np.unique(q.rank[order], return_index=True)
        edges, n_edges = [], 0
        for head, start, stop in zip(heads, first, np.append(first[1:], len(order))):
            low, high = np.searchsorted(m.home, (head, head + 1))
            rows = q.row[order[start:stop]]
            if q is m:
                rows = rows[(m.home[rows] != head) | (rows > low)]
            if low == high or not len(rows):
                continue
            for some in np.array_split(rows, math.ceil(len(rows) * (high - low) / CELLS)):
                for left in range(low, high, CELLS):
                    sims = q.x[some] @ m.x[left : min(high, left + CELLS)].T
                    a, b = np.nonzero(sims >= self.threshold - MARGIN)
                    if not len(a):
                        continue
                    sims = sims[a, b]
                    a, b = some[a], left + b
                    ok = self._once(q, a, b, head)
                    close = np.flatnonzero(ok & (sims < self.threshold + MARGIN))
                    for at in range(0, len(close), 1 << 16):
                        k = close[at : at + (1 << 16)]
                        ok[k] = np.einsum("ij,ij->i", unit(q.raw[a[k]].astype(np.float64)), unit(m.raw[b[k]].astype(np.float64))) >= self.threshold
                    a, b = a[ok], b[ok]
                    np.add.at(q.links, a, m.weight[b])
                    np.add.at(m.links, b, q.weight[a])
                    edges.append((base + a, b))
                    n_edges += len(a)
                    if n_edges >= CELLS:
                        edges, n_edges = self._joined(edges), 0
        self._joined(edges)

    def _once(self, q: Block, a: np.ndarray, b: np.ndarray, head: int) -> np.ndarray:
        """Of the pairs of q and members of one list, those that no other place counts: a pair in one list counts from the later one, others from the higher list if it searches the lower."""
        home = q.home[a]
        ok = home > head
        if q is self.members:
            ok |= (home == head) & (b < a)
        up = np.flatnonzero(home < head)
        if len(up):
            key = b[up] * self.span + home[up]
            at = np.minimum(np.searchsorted(self.searched, key), len(self.searched) - 1)
            ok[up] = (self.searched[at] != key) | (home[up] >= self.span)
        return ok

    def _joined(self, edges: list) -> list:
        if edges:
            a, b = (np.concatenate(x) for x in zip(*edges))
            self.label = roots(self.label[a], self.label[b], len(self.label))[self.label]
        return []


def _matched(threshold: float):
    """Sorted rows of a partition: the members of each shard, then its visitors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            place, visitor = batch.column("place").to_numpy(), batch.column("visitor").to_numpy(zero_copy_only=False).astype(bool)
            cuts = np.r_[0, 1 + np.flatnonzero((place[1:] != place[:-1]) | (visitor[1:] != visitor[:-1])), len(batch)]
            for start, stop in zip(cuts[:-1], cuts[1:]):
                if start == stop:
                    continue
                if shard is None or place[start] != shard.place:
                    if shard:
                        yield from shard.finish()
                    shard = Shard(place[start], threshold)
                yield from shard.add(batch.slice(start, stop - start), bool(visitor[start]))
        if shard:
            yield from shard.finish()
        shard = None
        trim()

    return run


def usable(vector: Column) -> Column:
    """Neither null nor zero, without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, shards: int = SHARDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """rows with n_links, component_id and kept; shards grow in number only where a label exceeds shards * shard_rows vectors, or SHARD_BYTES a shard.

    Two vectors link if their labels are equal and not null, their lengths are
    equal and their cosine is at least the threshold. A vector that is null or zero or has null or
    non-finite components, or a null label, links with nothing. Every other row of
    equal vector and label counts as a link, repeated rows too. component_id is the smallest id
    reachable, null if there is none; kept tells whether it is the row's own. Columns named
    like the added ones are replaced.
    """
    scratch, sealed = Scratch(rows.sparkSession, "hnsw"), Sealed(rows, *OWN)
    number = "float" if sealed.rows.schema[sealed[vector_col]].dataType.simpleString() == "array<float>" else "double"
    key, vector, label = F.col(sealed[id_col]), F.col(sealed[vector_col]).cast(f"array<{number}>"), F.col(sealed[label_col])
    good = usable(vector) & label.isNotNull()
    told = sealed.rows.withColumn("key", F.when(good, F.xxhash64(label, vector)))
    nodes = scratch.keep(
        sealed.rows.where(good).groupBy(label.alias("label"), F.xxhash64(label, vector).alias("node")).agg(F.any_value(vector).alias("vector"), F.count("*").alias("weight"), F.min(key).alias("least")).withColumn("dim", F.size("vector"))
    )
    n = F.col("n")
    hubs = F.greatest(F.least(4 * F.sqrt(n), F.lit(128)), 0.5 * F.sqrt(n))
    counts = [F.ceil(hubs).alias("n_hubs"), F.greatest(F.lit(shards), F.ceil(n / shard_rows), F.ceil(n * F.col("dim") * 4 / SHARD_BYTES)).alias("shards"), F.ceil(n / SLICE_ROWS).alias("slices")]
    sizes = scratch.keep(nodes.groupBy("label", "dim").agg(F.count("*").alias("n")).select("label", "dim", "n", *counts))
    placed = nodes.drop("least").join(sizes, ["label", "dim"]).withColumn("slice", F.pmod(F.xxhash64("node", F.lit(1)), F.col("slices")).cast("int"))
    n_graphs, n_shards, n_slices = sizes.agg(F.count("*"), F.sum("shards"), F.sum("slices")).first()
    spread = [min(MOST_PARTS, max(int(k or 1), rows.sparkSession.sparkContext.defaultParallelism)) for k in (n_graphs, n_shards, n_slices)]  # a graph is a task's work, so small ones aren't put together
    draw = F.pmod(F.xxhash64("node", F.lit(3)), n)  # hubs, and other vectors for the audit
    sample = placed.where(draw < F.col("n_hubs") + PROBES).select("label", "dim", "node", "vector", "shards", (draw < F.col("n_hubs")).alias("hub"))
    kind = nodes.schema["label"].dataType.simpleString()
    graphs = scratch.keep(sample.repartition(spread[0], "label", "dim").groupBy("label", "dim").applyInPandas(_built(threshold), _GRAPH.format(kind)))
    # a graph goes to each slice of its label's vectors, a slice is large and streams past it
    place = ["label", "dim", "slice"]
    sent = graphs.join(sizes.select("label", "dim", "slices"), ["label", "dim"]).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices").cast("int") - 1))).drop("slices")
    stream = sent.unionByName(placed.select(*place, "node", "weight", "vector"), allowMissingColumns=True)
    stream = stream.repartition(spread[2], *place).sortWithinPartitions(*place, F.col("hubs").isNull())
    routed = stream.withColumn("place", F.xxhash64(*place)).mapInArrow(_routed(threshold), _SENT.format(kind, number))
    place = ["label", "dim", "shard"]
    met = routed.repartition(spread[1], *place).sortWithinPartitions(*place, "visitor")
    found = scratch.keep(met.select(F.xxhash64(*place).alias("place"), "dim", "visitor", "node", "weight", "vector", "home", "lists").mapInArrow(_matched(threshold), _FOUND))
    links = found.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("links"))
    centre = components(found.where("v is not null").select("u", "v"), scratch)
    joined = nodes.select("node", "weight", "least").join(links, "node", "left").join(centre.withColumnsRenamed({"u": "node", "v": "centre"}), "node", "left")
    joined = scratch.keep(joined.select("node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "least", F.coalesce("centre", "node").alias("centre")))
    lowest = scratch.keep(joined.groupBy("centre").agg(F.min("least").alias("lowest")))
    answer = scratch.keep(joined.join(lowest, "centre").select(F.col("node").alias("of"), "n_links", "lowest"))
    out = told.join(answer, F.col("key") == F.col("of"), "left").withColumn("component_id", F.when(F.col("of").isNull(), key).otherwise(F.col("lowest")))
    return out.select(*sealed.restored(), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", key.eqNullSafe(F.col("component_id")).alias("kept"))
