"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints are made distinct first. Four tables route every fingerprint by one
of its four 16-bit blocks: two that differ in three bits or fewer agree in a
block, so they meet in one group. A task sorts each of its groups by Gray rank,
where neighbours differ in few bits, and builds a tree over the order. Each
node keeps the bits that all codes below it share and that its parent does not
have. A search adds up differences on the way down and leaves a node, with all
codes below it, once more than three bits differ. Codes that are already known
to be in one component aren't searched for again, and a task emits a spanning
forest, so a large group of copies costs as much as it has codes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .components import components, roots
from .scratch import Scratch, Sealed

MAX_BITS = 3
FAN_OUT = 8
CHUNK = 4096
PAIRS = 1 << 19
ROUTES = 1 << 18
HOT = 1 << 17
OWN = ("fingerprint", "component_id")


def fingerprint(text: str, width: int = 3) -> int:
    """The SimHash of a text's word shingles, unsigned; 0 if it has no word."""
    words = text.encode("utf-8").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < width:
        shingles = iter([b" ".join(words)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
        n = len(words) - width + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, 42) for s in shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray order; codes of several words, the highest first, have ranks of as many."""
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    if codes.ndim > 1:
        odd = np.cumsum(np.bitwise_count(codes), axis=1)[:, :-1] & 1
        rank[:, 1:] ^= np.where(odd == 1, ~np.uint64(0), np.uint64(0))
    return rank


def forest(a: np.ndarray, b: np.ndarray, weight: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which edges join what label (the least index of each component so far) leaves apart, none of them in vain and light ones first; the joined label."""
    order, chosen = np.argsort(weight, kind="stable"), []
    while True:
        x, y = label[a[order]], label[b[order]]
        apart = x != y
        order, x, y = order[apart], x[apart], y[apart]
        if not len(order):
            return np.concatenate(chosen) if chosen else order, label
        first = np.full(len(label), len(order))
        for ends in (x, y):
            np.minimum.at(first, ends, np.arange(len(order)))
        pick = np.unique(first[first < len(order)])
        chosen.append(order[pick])
        label = roots(x[pick], y[pick], len(label))[label]


class GrayIndex:
    """Distinct codes of many groups, ordered by group and Gray rank, and the levels of nodes over them. A code is a row of 64-bit words."""

    def __init__(self, group: np.ndarray, codes: np.ndarray):
        codes = codes.reshape(len(group), -1)
        self.order = np.lexsort([*gray_rank(codes).T[::-1], group])
        self.group, self.codes = group[self.order], codes[self.order]
        n = len(codes)
        fresh = np.r_[True, self.group[1:] != self.group[:-1]]
        begins = np.flatnonzero(fresh)
        self.top = np.cumsum(fresh) - 1  # each code's group, which is its root's number
        self.place = np.arange(n) - begins[self.top]
        full = np.broadcast_to(~np.uint64(0), self.codes.shape)
        #: of each level from the codes up: first code of a node, its codes' common bits, where they are common, first child
        self.levels = [(np.arange(n), self.codes, full, None)]
        span = 1
        while len(self.levels[-1][0]) > len(begins):
            span *= FAN_OUT
            starts = np.flatnonzero(fresh | (self.place % span == 0))
            every, some = np.bitwise_and.reduceat(self.codes, starts), np.bitwise_or.reduceat(self.codes, starts)
            common = ~(every ^ some)
            self.levels.append((starts, every & common, common, np.searchsorted(self.levels[-1][0], starts)))

    def linked(self, most: int = MAX_BITS) -> np.ndarray:
        """The smallest index reachable from each code by links of at most so many bits inside its group."""
        n = len(self.codes)
        near = np.flatnonzero((self.group[1:] == self.group[:-1]) & (np.bitwise_count(self.codes[1:] ^ self.codes[:-1]).sum(axis=1) <= most))
        label = roots(near, near + 1, n)
        for start in range(0, n, CHUNK):
            a, b, _ = self._search(np.arange(start, min(n, start + CHUNK)), label, most)
            if len(a):
                label = roots(label[a], label[b], n)[label]
        return label

    def pairs(self, most: int, label: np.ndarray | None, also) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of codes of one group that differ in at most so many bits and pass also(a, b): all between codes of different labels, or with no labels a spanning forest of them."""
        join, label = label is None, np.arange(len(self.codes)) if label is None else label
        reach = np.cumsum(self.place + 1)  # a code meets those before it in its group, at most
        ends = np.unique(np.searchsorted(reach, np.arange(PAIRS, reach[-1] + PAIRS, PAIRS), side="right"))
        start = 0
        for end in np.append(ends[ends > 0], len(label)):
            while start < end:
                stop = min(end, start + CHUNK)
                a, b, differ = self._search(np.arange(start, stop), label, most)
                ok = also(a, b)
                a, b, differ = a[ok], b[ok], differ[ok]
                if join:
                    kept, label = forest(a, b, differ, label)
                    a, b = a[kept], b[kept]
                yield a, b
                start = stop

    def _search(self, queries: np.ndarray, label: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        depth = len(self.levels) - 1
        q, node, differ = queries, self.top[queries], np.zeros(len(queries), np.int64)
        for level in range(depth, 0, -1):
            _, _, common, first = self.levels[level]
            below, pattern, shared, _ = self.levels[level - 1]
            ends = np.append(first[1:], len(below))
            count = ends[node] - first[node]
            child = np.repeat(first[node] - np.cumsum(count) + count, count) + np.arange(count.sum())
            q, parent, differ = np.repeat(q, count), np.repeat(node, count), np.repeat(differ, count)
            ok = below[child] < q  # each pair is met once
            q, child, parent, differ = q[ok], child[ok], parent[ok], differ[ok]
            differ = differ + np.bitwise_count((self.codes[q] ^ pattern[child]) & shared[child] & ~common[parent]).sum(axis=1, dtype=np.int64)
            ok = differ <= most
            q, child, differ = q[ok], child[ok], differ[ok]
            own = label[q]
            if level > 1:
                # a node whose codes are all in the query's component has nothing to add
                last_code = np.append(below[1:], len(self.codes))[child] - 1
                ok = (label[below[child]] != own) | (self._uniform(label)[last_code] > below[child])
            else:
                ok = label[child] != own
            q, node, differ = q[ok], child[ok], differ[ok]
        return (q, node, differ) if depth else (q[:0], q[:0], differ[:0])

    def _uniform(self, label: np.ndarray) -> np.ndarray:
        """For each code, the first code of the stretch with its label that it stands in."""
        if getattr(self, "_seen", None) is not label:
            fresh = np.r_[True, label[1:] != label[:-1]]
            self._seen, self._runs = label, np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        return self._runs


def _fingerprints(width: int):
    """The last column, a text, to its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([fingerprint(t.as_py() or "", width) for t in batch.columns[-1]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(codes, pa.int64())], names=[*batch.schema.names[:-1], "code"])

    return run


def _links(most: int):
    """A whole partition of routed codes: a spanning forest of its links."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [x for x in batches if len(x)]
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        index = GrayIndex(rows["route"].to_numpy(np.int64), rows["code"].to_numpy(np.int64).view(np.uint64))
        label = index.linked(most)
        own = np.flatnonzero(label != np.arange(len(label)))
        codes = index.codes[:, 0].view(np.int64)
        yield pd.DataFrame({"u": codes[own], "v": codes[label[own]]})

    return run


def _cut(code: Column, bits: int, parts: int) -> list[tuple[Column, Column]]:
    """The lowest bits of code as so many blocks, each with the other bits turned down to the lowest places."""
    edges = [bits * p // parts for p in range(parts + 1)]
    out = []
    for lo, hi in zip(edges, edges[1:]):
        block = F.shiftrightunsigned(code, lo).bitwiseAND((1 << (hi - lo)) - 1)
        rest = F.shiftrightunsigned(code, hi).bitwiseAND((1 << (bits - hi)) - 1) if hi < bits else F.lit(0).cast("long")
        out.append((block, F.shiftleft(code.bitwiseAND((1 << lo) - 1), bits - hi).bitwiseOR(rest) if lo else rest))
    return out


def _routed(codes: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """(route, code): two codes that differ in at most so many bits share a route.

    They agree in one of most + 1 blocks. A block with more than HOT codes is
    routed further, by most + 1 blocks of the bits that are left.
    """
    blocks = [F.struct(F.xxhash64(F.lit(b), block).alias("route"), rest.alias("rest"), F.lit(64 - 64 * (b + 1) // (most + 1) + 64 * b // (most + 1)).alias("left")) for b, (block, rest) in enumerate(_cut(F.col("code"), 64, most + 1))]
    first = codes.select("code", F.explode(F.array(*blocks)).alias("r")).select("code", "r.*")
    hot = scratch.keep(first.groupBy("route").agg(F.count("*").alias("codes")).where(F.col("codes") > HOT).select("route", F.lit(True).alias("hot")))
    told = first.join(hot, "route", "left")
    again = F.lit(None).cast("array<long>")
    for left in sorted({64 - 64 * (b + 1) // (most + 1) + 64 * b // (most + 1) for b in range(most + 1)}):
        again = F.when(F.col("left") == left, F.array(*[F.xxhash64("route", F.lit(b), block) for b, (block, _) in enumerate(_cut(F.col("rest"), left, most + 1))])).otherwise(again)
    return told.select("code", F.explode(F.when(F.col("hot"), again).otherwise(F.array("route"))).alias("route"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, most: int = MAX_BITS) -> DataFrame:
    """docs without the text, with fingerprint (16 hex digits) and component_id, the smallest id reachable.

    Fingerprints of width-word shingles that differ in at most ``most`` bits (3 or
    so: each bit more shortens the blocks by which they meet) are linked.
    A null or empty text, or one of white space only, has fingerprint zero and
    is linked like any other. A null id counts for links but never as the
    smallest; a component without ids has a null component_id. Repeated rows get
    the same answer. Columns named like the added ones are replaced. near.near_components
    links by similarity instead, over the same index.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    sealed = Sealed(docs, *OWN)
    key, text = sealed[id_col], sealed[text_col]
    sealed.kept = [c for c in sealed.kept if c != text]
    inner = [*sealed.kept, *({key} - set(sealed.kept))]
    schema = T.StructType([*(sealed.rows.schema[c] for c in inner), T.StructField("code", T.LongType())])
    coded = scratch.keep(sealed.rows.select(*inner, text).mapInArrow(_fingerprints(width), schema), texts=True)
    codes = scratch.keep(coded.groupBy("code").agg(F.min(key).alias("least")))
    routed = _routed(codes, most, scratch)
    parts = codes.count() * (most + 1) // ROUTES + docs.sparkSession.sparkContext.defaultParallelism
    edges = routed.repartition(parts, "route").mapInPandas(_links(most), "u long, v long")
    centre = components(edges, scratch)
    placed = scratch.keep(codes.join(centre.withColumnsRenamed({"u": "code", "v": "centre"}), "code", "left").select("code", "least", F.coalesce("centre", "code").alias("centre")))
    lowest = scratch.keep(placed.groupBy("centre").agg(F.min("least").alias("component_id")))
    answer = scratch.keep(placed.join(lowest, "centre").select("code", "component_id"))
    return coded.join(answer, "code").select(*sealed.restored(), F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")
