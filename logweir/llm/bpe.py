"""Byte-level BPE with a hierarchical-bitmap rank queue.

The pairs of one pre-token lie on a doubly linked list. Each merge rank that is
present has a bucket of positions; a two-level bitmap over the ranks names the
lowest bucket in use by two find-first-set steps. A pop takes the leftmost
position of that bucket; an entry whose pair has changed since it was pushed is
stale and skipped. Each merge pushes two pairs at most, so a pre-token of n
bytes costs O(n log n) at worst, where scanning for the lowest pair costs n^2.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .scratch import Sealed, hold_batches, trim

LEAF = 256
CACHE = 3 << 17
OWN = ("n_tokens", "ids_sha256", "decoded_sha256")


class RankBpe:
    """Encoder and decoder for one table of ranks, token bytes to id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        size = max(ranks.values()) + 1
        self.bytes_of: list[bytes | None] = [None] * size
        for t, i in ranks.items():
            self.bytes_of[i] = t
        self.text_of = [str(i) for i in range(size)]
        self.bit = [1 << k for k in range(max(LEAF, size // LEAF + 1))]
        self.byte_id = [ranks[bytes([b])] for b in range(256)]
        self.shift = size.bit_length()
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << self.shift | right] = rank
        self.pairs = pairs
        self.leaves = [0] * (size // LEAF + 1)
        self.kind = np.dtype(np.uint16 if size <= 1 << 16 else np.uint32)
        self.code = "H" if size <= 1 << 16 else "I"
        self.words = CACHE
        self.cache: dict[str, bytes] = {}  # ids as packed bytes: half the memory of tuples
        self.old: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        pairs, shift, leaves, top = self.pairs.get, self.shift, self.leaves, 0
        bit, byte_id = self.bit, self.byte_id
        ids = [byte_id[b] for b in piece]
        n = len(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        buckets: dict[int, int | list[int]] = {}  # a lone position, or a heap of them
        left = ids[0]
        for i in range(n - 1):
            right = ids[i + 1]
            rank = pairs(left << shift | right)
            left = right
            if rank is not None:
                if rank in buckets:
                    held = buckets[rank]
                    if held.__class__ is int:
                        buckets[rank] = [held, i]
                    else:
                        held.append(i)  # ascending, so still a heap
                else:
                    buckets[rank] = i
                    leaves[rank >> 8] |= bit[rank & 255]
                    top |= bit[rank >> 8]
        while top:
            leaf = (top & -top).bit_length() - 1
            bits = leaves[leaf]
            rank = leaf << 8 | ((bits & -bits).bit_length() - 1)
            held = buckets[rank]
            if held.__class__ is int:
                i = held
                held = None
            else:
                i = heappop(held)
            if not held:
                del buckets[rank]
                leaves[leaf] = bits = bits & (bits - 1)
                if not bits:
                    top &= top - 1
            a, j = ids[i], nxt[i]
            if a < 0 or j >= n or pairs(a << shift | ids[j]) != rank:
                continue
            k = nxt[j]
            ids[i], ids[j], nxt[i] = rank, -1, k
            h, at = prv[i], i
            if k < n:
                prv[k] = i
                fresh = pairs(rank << shift | ids[k])
            else:
                fresh = None
            while True:  # the pair on the right, then the one on the left
                if fresh is not None:
                    if fresh in buckets:
                        held = buckets[fresh]
                        if held.__class__ is int:
                            buckets[fresh] = [held, at] if held < at else [at, held]
                        else:
                            heappush(held, at)
                    else:
                        buckets[fresh] = at
                        leaves[fresh >> 8] |= bit[fresh & 255]
                        top |= bit[fresh >> 8]
                if at == h or h < 0:
                    break
                at, fresh = h, pairs(ids[h] << shift | rank)
        return tuple([x for x in ids if x >= 0])

    def _missed(self, word: str) -> bytes:
        """A pre-token that the young half of the cache lacks. Half is dropped when it is full; words in use move on from the old one."""
        ids = self.old.get(word)
        if ids is None:
            ids = array(self.code, self.merge(word.encode("utf-8"))).tobytes()
        if len(word) <= 64:
            if len(self.cache) >= self.words:
                self.old = dict(self.cache)
                self.cache.clear()
            self.cache[word] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        get, missed = self.cache.get, self._missed
        return np.frombuffer(b"".join([get(w) or missed(w) for w in self.split(text)]), self.kind)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank a line."""
    return {base64.b64decode(t): int(r) for t, r in map(bytes.split, filter(None, data.split(b"\n")))}


_CODECS: dict[tuple[str, str], RankBpe] = {}


def codec(data: bytes, pattern: str) -> RankBpe:
    """One codec for each rank file and pattern in a Python process: its cache serves all tasks."""
    key = hashlib.sha256(data).hexdigest(), pattern
    if key not in _CODECS:
        _CODECS[key] = RankBpe(read_ranks(data), pattern)
    return _CODECS[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", keep_ids: bool = True, words: int = CACHE) -> DataFrame:
    """docs with ids (array), decoded text's SHA-256 and the ids' SHA-256; with keep_ids false the ids themselves are left out.

    Each match of pattern is encoded by itself, special tokens are plain text, a
    null text is empty: no ids, and the hashes of nothing. Texts of any length
    are encoded whole. A Python worker remembers two times so many words at most. Input columns named like the added ones are replaced. The session's Arrow batches are held to 512
    rows from here on, as the result is computed later.
    """
    hold_batches(docs.sparkSession)
    with open(ranks_path, "rb") as f:  # the driver's copy; a vocabulary file has a fixed size
        held = docs.sparkSession.sparkContext.broadcast(f.read())
    sealed = Sealed(docs, *OWN, "ids")
    text = sealed[text_col]
    kept = [c for c in sealed.kept if keep_ids or c != text]
    rows = sealed.rows.select(*kept, F.col(text).alias("text"))

    def encoded(bpe: RankBpe, batch: pa.RecordBatch) -> pa.RecordBatch:
        number = bpe.text_of.__getitem__
        counts, ids_sha, text_sha, all_ids = [], [], [], []
        for text in batch.columns[-1]:
            packed = bpe.encode(text.as_py() or "")
            ids = packed.tolist()
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(" ".join(map(number, ids)).encode()).hexdigest())
            text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            if keep_ids:
                all_ids.append(pa.array(packed.astype(np.int32)))
        out = batch.columns[:-1]
        out += [pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
        names = [*kept, *OWN]
        if keep_ids:
            ends = pa.compute.cumulative_sum(pa.array([0, *counts], pa.int32()))
            out.append(pa.ListArray.from_arrays(ends, pa.concat_arrays(all_ids) if all_ids else pa.array([], pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(out, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        bpe = codec(held.value, pattern)
        bpe.words = words
        gc.disable()  # nothing here makes cycles, and each collection would walk the cache
        try:
            for batch in batches:
                yield encoded(bpe, batch)
        finally:
            gc.freeze()
            gc.enable()
            trim()

    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if keep_ids:
        added.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    told = rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in kept), *added]))
    sealed.kept = kept
    return told.select(*sealed.restored(), *(f.name for f in added))
