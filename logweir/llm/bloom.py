"""A blocked counting Bloom filter over 64-bit hashes, built by tasks, gathered in the driver under a size bound and broadcast.

Counters stop at two. Beyond the bound the filter fills up and lets more pass: the caller checks what passes exactly.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

BLOCK_BITS = 16
CELLS_PER_ROW = 16
PROBES = 4


def _block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    return (h.view(np.uint64) >> np.uint64(32)) % np.uint64(blocks)


def _cells(sub: np.ndarray) -> np.ndarray:
    """PROBES cells of a block for each 32-bit rest of a hash, by double hashing."""
    a, b = sub & np.uint32(0xFFFF), (sub >> np.uint32(16)) | np.uint32(1)
    steps = np.arange(PROBES, dtype=np.uint32)
    return (a[:, None] + steps * b[:, None]) & np.uint32(0xFFFF)


def _counted(blocks: int):
    """Per task: the distinct hashes of each block, with those the task itself saw twice."""

    def flush(parts: list[np.ndarray]) -> pd.DataFrame:
        h, n = np.unique(np.concatenate(parts), return_counts=True)
        block, sub = _block_of(h, blocks).astype(np.int32), h.view(np.uint64).astype(np.uint32)
        order = np.argsort(block, kind="stable")
        block, sub, n = block[order], sub[order], n[order]
        ids, starts = np.unique(block, return_index=True)
        ends = np.append(starts[1:], len(block))
        cut = [(sub[s:e], n[s:e]) for s, e in zip(starts, ends)]
        return pd.DataFrame({"block": ids, "once": [s[c == 1].tobytes() for s, c in cut], "twice": [s[c > 1].tobytes() for s, c in cut]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, held = [], 0
        for batch in batches:
            parts.append(batch["h"].to_numpy(np.int64))
            held += len(batch)
            if held >= 1 << 20:
                yield flush(parts)
                parts, held = [], 0
        if held:
            yield flush(parts)

    return run


def _merged(times: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """One block: a bit per cell that was counted so many times or more."""
        count = np.zeros(1 << BLOCK_BITS, np.uint32)
        for once, twice in zip(rows["once"], rows["twice"]):
            count += np.bincount(_cells(np.frombuffer(once, np.uint32)).ravel(), minlength=len(count)).astype(np.uint32)
            count[_cells(np.frombuffer(twice, np.uint32)).ravel()] += 2
        bits = np.packbits(count >= times, bitorder="little")
        return pd.DataFrame({"block": rows["block"].iloc[:1].to_numpy(), "bits": [zlib.compress(bits.tobytes(), 1)]})

    return run


def seen(keys: DataFrame, rows: int, max_filter_mb: int, times: int):
    """A pandas UDF over hashes: whether column h of keys may hold one so many times (one or two) or more. rows: how many there are in keys."""
    spark = keys.sparkSession
    blocks = max(1, min(math.ceil(rows * CELLS_PER_ROW / (1 << BLOCK_BITS)), (max_filter_mb << 23) >> BLOCK_BITS))
    counted = keys.select("h").mapInPandas(_counted(blocks), "block int, once binary, twice binary")
    found = counted.groupBy("block").applyInPandas(_merged(times), "block int, bits binary").collect()
    table = np.zeros((blocks, 1 << (BLOCK_BITS - 3)), np.uint8)
    for r in found:
        table[r.block] = np.frombuffer(zlib.decompress(r.bits), np.uint8)
    held = spark.sparkContext.broadcast(table)

    @F.pandas_udf(T.BooleanType())
    def may_be(h: pd.Series) -> pd.Series:
        x = h.to_numpy(np.int64)
        block, cells = _block_of(x, blocks).astype(np.int64), _cells(x.view(np.uint64).astype(np.uint32))
        byte = held.value[block[:, None], cells >> np.uint32(3)]
        return pd.Series(((byte >> (cells & np.uint32(7)).astype(np.uint8)) & 1).all(axis=1))

    return may_be
