"""SimHash near-duplicates by similarity: word shingles with a Jaccard similarity of ``least`` or more.

At 0.8 a fingerprint differs in some 15 of 100 bits, so no block of it is sure to be left
whole, and the blocks of ``simhash`` can't route. Here fingerprints of 256 bits meet under
shared shingles instead. Of each text ANCHORS shingles are the least under as many
orders; two texts of similarity t choose none alike with a chance of (1 - t) ** ANCHORS, 1 in
10 million at 0.8. Common shingles are no anchors: all shingles of all texts are counted, first
by CELLS cells, then those in cells that could hold a common one by themselves, so each common one is known with
its exact count. Texts with a fifth or more of such shingles are routed by a prefix besides: the first
n - ceil(t n) + 1 of their n shingles, rare ones first; two texts of similarity t always share one
of these. What is common decides the work, not the result.

In each group the Gray-order index finds the fingerprints within a radius of seven standard deviations
above the mean at ``least``, and a second sketch cuts what can't be similar: PARITIES
bits tell the parity of the shingles that fall on them, and two texts differ in as many shingles as in bits
at least. Pairs that are left are verified by their shingles. A task first
gives a spanning forest of its pairs; when these are verified, only pairs whose texts aren't in one
component yet are. A group of more than BLOCK texts becomes cells of two blocks each.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .components import components
from .scratch import Scratch, small_batches, trim
from .simhash import GrayIndex

WIDTH = 5
LEAST = 0.8
COMMON = 5
MOST_COMMON = 200_000
CELLS = 1 << 20
SLICE = 1 << 12
MUCH_COMMON = 0.2
ANCHORS = 10
WORDS = 4  # of 64 bits, of a fingerprint
PARITIES = 512
BLOCK = 4096
ROUTES = 1 << 15
_ODD = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) % (1 << 64) for k in range(1, ANCHORS + WORDS + 1)], np.uint64)


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted; a text of fewer words is one shingle."""
    words = text.encode("utf-8").lower().split()  # as simhash.fingerprint
    parts = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) > width else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, 42) for s in parts), np.uint64))


def _mixed(s: np.ndarray, k: int) -> np.ndarray:
    """The k-th other hash of hashes."""
    h = (s ^ (s >> np.uint64(29))) * _ODD[k]
    return h ^ (h >> np.uint64(32))


def sketch(s: np.ndarray) -> bytes:
    """The fingerprint and the parities of a text's shingles."""
    ones = np.zeros(64 * WORDS, np.int64)
    for i in range(0, len(s), 1 << 14):
        part = s[i : i + (1 << 14)]
        every = np.stack([part, *(_mixed(part, ANCHORS + k) for k in range(1, WORDS))], axis=1)
        ones += np.unpackbits(every.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    odd = np.bincount((_mixed(s, ANCHORS) % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(np.concatenate([ones * 2 > len(s), odd.astype(bool)]), bitorder="little").tobytes()


def radius(least: float) -> int:
    """The bits that fingerprints of similarity least differ in at most, but for one pair in a million millions."""
    bits = 64 * WORDS
    mean = bits * math.acos(2 * least / (1 + least)) / math.pi
    return math.ceil(mean + 7 * math.sqrt(mean * (1 - mean / bits)))


def keys(s: np.ndarray, common: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """The shingles by which a text meets those of similarity least."""
    weight = np.zeros(len(s), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        weight = np.where(common[at] == s, counts[at], 0)
    rare = s[weight == 0]
    found = [rare[[int(np.argmin(_mixed(rare, k))) for k in range(ANCHORS)]]] if len(rare) else []
    if len(s) - len(rare) > MUCH_COMMON * len(s):
        found.append(s[np.lexsort((s, weight))[: len(s) - math.ceil(least * len(s) - 1e-9) + 1]])
    return np.unique(np.concatenate(found))


def _cell(s: np.ndarray) -> np.ndarray:
    return (_mixed(s, 0) % np.uint64(CELLS)).astype(np.int64)


def _celled(width: int):
    """Texts to how many of their shingles fall in each cell, a row a slice of cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for t in batch.column(0):
                np.add.at(total, _cell(shingles(t.as_py() or "", width)), 1)
        cut = total.reshape(-1, SLICE)
        held = np.flatnonzero(cut.any(axis=1))
        packed = [zlib.compress(cut[i].tobytes(), 1) for i in held]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(packed, pa.binary())], names=["slice", "counts"])
        trim()

    return run


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    """One slice of all tasks."""
    total = np.zeros(SLICE, np.int64)
    for packed in rows["counts"]:
        total += np.frombuffer(zlib.decompress(packed), np.int64)
    cells = np.flatnonzero(total)
    return pd.DataFrame({"cell": rows["slice"].iloc[0] * SLICE + cells, "n": total[cells]})


def _suspects(width: int, full):
    """Texts to their shingles in full cells, counted by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = np.unpackbits(np.frombuffer(full.value, np.uint8)).astype(bool)
        for batch in batches:
            sets = [s[may[_cell(s)]] for s in (shingles(t.as_py() or "", width) for t in batch.column(0))]
            s, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(n, pa.int64())], names=["s", "n"])
        trim()

    return run


def _common(texts: DataFrame, width: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """The common shingles, sorted, and how many of all texts have each.

    A shingle is common if COMMON texts or more have it, and one of MOST_COMMON of all texts'
    shingles or more is it; so there are no more than MOST_COMMON, and none is left out. A cell counts no less than
    any of its shingles.
    """
    sc = texts.sparkSession.sparkContext
    text = texts.select("text__")
    cells = scratch.keep(text.mapInArrow(_celled(width), "slice long, counts binary").groupBy("slice").applyInPandas(_summed, "cell long, n long"), texts=True, small=True)
    least = max(COMMON, math.ceil((cells.agg(F.sum("n")).first()[0] or 0) / MOST_COMMON))
    full = np.zeros(CELLS, bool)
    with small_batches(texts.sparkSession):
        full[cells.where(F.col("n") >= least).select("cell").toArrow().column("cell").to_numpy()] = True
    scratch.drop(cells)
    if not full.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    counted = text.mapInArrow(_suspects(width, sc.broadcast(np.packbits(full).tobytes())), "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    found = scratch.keep(counted, texts=True, small=True)
    told = found.toArrow()
    scratch.drop(found)
    s, n = told.column("s").to_numpy().view(np.uint64), told.column("n").to_numpy()
    order = np.argsort(s)
    return s[order], n[order]


def _sets(width: int):
    """(row, text) to the row's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shingles(t.as_py() or "", width).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.int64()))], names=["row__", "s"])

    return run


_CODED = "row__ long, set long, n long, sketch binary, keys array<long>"


def _coded(width: int, least: float, common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py() or "", width) for t in batch.column(1)]
            columns = [
                pa.array([xxhash.xxh64_intdigest(s.tobytes(), 7) - (1 << 63) for s in sets], pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([sketch(s) for s in sets], pa.binary()),
                pa.array([keys(s, *common.value, least).view(np.int64) for s in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["row__", "set", "n", "sketch", "keys"])

    return run


def _pairs(least: float, label_col: str | None):
    """A whole partition of (route, set, n, sketch[, label]): pairs of sets of one route that may be similar, one forest of them where there are no labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held) if (held := [b for b in batches if b.num_rows]) else None
        if table is None:
            return
        route = table.column("route").to_numpy()
        _, group, size = np.unique(route, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(size[group] > 1)
        if not len(shared):
            return
        table, group = table.take(pa.array(shared)), group[shared]
        sets, n = table.column("set").to_numpy(), table.column("n").to_numpy()
        bits = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(sets), -1)
        index = GrayIndex(group, bits[:, :WORDS])
        sets, n, odd = sets[index.order], n[index.order], bits[index.order, WORDS:]
        label = np.unique(table.column(label_col).to_numpy()[index.order], return_inverse=True)[1] if label_col else None

        def also(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            may = np.minimum(n[a], n[b]) >= least * np.maximum(n[a], n[b]) - 1e-9
            apart = np.bitwise_count(odd[a] ^ odd[b]).sum(axis=1, dtype=np.int64)
            return may & (apart <= (n[a] + n[b]) * ((1 - least) / (1 + least)) + 1e-6)

        for a, b in index.pairs(radius(least), label, also):
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(sets[a], sets[b])), pa.array(np.minimum(sets[a], sets[b]))], names=["u", "v"])

    return run


def _verified(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, x, y = (batch.column(k) for k in ("u", "v", "x", "y"))
            ok = []
            for i in range(batch.num_rows):
                a, b = x[i].values.to_numpy(), y[i].values.to_numpy()
                same = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(same >= least * (len(a) + len(b) - same) - 1e-9)
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([u.filter(ok), v.filter(ok)], names=["u", "v"])

    return run


def near_components(docs: DataFrame, id_col: str, text_col: str = "text", width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """(id_col, component_id) of the rows that aren't alone: id_col is a long that no two rows share, component_id the least of the component.

    Texts with a Jaccard similarity of least or more are linked, and links make
    components. A null text or one without words equals any other such. Of pairs at
    the least similarity one in ten million isn't met; none below it is linked. Where many texts are just
    less similar than that, each such pair that the sketches can't tell is verified.
    """
    scratch = Scratch(docs.sparkSession, "near")
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.col(id_col).alias("row__"), F.col(text_col).alias("text__"))
    common = sc.broadcast(_common(texts, width, scratch))
    coded = scratch.keep(texts.mapInArrow(_coded(width, least, common), _CODED), texts=True)
    sets = scratch.keep(coded.groupBy("set").agg(F.min("row__").alias("rep"), F.count("*").alias("rows"), *(F.first(c).alias(c) for c in ("n", "sketch", "keys"))))
    keyed = sets.select("set", F.explode("keys").alias("key"))
    shared = scratch.keep(keyed.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1"), small=True)
    # a group of one block is a cell of its own; of more blocks, every two make a cell
    blocks, own = F.ceil(F.col("texts") / BLOCK), F.pmod(F.xxhash64("set", F.lit(1)), F.ceil(F.col("texts") / BLOCK))
    cells = keyed.join(shared, "key").select("set", "key", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    routed = cells.select("set", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("route"))
    met = scratch.keep(routed.join(sets.select("set", "n", "sketch"), "set"))
    scratch.release()
    parts = met.count() // ROUTES + sc.defaultParallelism

    def candidates(rows: DataFrame, label: str | None) -> DataFrame:
        return scratch.keep(rows.repartition(parts, "route").mapInArrow(_pairs(least, label), "u long, v long").distinct(), small=True)

    def verified(pairs: DataFrame) -> DataFrame:
        x, y = whole.select(F.col("row__").alias("u"), F.col("s").alias("x")), whole.select(F.col("row__").alias("v"), F.col("s").alias("y"))
        return scratch.keep(pairs.join(x, "u").join(y, "v").select("u", "v", "x", "y").mapInArrow(_verified(least), "u long, v long"), texts=True, small=True)

    tree = candidates(met, None)
    asked = tree.select(F.explode(F.array("u", "v")).alias("set")).distinct()
    told = asked.join(sets.select("set", "rep"), "set").select("set", F.col("rep").alias("row__")).join(texts, "row__").select("set", "text__")
    whole = scratch.keep(told.mapInArrow(_sets(width), "row__ long, s array<long>"), texts=True)
    linked = verified(tree)
    label = components(linked, scratch, small=True).withColumnsRenamed({"u": "set", "v": "label"})
    placed = met.join(label, "set", "left").withColumn("label", F.coalesce("label", "set"))
    more = verified(candidates(placed, "label"))
    scratch.drop(met, whole)
    scratch.release()
    centre = components(linked.unionByName(more), scratch, small=True).withColumnsRenamed({"u": "set", "v": "centre"})
    placed = scratch.keep(sets.select("set", "rep", "rows").join(centre, "set", "left").withColumn("centre", F.coalesce("centre", "set")), small=True)
    crowd = scratch.keep(placed.groupBy("centre").agg(F.min("rep").alias("component_id"), F.sum("rows").alias("rows")).where("rows > 1").drop("rows"), small=True)
    answer = scratch.keep(placed.join(crowd, "centre").select("set", "component_id"), small=True)
    return coded.select(F.col("row__").alias(id_col), "set").join(answer, "set").select(id_col, "component_id")
