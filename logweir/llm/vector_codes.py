"""Vector code compression: product quantisation in whole numbers by Lloyd's rounds over resident members.

A member is one part of one vector. Members lie in tables dealt by their owner:
the part's position, the codebook entry they belong to, and a salt that splits
an entry of more than ``owner_rows`` members over several owners. In a round
each resident member is held against the codebook where it lies; members that
keep their entry stay in that table, and only those that change it go through
a shuffle to their new owner. The owners then sum their members; what meets
between tasks is one row for each owner's sum. The codebook has ``entries``
times the vector's width numbers whatever the input's size, and that alone is
held in the driver and sent to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .scratch import Scratch, Sealed

ROW = "row"
EXACT = 1 << 53


@dataclass
class Codes:
    """rows: the kept input rows with code (array of entry numbers, in part order) and error; books: part, entry, vector."""

    rows: DataFrame
    books: DataFrame


def finite(vec: Column) -> Column:
    """Whether a vector is there, and each of its components is a number."""
    return F.coalesce(vec.isNotNull() & F.forall(vec, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))), F.lit(False))


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each part's nearest entry, ties to the lower, and its squared distance; exact in whole numbers."""
    if not len(parts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    most = int(max(np.abs(parts).max(initial=0), np.abs(book).max(initial=0)))
    if 4 * most * most * max(parts.shape[1], 1) < EXACT:  # doubles hold every sum on the way
        x, c = parts.astype(np.float64), book.astype(np.float64)
        far = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]
    else:
        far = np.stack([((parts - entry) ** 2).sum(1) for entry in book], 1)
    best = far.argmin(1)
    return best, far[np.arange(len(parts)), best].astype(np.int64)


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def assigned(members: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """members with the nearest entry of the codebook, its distance, and whether that is another entry than before. No shuffle."""
    width = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            position, before = batch.column("position").to_numpy(), batch.column("entry").to_numpy()
            parts = matrix(batch.column("part"), width)
            entry, far = np.zeros(len(parts), np.int32), np.zeros(len(parts), np.int64)
            for p in np.unique(position):
                own = position == p
                entry[own], far[own] = nearest(parts[own], books[p])
            yield pa.RecordBatch.from_arrays([batch.column(ROW), batch.column("position"), pa.array(entry), batch.column("part"), pa.array(far), pa.array(entry != before)], names=[ROW, "position", "entry", "part", "far", "moved"])

    kind = T.StructType([members.schema[c] for c in (ROW, "position", "entry", "part")]).add("far", "long").add("moved", "boolean")
    return members.mapInArrow(run, kind)


def sums(members: DataFrame, parts: int, entries: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Count and componentwise sum of each entry's members: each task adds up the owners it holds, and one row for each of them and component meets the others'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            owner = batch.column("position").to_numpy().astype(np.int64) * entries + batch.column("entry").to_numpy()
            np.add.at(total, owner, matrix(batch.column("part"), width))
            np.add.at(count, owner, 1)
        there = np.flatnonzero(count)
        for some in np.array_split(there, len(there) // 1024 + 1):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], names=["owner", "n", "total"])

    told = members.select("position", "entry", "part").mapInArrow(run, "owner long, n long, total array<long>")
    met = told.select("owner", "n", F.posexplode("total")).groupBy("owner", "pos").agg(F.sum("n").alias("n"), F.sum("col").alias("total")).toPandas()
    total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
    total[met["owner"].to_numpy(), met["pos"].to_numpy()] = met["total"].to_numpy()
    count[met["owner"].to_numpy()] = met["n"].to_numpy()
    return count.reshape(parts, entries), total.reshape(parts, entries, width)


def owned(moved: DataFrame, counts: np.ndarray, owner_rows: int) -> DataFrame:
    """Members dealt to their new owners: position, entry, and as many salts as the entry's members fill owners."""
    entries = counts.shape[1]
    salts = F.array(*(F.lit(int(n) // owner_rows + 1) for n in counts.ravel()))
    count = F.element_at(salts, (F.col("position") * entries + F.col("entry") + 1).cast("int"))
    return moved.withColumn("salt", F.pmod(F.xxhash64(ROW), count)).repartition("position", "entry", "salt").drop("salt")


def compress(
    vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024,
    id_col: str = "vec_id", vec_col: str = "embedding", owner_rows: int = 1 << 16,
) -> Codes:
    """Codes of ``parts`` entry numbers for each vector, the codebooks, and each vector's squared error.

    A component x counts as floor(scale * x). The codebook of each part starts as
    that part of the ``entries`` smallest ids' vectors, nulls last, ties by
    vector; with fewer rows it is shorter. In each round every part goes to its
    nearest entry, ties to the lower number, and each entry becomes its parts'
    componentwise floor of the mean; an entry without parts stays as it is.

    Vectors that are null or hold a null or non-finite component are left out.
    The width is that of the first vector, in that order, whose length is a
    positive multiple of ``parts``; vectors of another length, or with a
    component so large that distances could pass 64 bits, stay as rows with null
    code and error and don't bear on the codebook. Repeated rows and ids are
    rows of their own. Other columns pass through; input columns named like the
    added ones are replaced.
    """
    spark = vectors.sparkSession
    scratch, sealed = Scratch(spark, "codes"), Sealed(vectors, "code", "error")
    key, vec = F.col(sealed[id_col]), F.col(sealed[vec_col])
    base = scratch.keep(sealed.rows.where(finite(vec)).withColumn(ROW, F.monotonically_increasing_id()))
    whole = F.transform(vec, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    lengths = base.where((F.size(vec) > 0) & (F.size(vec) % parts == 0))
    first = lengths.orderBy(key.asc_nulls_last(), vec).select(F.size(vec)).first()
    if first is None:
        coded = base.select(ROW, F.lit(None).cast("array<int>").alias("code"), F.lit(None).cast("long").alias("error"))
        return Codes(base.join(coded, ROW, "left").select(*sealed.restored(), "code", "error"), _books(spark, []))
    width = first[0] // parts
    least = int((float(1 << 62) / width) ** 0.5 / 2)
    fit = lengths.where(F.size(vec) == first[0]).where(F.forall(whole, lambda x: F.abs(x) <= least))
    start = np.array([r[0] for r in fit.orderBy(key.asc_nulls_last(), vec).limit(entries).select(whole).collect()], np.int64)  # entries x width numbers
    if not len(start):
        start = np.zeros((1, first[0]), np.int64)
    books = [start[:, p * width : (p + 1) * width] for p in range(parts)]
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice(whole, p * width + 1, width))
    members = scratch.keep(fit.select(ROW, F.posexplode(cut).alias("position", "part")).select(ROW, "position", F.lit(-1).alias("entry"), "part"))
    tables = [members]
    for _ in range(rounds):
        told = scratch.keep(assigned(members, books).drop("far"), "moved")
        stays, moved = told.where("not moved").drop("moved"), told.where("moved").drop("moved")
        counts = np.zeros((parts, books[0].shape[0]), np.int64)
        for p, e, n in told.groupBy("position", "entry").count().collect():  # parts x entries rows at most
            counts[p, e] = n
        arrived = scratch.keep(owned(moved, counts, owner_rows))
        members = stays.unionByName(arrived)
        scratch.drop(*tables)
        tables = [told, arrived]
        count, total = sums(members, parts, books[0].shape[0], width)
        books = [np.where(count[p][:, None] > 0, total[p] // np.maximum(count[p], 1)[:, None], books[p]) for p in range(parts)]
    last = scratch.keep(assigned(members, books).select(ROW, "position", "entry", "far"))
    scratch.drop(*tables)
    code = F.array(*(F.max(F.when(F.col("position") == p, F.col("entry"))) for p in range(parts)))
    coded = last.groupBy(ROW).agg(code.alias("code"), F.sum("far").alias("error"))
    rows = base.join(coded, ROW, "left").select(*sealed.restored(), "code", "error")
    return Codes(rows, _books(spark, books))


def _books(spark: SparkSession, books: list[np.ndarray]) -> DataFrame:
    return spark.createDataFrame([(p, e, vector.tolist()) for p, book in enumerate(books) for e, vector in enumerate(book)], "part int, entry int, vector array<long>")


def decoded(rows: DataFrame, books: DataFrame, code_col: str = "code") -> DataFrame:
    """rows with approx, the vector that the code stands for, in scaled whole numbers; null where the code is."""
    flat = books.groupBy().agg(F.map_from_entries(F.collect_list(F.struct(F.struct("part", "entry"), "vector"))).alias("book"))  # one row, of entries x width numbers
    code = F.col(code_col)
    parts = F.transform(code, lambda e, p: F.element_at("book", F.struct(p.alias("part"), e.alias("entry"))))
    return rows.crossJoin(F.broadcast(flat)).withColumn("approx", F.when(code.isNotNull(), F.flatten(parts))).drop("book")
