"""Pages of a sorted table: rows lie in ranges of the order, and a page reads only the ranges that it falls in."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Column of the range; also the name of its folders.
RANGE = "page_range"


class Pages:
    """A table written in ranges of ``order``, with each range's rows and last place.

    The order has to tell all rows apart (end it with an id), or equal rows may
    change pages between calls. Nulls come first, last if descending. What the
    driver holds is a row a range.
    """

    def __init__(self, spark: SparkSession, path: str, order: Sequence[str], descending: bool = False):
        self.spark, self.path, self.order, self.descending = spark, path.rstrip("/"), list(order), descending

    @classmethod
    def write(cls, rows: DataFrame, path: str, order: Sequence[str], ranges: int, descending: bool = False) -> Pages:
        """Sorts rows into so many ranges; ValueError for a column named as the ranges are. What was there is replaced."""
        if RANGE in (c.lower() for c in rows.columns):
            raise ValueError(f"a column is named {RANGE}")
        pages = cls(rows.sparkSession, path, order, descending)
        ranged = rows.repartitionByRange(ranges, *pages._sorted()).sortWithinPartitions(*pages._sorted()).withColumn(RANGE, F.spark_partition_id())
        ranged.write.mode("overwrite").partitionBy(RANGE).parquet(f"{pages.path}/rows")
        ends = (F.min if descending else F.max)(F.struct(*order)).alias("last")
        rows.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{pages.path}/schema")  # an empty table has no range to tell its columns
        told = pages._rows().groupBy(RANGE).agg(F.count("*").alias("n"), ends)
        told.coalesce(1).write.mode("overwrite").parquet(f"{pages.path}/ranges")
        return pages

    def _sorted(self) -> list[Column]:
        return [F.col(c).desc_nulls_last() if self.descending else F.col(c).asc_nulls_first() for c in self.order]

    def _rows(self) -> DataFrame:
        columns = self.spark.read.parquet(f"{self.path}/schema").schema
        return self.spark.read.schema(T.StructType([*columns, T.StructField(RANGE, T.IntegerType())])).parquet(f"{self.path}/rows")

    def _ranges(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/ranges")

    def _later(self, place: Column, cursor: Sequence[Any]) -> Column:
        kinds = self._ranges().schema["last"].dataType
        at = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(cursor, kinds, strict=True)])
        return place < at if self.descending else place > at

    def _taken(self, wanted: list[int], offset: int, size: int) -> DataFrame:
        """Of the rows in those ranges, size after offset."""
        own = self._rows().where(F.col(RANGE).isin(wanted) if wanted else F.lit(False)).drop(RANGE)
        return own.orderBy(*self._sorted()).offset(offset).limit(size)

    def total(self) -> int:
        """The rows of all ranges, from their counts."""
        return self._ranges().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def page(self, number: int, size: int) -> DataFrame:
        """The page of that number, from 0; empty past the end."""
        if number < 0 or size < 1:
            raise ValueError("pages are counted from 0 and hold a row at least")
        begin = number * size
        ranges = self._ranges().select(RANGE, "n").orderBy(RANGE).collect()
        starts = [0, *accumulate(r.n for r in ranges)]
        held = [(r[RANGE], s) for r, s in zip(ranges, starts) if s < begin + size and s + r.n > begin]
        return self._taken([r for r, _ in held], begin - held[0][1] if held else 0, size)

    def after(self, cursor: Sequence[Any], size: int) -> DataFrame:
        """The rows that follow a place in the order, told by its values; they need not stand in the table."""
        if size < 1:
            raise ValueError("a page holds a row at least")
        wanted, sure = [], 0
        for r in self._ranges().where(self._later(F.col("last"), cursor)).select(RANGE, "n").orderBy(RANGE).collect():
            if sure >= size:
                break
            sure += r.n if wanted else 0  # how many of the first range follow isn't known
            wanted.append(r[RANGE])
        own = self._rows().where(F.col(RANGE).isin(wanted) if wanted else F.lit(False)).where(self._later(F.struct(*self.order), cursor))
        return own.drop(RANGE).orderBy(*self._sorted()).limit(size)
