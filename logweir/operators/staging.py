"""The staging area as DataFrame operators: union, first-wins dedup, filters, statistics, pages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def stage(sources: Sequence[DataFrame], order: Sequence[str] = ("source", "line_number")) -> DataFrame:
    """All records of all sources with ``duplicates``, how many had the same record_id; the first of them stays, by position of its source and then order."""
    every = reduce(DataFrame.unionByName, [s.withColumn("arrival", F.lit(i)) for i, s in enumerate(sources)])
    return keep_first(every, "record_id", ["arrival", *order]).drop("arrival")


def keep_first(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row of each key, the first by order (nulls last, as in SQL), with ``duplicates``. Grouped with partial aggregation, so a hot key costs one row a task."""
    others = [c for c in rows.columns if c != key]
    place = F.struct(*[part for c in order for part in (F.col(c).isNull(), F.col(c))])
    told = rows.groupBy(key).agg(F.min_by(F.struct(*others), place).alias("r"), (F.count("*") - 1).alias("duplicates"))
    return told.select(key, *[F.col("r")[c].alias(c) for c in others], "duplicates")


def clean_records(records: DataFrame) -> DataFrame:
    return records.where("not corrupted")


def by_level(records: DataFrame, *levels: str) -> DataFrame:
    """Clean records of the levels, given in any case."""
    return records.where(~F.col("corrupted") & F.col("level").isin(*[x.upper() for x in levels]))


def by_format(records: DataFrame, *formats: str) -> DataFrame:
    return records.where(~F.col("corrupted") & F.col("format").isin(*formats))


def select_records(records: DataFrame, corrupted: bool | None = None, level: str | None = None, fmt: str | None = None, search: str | None = None, where: Column | None = None) -> DataFrame:
    """The records that meet every condition given; search is a substring of message, raw or source in any case."""
    tests = []
    if corrupted is not None:
        tests.append(F.col("corrupted") == corrupted)
    if level:
        tests.append(F.upper(F.col("level")) == level.upper())
    if fmt:
        tests.append(F.col("format") == fmt)
    if search:
        tests.append(F.lower(F.concat_ws(" ", "message", "raw", "source")).contains(search.lower()))
    if where is not None:
        tests.append(where)
    return reduce(DataFrame.where, tests, records)


def totals(staged: DataFrame) -> DataFrame:
    """One row: total_seen, clean, corrupted, duplicates and success_rate, 0 where there is nothing."""
    kept = F.count("*")
    return staged.agg(
        (kept + F.coalesce(F.sum("duplicates"), F.lit(0))).alias("total_seen"), F.count_if(~F.col("corrupted")).alias("clean"), F.count_if("corrupted").alias("corrupted"), F.coalesce(F.sum("duplicates"), F.lit(0)).alias("duplicates"),
        F.when(kept > 0, F.count_if(~F.col("corrupted")) / kept).otherwise(0.0).alias("success_rate"),
    )


def distribution(staged: DataFrame) -> DataFrame:
    """(kind, value, n): clean records by level (UNKNOWN where there is none) and by format, corrupted ones by reason. One pass, one shuffle."""
    clean = ~F.col("corrupted")
    facts = F.array(
        F.when(clean, F.struct(F.lit("level").alias("kind"), F.coalesce("level", F.lit("UNKNOWN")).alias("value"))), F.when(clean, F.struct(F.lit("format").alias("kind"), F.col("format").alias("value"))),
        F.when(~clean, F.struct(F.lit("corruption_reason").alias("kind"), F.col("corruption_reason").alias("value"))),
    )
    return staged.select(F.explode(F.array_compact(facts)).alias("f")).groupBy(F.col("f.kind").alias("kind"), F.col("f.value").alias("value")).agg(F.count("*").alias("n"))


def per_source(staged: DataFrame) -> DataFrame:
    """A row for each source: format, total, clean, corrupted and success percentage to one place."""
    clean = F.count_if(~F.col("corrupted"))
    return staged.groupBy("source", "format").agg(F.count("*").alias("total"), clean.alias("clean"), F.count_if("corrupted").alias("corrupted"), F.round(100 * clean / F.count("*"), 1).alias("success_pct"))


def sort_records(records: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """By any column as text; null sorts as empty."""
    key = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return records.orderBy(key.desc() if descending else key.asc(), "record_id")


def page(records: DataFrame, number: int = 1, per_page: int = 50) -> tuple[DataFrame, int, int]:
    """A page of an ordered table, all rows and all pages; per_page is held between 10 and 200, the number between 1 and the last."""
    size = min(200, max(10, per_page))
    total = records.count()
    pages = max(1, -(-total // size))
    return records.offset((min(max(1, number), pages) - 1) * size).limit(size), total, pages


def preview(records: DataFrame, width: int = 1000) -> DataFrame:
    return records.withColumn("raw", F.substring("raw", 1, width))


def report(staged: DataFrame) -> DataFrame:
    """(section, name, n): the totals in their order, then levels, formats and corruption reasons, the most frequent first."""
    whole = totals(staged)
    names = ("total_seen", "clean", "corrupted", "duplicates")
    first = whole.select(F.explode(F.array(*[F.struct(F.lit(0).alias("part"), F.lit(-i).cast("long").alias("place"), F.lit("totals").alias("section"), F.lit(n).alias("name"), F.col(n).cast("long").alias("n")) for i, n in enumerate(names)])).alias("x")).select("x.*")
    rest = distribution(staged).select(F.lit(1).alias("part"), F.col("n").alias("place"), F.col("kind").alias("section"), F.col("value").alias("name"), "n")
    return first.unionByName(rest).orderBy("part", "section", F.col("place").desc(), "name").select("section", "name", "n")
