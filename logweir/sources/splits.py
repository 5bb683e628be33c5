"""CSV files of any size, read in splits.

Spark cuts a file at line ends, but a record goes on over lines while a quote is
open. What a line does is known without its neighbours: the state (outside or
inside quotes) that it leaves, for each state that it may begin in. These
steps are put together within each split, then over the splits of a file, one row
each; so every line learns its state, records are numbered, and only records of
several lines are brought together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..schema import PARSED
from ..tables import cut
from .documents import _PARSED, csv_header, csv_record, csv_rows, parsed_row, read_safely
from .records import assemble

# A cell begins quoted or not; behind a closing quote, and in a cell that doesn't begin with one, quotes are characters like others.
_QUOTED = r'"(?:[^"]++|"")*+"[^,]*+'
_CELL = rf'(?:{_QUOTED}|[^",][^,]*+)?+'
#: Lines that end outside quotes when they begin outside, and inside.
CLOSED = rf"^{_CELL}(?:,{_CELL})*+\z"
CLOSES = rf'^(?:[^"]++|"")*+"[^,]*+(?:,{_CELL})*+\z'


def _lines(spark: SparkSession, path: str | list[str], pattern: str | None) -> DataFrame:
    reader = spark.read.option("lineSep", "\n")
    text = (reader.option("pathGlobFilter", pattern) if pattern else reader).text(path)
    told = text.select(F.regexp_replace("_metadata.file_path", "^file:///", "file:/").alias("source"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("content"), F.col("_metadata.file_size").alias("bytes"))
    value = F.col("content").cast("string")
    return cut(told.select("*", F.is_valid_utf8(value).alias("valid"), (~value.rlike(CLOSED)).cast("int").alias("outside"), (~value.rlike(CLOSES)).cast("int").alias("inside")))


def _stated(lines: DataFrame) -> DataFrame:
    """lines with before and after: 1 where a quote is open at their start and end."""
    within = W.partitionBy("source", "split").orderBy("at")
    whole = lines.withColumn("fixed", F.when(F.col("outside") == F.col("inside"), F.col("outside"))).withColumn("turns", F.sum((F.col("outside") > F.col("inside")).cast("int")).over(within))
    last = F.last(F.when(F.col("fixed").isNotNull(), F.struct("fixed", "turns")), ignorenulls=True).over(within)
    whole = cut(whole.withColumn("last", last).drop("fixed", "outside", "inside", "content", "bytes"))  # last fixed state and turns since; without one, the split's own start
    splits = whole.groupBy("source", "split").agg(F.max_by(F.struct("last", "turns"), "at").alias("x"))
    over = W.partitionBy("source").orderBy("split")
    splits = splits.select("source", "split", F.col("x.last").alias("last"), F.col("x.turns").alias("turned")).withColumn("all", F.sum("turned").over(over))
    fixed = F.last(F.when(F.col("last").isNotNull(), F.struct(F.col("last.fixed").alias("fixed"), (F.col("all") - F.col("turned") + F.col("last.turns")).alias("turns"))), ignorenulls=True).over(over)
    ends = splits.withColumn("fixed", fixed).withColumn("end", F.pmod(F.coalesce("fixed.fixed", F.lit(0)) + F.col("all") - F.coalesce("fixed.turns", F.lit(0)), F.lit(2)))
    starts = cut(ends.select("source", "split", F.coalesce(F.lag("end").over(over), F.lit(0)).alias("start")))  # one row a split
    met = whole.join(starts, ["source", "split"])
    after = F.pmod(F.coalesce("last.fixed", F.col("start")) + F.col("turns") - F.coalesce("last.turns", F.lit(0)), F.lit(2))
    return met.withColumn("after", after).withColumn("before", F.coalesce(F.lag("after").over(within), F.col("start"))).select("source", "split", "at", "before", "after")


def csv_texts(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """(source, number, text): the records of CSV files, numbered from 1 in each file, blank ones too. A file with bytes that aren't UTF-8 reads as ISO-8859-1."""
    lines = _lines(spark, path, pattern)
    states = cut(_stated(lines))
    within = W.partitionBy("source", "split").orderBy("at")
    counted = states.groupBy("source", "split").agg(F.count_if(F.col("before") == 0).alias("n"))
    earlier = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counted.select("source", "split", earlier.alias("earlier"))
    numbered = states.withColumn("own", F.sum((F.col("before") == 0).cast("int")).over(within)).join(offsets, ["source", "split"])
    numbered = numbered.select("split", "at", "before", "after", (F.col("own") + F.col("earlier")).cast("int").alias("number"))
    ended = F.sum(F.octet_length("content") + 1) == F.max("bytes")  # by a line break
    of_file = cut(lines.groupBy("source").agg(F.bool_and("valid").alias("utf8"), F.when(ended, F.max_by("at", F.struct("split", "at"))).alias("last")))
    text = F.when(F.col("utf8"), F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    open_end = F.coalesce((F.col("at") == F.col("last")) & (F.col("after") == 1), F.lit(False))  # an open quote takes the file's last line break in
    told = lines.select("source", "split", "at", "content").join(numbered, ["split", "at"]).join(of_file, "source")
    told = told.select("source", "split", "at", "before", "after", "number", F.when(open_end, F.concat(text, F.lit("\n"))).otherwise(text).alias("text"))
    told = cut(told)
    single = told.where("before = 0 and after = 0").select("source", "number", "text")
    parts = told.where("before = 1 or after = 1").groupBy("source", "number").agg(F.array_sort(F.collect_list(F.struct("split", "at", "text"))).alias("parts"))
    return single.unionByName(parts.select("source", "number", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text")))


def parse_csv(spark: SparkSession, path: str | list[str], pattern: str | None = None, has_header: bool | None = None) -> DataFrame:
    """Rows of schema.PARSED of CSV files. The first record of each file names its columns. A record that can't be read is told with line 0 and its error; unlike with whole files, those after it are read all the same."""
    records = cut(csv_texts(spark, path, pattern))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    names, headed = csv_header(next(iter(csv_rows(row["text"])), []), has_header)
                except Exception as e:  # told when the record is parsed
                    names, headed = [], isinstance(e, StopIteration)
                out.append({"source": row["source"], "names": names, "headed": headed})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("source", pa.string()), ("names", pa.list_(pa.string())), ("headed", pa.bool_())]))

    headers = cut(records.where("number = 1").select("source", "text").mapInArrow(heads, "source string, names array<string>, headed boolean"))  # one row a file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                one = lambda: (r for cells in csv_rows(row["text"]) for r in csv_record(row["number"], cells, row["names"]))  # noqa: B023, E731
                out += [parsed_row(row["source"], "csv", r) for r in read_safely(one)]
            if out:
                yield pa.RecordBatch.from_pylist(out, _PARSED)

    return records.join(headers, "source").where(~(F.col("headed") & (F.col("number") == 1))).select("source", "number", "text", "names").mapInArrow(run, PARSED)


def ingest_csv(spark: SparkSession, path: str | list[str], pattern: str | None = None, reference_year: int | None = None, has_header: bool | None = None) -> DataFrame:
    """Log records of CSV files, read in splits: those of readers.ingest, record ids included."""
    return assemble(parse_csv(spark, path, pattern, has_header), "csv", reference_year)
