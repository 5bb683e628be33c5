"""Files, folders, texts and bytes to log records."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.text import decode_bytes, split_lines
from ..operators.detect import detect_format
from ..schema import FORMATS
from ..tables import cut
from . import documents, lines
from .records import assemble

LINE_PARSERS: dict[str, Callable[..., DataFrame]] = {
    "plain_text": lines.parse_plain_text, "key_value": lines.parse_key_value, "logfmt": lines.parse_logfmt, "delimiter": lines.parse_delimiter,
    "tsv": lines.parse_tsv, "syslog": lines.parse_syslog, "binary": lines.parse_binary,
}
#: Formats of which each line stands for itself: their files can be read in splits.
BY_LINE = ("plain_text", "key_value", "logfmt", "syslog")


def supported_formats() -> list[str]:
    return sorted({*FORMATS, *LINE_PARSERS})


def register_parser(name: str, parser: Callable[..., DataFrame]) -> None:
    """A format of the caller's, by override: parser takes files (source, content, format, text) and gives rows of schema.PARSED. A name in use is replaced."""
    LINE_PARSERS[name] = parser


def unregister_parser(name: str) -> bool:
    if name in FORMATS:
        raise ValueError(f"{name} is built in")
    return LINE_PARSERS.pop(name, None) is not None


def read_files(spark: SparkSession, path: str | list[str], pattern: str | None = None, recursive: bool = False) -> DataFrame:
    """source and content of each file; every file is one row, as formats with headers or nesting need it whole."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(F.col("path").alias("source"), "content")


def list_files(spark: SparkSession, path: str | list[str], pattern: str | None = None, recursive: bool = False) -> DataFrame:
    """source, length and detected format of each file, sorted by source."""
    files = read_files(spark, path, pattern, recursive)
    return files.select("source", F.length("content").alias("length"), detect_format(F.col("content"), F.col("source")).alias("format")).orderBy("source")


def read_lines(spark: SparkSession, path: str | list[str], fmt: str, pattern: str | None = None) -> DataFrame:
    """source, format, line_number and raw of the lines that aren't blank, for formats in BY_LINE and files of any size.

    A file is read in splits; lines are numbered in each and moved on by the counts of the splits before. Bytes that aren't UTF-8 read as U+FFFD here.
    """
    if fmt not in BY_LINE:
        raise ValueError(f"a line of {fmt} doesn't stand for itself")
    reader = spark.read.option("pathGlobFilter", pattern) if pattern else spark.read
    text = reader.text(path).select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value")
    told = text.select("source", "split", "at", F.posexplode(split_lines(F.make_valid_utf8("value"))).alias("part", "raw"))
    told = cut(told.withColumn("n", F.row_number().over(W.partitionBy("source", "split").orderBy("at", "part"))))
    sizes = told.groupBy("source", "split").agg(F.max("n").alias("lines"))
    before = sizes.withColumn("before", F.coalesce(F.sum("lines").over(W.partitionBy("source").orderBy("split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("lines")
    return told.join(before, ["source", "split"]).select("source", F.lit(fmt).alias("format"), (F.col("n") + F.col("before")).cast("int").alias("line_number"), "raw")


def ingest_lines(spark: SparkSession, path: str | list[str], fmt: str, pattern: str | None = None, reference_year: int | None = None) -> DataFrame:
    """Log records of files of a line format, read in splits."""
    return assemble(LINE_PARSERS[fmt](read_lines(spark, path, fmt, pattern)), fmt, reference_year)


def from_bytes(spark: SparkSession, items: list[tuple[str, bytes]]) -> DataFrame:
    return spark.createDataFrame([(s, bytearray(b)) for s, b in items], "source string, content binary")


def from_text(texts: DataFrame, source_col: str = "source", text_col: str = "text") -> DataFrame:
    return texts.select(F.col(source_col).alias("source"), F.encode(F.col(text_col), "UTF-8").alias("content"))


def with_format(files: DataFrame, format_override: str | None = None, name_col: str = "source") -> DataFrame:
    """files with format and text. Unknown formats are plain text."""
    if format_override is not None:
        fmt = F.lit(format_override if format_override in supported_formats() else "plain_text")
    else:
        fmt = detect_format(F.col("content"), F.col(name_col))
    return files.withColumn("format", fmt).withColumn("text", decode_bytes(F.col("content")))


def parse_files(files: DataFrame, formats: tuple[str, ...] = FORMATS, reference_year: int | None = None, options: dict[str, dict] | None = None) -> DataFrame:
    """Log records of files with source, content, format and text: a branch for each format, put together."""
    options = options or {}
    branches = []
    for fmt in formats:
        own = files.where(F.col("format") == fmt)
        parsed = LINE_PARSERS[fmt](own, **options.get(fmt, {})) if fmt in LINE_PARSERS else documents.parse_documents(own, **{fmt: options.get(fmt, {})})
        branches.append(assemble(parsed, fmt, reference_year))
    return reduce(DataFrame.unionByName, branches)


def ingest(files: DataFrame, format_override: str | None = None, reference_year: int | None = None, options: dict[str, dict] | None = None, include_corrupted: bool = True) -> DataFrame:
    """Detects (unless told), decodes and parses files with source and content. What can't be read of a file is told by ``errors``.

    Detection runs once: files are written in folders by format, and each parser reads its own.
    """
    if format_override is None:
        found = cut(files.select("source", "content", detect_format(F.col("content"), F.col("source")).alias("format")), "format")
        told, formats = found.withColumn("text", decode_bytes(F.col("content"))), FORMATS
    else:
        told, formats = with_format(files, format_override), (format_override if format_override in supported_formats() else "plain_text",)
    records = parse_files(told, formats, reference_year, options)
    return records if include_corrupted else records.where("not corrupted")


def errors(records: DataFrame) -> DataFrame:
    """(source, error) of the files that couldn't be read to their end."""
    return records.where(F.col("corrupted") & (F.col("line_number") == 0)).select("source", F.regexp_replace("corruption_reason", "^file_error: ", "").alias("error"))


def ingest_path(spark: SparkSession, path: str, source_label: str | None = None, pattern: str | None = None, recursive: bool = False, **options) -> DataFrame:
    files = read_files(spark, path, pattern, recursive)
    return ingest(files.withColumn("source", F.lit(source_label)) if source_label else files, **options)
