"""The corpus pipeline: five operators in a row over the documents table.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and
returns the columns of documents; the last returns the encoded corpus.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from logweir.llm import bpe, language_id, line_dedup, mixing, near
from logweir.llm.scratch import Scratch, Sealed, fresh, quoted


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled documents teach; those without letters or in no known one go."""
    return language_id.keep_known(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of fifty words or more go; a document of which nothing but white space is left goes whole."""
    sealed = Sealed(docs)
    text, chars = sealed["text"], sealed["n_chars"]
    told = line_dedup.line_dedup(sealed.rows, sealed["doc_id"], text)
    left = told.where((F.col("n_removed") == 0) | F.col(text).rlike(r"[^\x20\x09-\x0D]"))
    return left.select(*sealed.restored(**{chars: F.when(F.col("n_removed") > 0, F.length(text)).otherwise(F.col(chars)).cast("long")}))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of five-word shingle similarity 0.8 stays, of the smallest id; a row without id stays only where its group has none. Rows with one id or none are rows of their own."""
    scratch, row = Scratch(spark, "near"), fresh(docs, "row")
    keyed = scratch.keep(docs.withColumn(row, F.monotonically_increasing_id()))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("text"), F.xxhash64(*map(quoted, docs.columns)).alias("all"), row)
    told = scratch.keep(near.near_components(keyed, row).join(keyed.select(row, place.alias("place")), row), small=True)
    stays = told.groupBy("component_id").agg(F.min("place").alias("place")).select(f"place.{row}")
    gone = scratch.keep(told.join(stays, row, "left_anti").select(row), small=True)
    return keyed.join(gone, row, "left_anti").select(*map(quoted, docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    sealed = Sealed(docs)
    mixed = mixing.mix(sealed.rows, id_col=sealed["doc_id"], text_col=sealed["text"], source_col=sealed["source"])
    return mixing.emit(mixed).select(*sealed.restored())


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids and their digests. Decoding gives back the text."""
    told = bpe.encode_documents(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, words=1 << 16)  # workers of the stages before lie beside this one's
    return told.drop("text")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Language identification, fingerprints and byte-pair merges are beyond SQL; tests/llm/test_pipeline.py has the plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
