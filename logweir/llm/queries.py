"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, conversation_repair, exact_dedup, hnsw, katz, language_id, line_dedup, mixing, personal_data, quotation, simhash, url_filter, vector_codes
from .scratch import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = line_dedup.line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return told.select("doc_id", "n_lines", "n_removed", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"), F.sha2("text", 256).alias("text_sha256"))


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language_id.train(_table(spark, sf_dir, "documents"))
    pages = _table(spark, sf_dir, "pages")
    told = language_id.identify(pages, model, ["page_id"], "html", url=F.col("url"), declared=language_id.declared_in(F.col("html")), markup=True)
    return told.withColumn("posterior", F.round("posterior", 6))


#: Verdict and host/path of op4's rules.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").where("quality is not null")
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    outcomes = labels.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n"), F.count_if(good).alias("k"))
    told = url_filter.url_filter(_table(spark, sf_dir, "pages").select("page_id", "url"), outcomes, RULES)
    return told.select("page_id", "host", "path", "rule", "verdict", "labelled", "good", F.round("bound", 6).alias("bound"))


def op5_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(_table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = exact_dedup.exact_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return told.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_quotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotation.link_quotes(_table(spark, sf_dir, "conversations")).drop("text")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    told = personal_data.find(docs, personal_data.train(docs), keep_text=False)
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in personal_data.KINDS]
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return told.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def damaged(turns: DataFrame) -> DataFrame:
    """conversations as op12 mends them: crc32 of ``conv_id:turn``, modulo 20, drops a row (0), empties it (1), takes its closing marks (2), repeats it (3) or makes it the user's (4). Nulls are one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat_ws(":", said("conv_id"), said("turn")).cast("binary")) % 20
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    rows = turns.withColumn("fate", fate).where("fate <> 0")
    return rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1)))).drop("col")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    told = conversation_repair.repair(damaged(turns))
    all_ids = turns.select("conv_id").distinct()
    reports = told.reports.withColumnRenamed("conv_id", "of")
    shas = conversation_repair.digests(told.turns).withColumnRenamed("conv_id", "whose")
    found = all_ids.join(reports, F.col("conv_id").eqNullSafe(F.col("of")), "left").join(shas, F.col("conv_id").eqNullSafe(F.col("whose")), "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vector_codes.compress(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    books = coded.books.orderBy("part", "entry").collect()  # 256 entries of the vector's width
    sha = hashlib.sha256(",".join(str(x) for r in books for x in r.vector).encode()).hexdigest()
    rows = Scratch(spark, "op13").keep(coded.rows.select("vec_id", "label", "code", "error"))
    by_label = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    code = F.array_join(F.transform("code", lambda e: F.lower(F.lpad(F.hex(e), 2, "0"))), "")
    told = rows.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return told.select("vec_id", code.alias("code"), "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_katz, op3_language_id, op4_url_filter, op5_hnsw, op6_simhash, op7_mixing, op8_quotation, op9_byte_bpe, op10_exact_dedup, op11_personal_data, op12_conversation_repair, op13_vector_codes)}
