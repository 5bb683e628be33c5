"""Exact deduplication: two passes over a blocked counting Bloom filter, then a shuffle of suspects only.

Pass one counts, for every text hash, its cells in one block of a Bloom filter
whose counters stop at two. Pass two asks which rows have all their cells at
two: only these can be repeated. They are grouped by SHA-256; every other row is
passed straight through. False positives cost a few shuffled rows and never
change the result, so the filter may be bounded: ``max_filter_mb`` is the
size of what the driver gathers and broadcasts, at any input size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import bloom
from .scratch import Scratch, Sealed

OWN = ("keep_id", "group_size", "kept", "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_filter_mb: int = 64) -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256; dropped rows are returned too, with kept false.

    Texts are equal when identical. A null text counts as empty. Of equal texts
    the row with the largest id stays; a null id is smaller than any other. Rows
    repeated with the same id and text are one document told twice: each counts
    in group_size and all carry the same kept. An empty table gives an
    empty one. Input columns named like the added ones are replaced.
    """
    scratch, sealed = Scratch(docs.sparkSession, "exact"), Sealed(docs, *OWN)
    key = F.col(sealed[id_col])
    rows = sealed.rows.withColumn("sha", F.sha2(F.coalesce(F.col(sealed[text_col]), F.lit("")), 256)).withColumn("h", F.xxhash64("sha"))
    may_repeat = bloom.seen(rows.select("h"), docs.count(), max_filter_mb, 2)
    told = rows.withColumn("suspect", may_repeat("h")).drop("h")
    added = [F.col("keep_id"), F.col("group_size"), F.col("kept"), F.col("sha").alias("text_sha256")]
    passed = told.where(~F.col("suspect")).withColumns({"keep_id": key, "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})
    # ids and digests of the suspects decide; their other columns meet the answer once
    groups = scratch.keep(told.where("suspect").select("sha", key.alias("id")).groupBy("sha").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")))
    judged = told.where("suspect").join(groups, "sha").withColumn("kept", key.eqNullSafe(F.col("keep_id")))
    return passed.select(*sealed.restored(), *added).unionByName(judged.select(*sealed.restored(), *added))
