"""Mixing sources to target weights by repetition rates.

Tokens are summed per source; a source's rate is its target over its size. A
document is emitted floor(rate) times, and once more if a hash of its id, read
as a number in [0, 1), lies below the rate's fraction. Only the per-source sums
are shuffled; the table of sources meets the documents in a plain equi-join
that Spark broadcasts when its measured size allows, and splits when skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .scratch import Scratch, Sealed

WORD = r"[^\x20\x09-\x0D]+"
OWN = ("size", "source_size", "target", "copies", "taken")


def draw(name: Column, seed: int) -> Column:
    """A number in [0, 1) fixed by seed and name: the first 52 bits of an MD5."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary"))
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def named(scratch: Scratch, rows: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """rows with name, what a row's draw depends on: its id; without one, its text's digest and its place among the rows of that text and source.

    Equal rows may change places, as one stands for the other. They are numbered in
    each task and moved on by the tasks' counts, so no task gets all of a large group.
    """
    id_, digest = F.col(id_col).cast("string"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    given = rows.where(id_.isNotNull()).withColumn("name", id_)
    lone = scratch.keep(rows.where(id_.isNull()).withColumns({"digest": digest, "part": F.spark_partition_id()}))
    same = [F.col(source_col).alias("of"), F.col("digest").alias("said")]
    counts = lone.groupBy(*same, "part").count().withColumnRenamed("part", "at")
    before = counts.withColumn("before", F.coalesce(F.sum("count").over(W.partitionBy("of", "said").orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(W.partitionBy("part", "digest", source_col).orderBy("digest"))
    met = lone.withColumn("place", place).join(before, F.col(source_col).eqNullSafe(F.col("of")) & (F.col("digest") == F.col("said")) & (F.col("part") == F.col("at")))
    return given.unionByName(met.select(*rows.columns, F.concat_ws(":", F.lit("null"), "digest", F.col("place") + F.col("before")).alias("name")))


def source_ranks(scratch: Scratch, sources: DataFrame, source_col: str) -> DataFrame:
    """sources with rank, from 0, by code point and null last; range partitions are numbered by their own counts."""
    part = F.spark_partition_id().alias("part")
    dealt = scratch.keep(sources.withColumn("missing", F.col(source_col).isNull()).repartitionByRange("missing", source_col).select("*", part))
    before = {}
    total = 0
    for r in sorted(dealt.groupBy("part").count().collect()):  # one row for each partition, not for each source
        before[r[0]] = total
        total += r[1]
    in_part = F.row_number().over(W.partitionBy("part").orderBy("missing", source_col)) - 1
    offset = F.create_map(*[F.lit(x).cast("long") for kv in before.items() for x in kv])[F.col("part").cast("long")] if before else F.lit(0)
    return dealt.withColumn("rank", in_part + offset).drop("missing", "part")


def targets(scratch: Scratch, sizes: DataFrame, source_col: str, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """Per source: source_size and target. Sources at their cap drop out and the rest is shared again, until none is above."""
    ranked = source_ranks(scratch, sizes, source_col)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    table = scratch.keep(ranked.select(source_col, "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(cap))).alias("most")), small=True)
    whole = table.agg(F.sum("source_size")).first()[0] or 0
    budget, spent, left, level = share * whole, 0.0, None, 0.0
    while True:  # each turn sends one row to the driver; the level only rises
        over = F.lit(level) * F.col("weight") >= F.col("most")
        row = table.agg(F.sum(F.when(over, F.col("most")).otherwise(0.0)), F.sum(F.when(~over, F.col("weight")).otherwise(0))).first()
        if (row[0], row[1]) == (spent, left):
            break
        spent, left = row[0], row[1]
        level = (budget - (spent or 0.0)) / left if left else float("inf")
    free = (F.lit(float(budget)) - F.lit(float(spent or 0.0))) * F.col("weight") / F.lit(float(left or 1))
    return table.select(source_col, "source_size", F.when(over, F.col("most")).otherwise(free).alias("target"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 7,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """docs with size, source_size, target, copies and taken = copies * size.

    Size counts words, runs of other characters than ASCII white space; a null
    or empty text has none. Sources weigh ``weights`` in turn, by code point and null
    last. Together they take ``share`` of all words, and no source more than
    ``cap`` times its own. A source without words has rate 0. Rows repeated with
    the same id draw alike; rows without id draw each by itself, equal ones by their number. Input columns named like the added ones are replaced.
    """
    scratch, sealed = Scratch(docs.sparkSession, "mix"), Sealed(docs, *OWN)
    rows = sealed.rows.withColumn("size", F.coalesce(F.regexp_count(F.col(sealed[text_col]), F.lit(WORD)), F.lit(0)).cast("long"))
    source = F.col(sealed[source_col])
    sums = scratch.keep(rows.groupBy(source.alias("key")).agg(F.sum("size").alias("source_size")), small=True)
    table = scratch.keep(targets(scratch, sums, "key", weights, share, cap), small=True)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0)
    copies = F.floor("rate") + (draw(F.col("name"), seed) < F.col("rate") - F.floor("rate")).cast("long")
    told = named(scratch, rows, sealed[id_col], sealed[text_col], sealed[source_col]).join(table, source.eqNullSafe(F.col("key"))).withColumn("rate", rate).withColumn("copies", copies)
    return told.select(*sealed.restored(), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(mixed: DataFrame) -> DataFrame:
    """The mixture itself: each row of mix() as many times as copies says, without the added columns."""
    sealed = Sealed(mixed, *OWN)
    copies = F.col(sealed["copies"])
    return sealed.rows.where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), copies.cast("int")))).select(*sealed.restored())
