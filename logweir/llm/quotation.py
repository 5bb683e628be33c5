"""Quotation linking: conversations in reply order, without the quotes. DataFrame operations only.

A line is quoted at the level of the number of > in its lead of >, blanks and tabs.
Neighbouring lines of one level are a passage. Passages and their lines are normalised
(lower case, runs of white space as one space), hashed and joined to a table that
has, for each hash, the first message that said it: once per conversation and once
over all. So however often something is said or quoted, a quote has one origin.
Only messages with a quoted line are taken apart, and only hashes that are quoted are looked up.
Conversations whose messages quote an earlier conversation join its thread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .scratch import Scratch, Sealed

QUOTED = r"(?m)^[ \t]*>"
BREAK = r"\r\n|\r|\n"
LEAST_WORDS = 5
OWN = ("thread_id", "position", "reply_conv", "reply_turn", "n_quotes", "n_linked", "deepest", "body")


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\s ]+", " "))


def _hash(text: Column) -> Column:
    return F.md5(normalised(text).cast("binary"))


def passages(messages: DataFrame) -> DataFrame:
    """(mid, text) to (mid, passage, level, text): stretches of lines of one quote level, without the quote marks."""
    lines = messages.select("mid", F.posexplode(F.split("text", BREAK, -1)).alias("line", "raw"))
    lead = F.regexp_extract("raw", r"^[> \t]*", 0)
    level = F.length(F.regexp_replace(lead, "[^>]", ""))
    lines = lines.select("mid", "line", level.alias("level"), F.when(level > 0, F.expr("substring(raw, length(regexp_extract(raw, '^[> \\\\t]*', 0)) + 1)")).otherwise(F.col("raw")).alias("raw"))
    order = W.partitionBy("mid").orderBy("line")  # the lines of one message
    turned = lines.withColumn("new", (F.coalesce(F.lag("level").over(order), F.lit(-1)) != F.col("level")).cast("int"))
    placed = turned.withColumn("passage", F.sum("new").over(order))
    told = placed.groupBy("mid", "passage").agg(F.first("level").alias("level"), F.array_sort(F.collect_list(F.struct("line", "raw"))).alias("lines"))
    return told.select("mid", "passage", "level", F.array_join(F.transform("lines", lambda x: x.raw), "\n").alias("text"))


def numbered(scratch: Scratch, rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with position, from 0, in each group. Rows are dealt out by ranges of group and order, so a large group is many tasks' work."""
    dealt = scratch.keep(rows.repartitionByRange(group, *order).withColumn("part__", F.spark_partition_id()))
    counts = dealt.groupBy(group, "part__").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(group).orderBy("part__").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = scratch.keep(counts.select(F.col(group).alias("g__"), F.col("part__").alias("p__"), before.alias("before__")))
    inside = dealt.withColumn("inside__", F.row_number().over(W.partitionBy(group, "part__").orderBy(*order)) - 1)
    inside = scratch.keep(inside)
    met = inside.join(offsets, inside[group].eqNullSafe(offsets["g__"]) & (inside["part__"] == offsets["p__"]))
    return met.withColumn("position", F.col("inside__") + F.col("before__")).drop("inside__", "before__", "g__", "p__", "part__")


def thread_roots(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(conv, up), up smaller than conv, to (conv, root), by doubling the steps until none moves."""
    found = scratch.keep(links)
    while True:
        ups = found.select(F.col("conv").alias("at"), F.col("up").alias("next"))
        stepped = scratch.keep(found.join(ups, found.up == ups.at, "left").select("conv", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")))
        if not stepped.where("moved").limit(1).count():
            return stepped.select("conv", F.col("up").alias("root"))
        found = stepped.drop("moved")


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """messages with thread_id, position in the thread, reply_conv and reply_turn, n_quotes, n_linked, deepest and body.

    A quoted passage comes from the earliest message before it, in its own
    conversation, that said it outside quotes, whole or as a line; else, if it has
    least_words words, from the earliest message of a smaller (conv, turn) anywhere.
    If it isn't found whole, its lines are looked for alike. A message is found by its whole text outside quotes, its own
    passages, paragraphs and lines; some neighbouring lines out of a paragraph are found line by line, a sentence out of a line isn't. The message replies to
    the origin of its first linked passage of the lowest level; null without one. A
    thread is a conversation with those that quote it, by the smallest conv id;
    position follows (conv, turn), so every message stands after what it replies to.
    n_quotes counts passages, n_linked those with an origin, deepest is the highest level. body is the text without quoted lines, trimmed
    where there were any. A null text has a null body and no quotes; messages repeated in all
    of conv, turn and text are linked alike; null conv or turn links with nothing and
    comes first. Columns named like the added ones are replaced.
    """
    scratch = Scratch(messages.sparkSession, "quotes")
    sealed = Sealed(messages, *OWN)
    conv_in, turn_in, text_in = (sealed[c] for c in (conv_col, turn_col, text_col))
    mid = F.xxhash64(*(x for c in (conv_in, turn_in, text_in) for x in (F.col(c), F.col(c).isNull())))  # hashes skip nulls
    rows = sealed.rows.withColumn("key__", mid)
    told = rows.select(F.col("key__").alias("mid"), F.col(conv_in).alias("conv"), F.col(turn_in).alias("turn"), F.col(text_in).alias("text"))
    quoting = told.where(F.col("text").rlike(QUOTED)).dropDuplicates(["mid"])
    pieces = scratch.keep(passages(quoting.select("mid", "text")))
    bodies = scratch.keep(
        pieces.groupBy("mid").agg(
            F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("passage", "text")))).alias("own"), F.count_if(F.col("level") > 0).alias("n_quotes"), F.max("level").alias("deepest")
        ).select("mid", F.trim(F.array_join(F.transform("own", lambda x: x.text), "\n"), F.lit(" \t\n\x0b\x0c\r")).alias("body"), "n_quotes", "deepest")
    )

    quotes = pieces.where("level > 0").join(quoting.where("conv is not null and turn is not null").select("mid", "conv", "turn"), "mid")
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(F.lit(1).alias("rank"), x.alias("said")))
    units = quotes.withColumn("u", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("rank"), F.col("text").alias("said"))), lines))).where(normalised(F.col("u.said")) != "")
    units = scratch.keep(units.select("mid", "passage", "level", "conv", "turn", "u.rank", _hash(F.col("u.said")).alias("h"), (F.size(F.split(normalised(F.col("u.said")), " ")) >= least_words).alias("long")))

    asked = units.select("h").distinct()
    said = told.where(F.col("conv").isNotNull() & F.col("turn").isNotNull() & ~F.col("text").rlike(QUOTED)).select("conv", "turn", "text")
    own = pieces.where("level = 0").select("mid", "text").unionByName(bodies.select("mid", F.col("body").alias("text")))
    said = said.unionByName(quoting.where("conv is not null and turn is not null").select("mid", "conv", "turn").join(own, "mid").select("conv", "turn", "text"))
    whole_and_lines = F.array_distinct(F.concat(F.array(F.col("text")), F.split("text", BREAK), F.split("text", r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)\s*")))
    source = said.select("conv", "turn", F.explode(whole_and_lines).alias("s")).select("conv", "turn", _hash(F.col("s")).alias("h")).join(asked, "h", "left_semi")
    nearby = scratch.keep(source.groupBy("h", "conv").agg(F.min("turn").alias("from_turn")))
    anywhere = scratch.keep(nearby.groupBy("h").agg(F.min(F.struct("conv", "from_turn")).alias("first")))

    near = units.join(nearby, ["h", "conv"]).where("from_turn < turn").select("mid", "passage", "level", F.struct("rank", F.lit(0).alias("far"), F.col("conv").alias("c"), F.col("from_turn").alias("t")).alias("found"))
    far = units.where("long").join(anywhere, "h").where("first.conv < conv").select("mid", "passage", "level", F.struct("rank", F.lit(1).alias("far"), F.col("first.conv").alias("c"), F.col("first.from_turn").alias("t")).alias("found"))
    origin = scratch.keep(near.unionByName(far).groupBy("mid", "passage", "level").agg(F.min("found").alias("found")))
    replies = scratch.keep(origin.groupBy("mid").agg(F.count("*").alias("n_linked"), F.min_by("found", F.struct("level", "passage")).alias("to")))

    links = quoting.select("mid", "conv").join(replies, "mid").where("to.c < conv").groupBy("conv").agg(F.min("to.c").alias("up"))
    roots = scratch.keep(thread_roots(scratch, links).select(F.col("conv").alias("conv__"), F.col("root").alias("root__")))
    marked = scratch.keep(bodies.join(replies, "mid", "left").withColumnsRenamed({"mid": "mid__", "to": "to__"}))
    joined = rows.join(marked, rows.key__ == marked.mid__, "left").join(roots, F.col(conv_in) == F.col("conv__"), "left")
    out = joined.select(
        *sealed.kept, "key__", F.coalesce("root__", F.col(conv_in)).alias("thread_id"), F.col("to__.c").alias("reply_conv"), F.col("to__.t").alias("reply_turn"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_quotes", "n_linked", "deepest")], F.when(F.col("mid__").isNull(), F.col(text_in)).otherwise(F.col("body")).alias("body"),
    )
    told = numbered(scratch, out, "thread_id", [conv_in, turn_in, "key__"])
    return told.select(*sealed.restored(), *OWN)
