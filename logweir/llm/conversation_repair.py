"""Conversation structure repair: faults, the cheapest legal edits (``audit``), and the repaired turns.

Rows are dealt by ranges of (conversation, turn), so that a conversation of any
length spreads over tasks in its order. Each task cuts what it holds into
stretches of at most ``segment_rows`` rows of one conversation and solves each
for the states it may begin in. The stretches' costs and ranks, a few numbers
each, meet by conversation and tell which cell each stretch takes; the edits of
that cell meet the rows again by stretch. No task holds a conversation's texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from .audit import AFTER, STATES, ending, joined, replayed, stretch
from .scratch import Scratch, Sealed

BLANKS = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")

CELL = T.StructType().add("before", "integer").add("to", "integer").add("cost", "long").add("rank", "integer").add("edits", "string")
STATS = ("blank", "duplicate", "truncated", "illegal", "turns")
STRETCH = T.StructType().add("cells", T.ArrayType(CELL)).add("initials", "string").add("first_role", "string").add("last_role", "string").add("first_turn", "long").add("last_turn", "long")
for _name in STATS:
    STRETCH.add(_name, "long")


@dataclass
class Repaired:
    """reports: one row a conversation with gaps, blank, duplicate, truncated, illegal, cost and audit. turns: conversation, place, role, text and edit of the repaired rows, in order of place."""

    reports: DataFrame
    turns: DataFrame


def ordered(rows: DataFrame) -> DataFrame:
    """Rows in ranges of conversation and turn, nulls first, equal turns by role and text's digest, with seen: whether an earlier turn had the same role and text."""
    turn = F.struct(F.col("turn").isNotNull().alias("there"), "turn")
    again = rows.groupBy(F.col("conv").alias("of"), F.col("role").alias("said_by"), F.col("digest").alias("said")).agg(F.count("*").alias("times"), F.min(turn).alias("since")).where("times > 1")
    same = F.col("conv").eqNullSafe(F.col("of")) & (F.col("role") == F.col("said_by")) & (F.col("digest") == F.col("said"))
    told = rows.join(again, same, "left").withColumn("seen", F.coalesce(turn > F.col("since"), F.lit(False))).drop("of", "said_by", "said", "times", "since")
    order = [F.col("conv").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]
    return told.repartitionByRange(*order).sortWithinPartitions(*order)


def _stretched(rows: DataFrame, segment_rows: int) -> DataFrame:
    """Each row with its part (task), stretch and number in it, and a row for each stretch with its solutions: kind 0 and 1."""
    conv = rows.schema["conv"]
    kind = T.StructType([conv]).add("part", "integer").add("segment", "long").add("number", "integer").add("role", "string").add("text", "string").add("told", STRETCH).add("kind", "integer")
    arrow = {"told": pa.struct([("cells", pa.list_(pa.struct([("before", pa.int32()), ("to", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32()), ("edits", pa.string())]))), *((n, pa.string()) for n in ("initials", "first_role", "last_role")), *((n, pa.int64()) for n in ("first_turn", "last_turn", *STATS))])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        own: list[tuple[str, str, int | None]] = []  # initial, fault and turn of the stretch at hand
        segment, whole, at, last, first_conv = -1, True, None, None, True

        def solved() -> tuple:
            cells = stretch([r[:2] for r in own], range(1) if whole else range(STATES))
            pairs = [a[0] + b[0] for a, b in zip(own, own[1:], strict=False)]
            turns = [r[2] for r in own if r[2] is not None]
            faults = [r[1] for r in own]
            told = {
                "cells": [{"before": b, "to": t, "cost": c, "rank": r, "edits": e} for (b, t), (c, e, r) in cells.items()],
                "initials": "".join(r[0] if r[0] in AFTER else "?" for r in own), "first_role": own[0][0], "last_role": own[-1][0],
                "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, "turns": len(set(turns)),
                "illegal": sum(p not in LEGAL for p in pairs), **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
            }
            return at, part, segment, told

        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in ("conv", "turn", "role", "digest", "seen", "blank", "closed")}
            segments, numbers, done = [], [], []
            for conv_id, turn, role, digest, seen, blank, closed in zip(*columns.values(), strict=True):
                begins = segment < 0 or conv_id != at
                if begins or len(own) == segment_rows:
                    if own:
                        done.append(solved())
                    first_conv = first_conv and (segment < 0 or not begins)
                    whole = begins and not first_conv  # the first conversation of a task may go on from the task before
                    own, segment, at = [], segment + 1, conv_id
                key = (conv_id, turn, role, digest)
                fault = "blank" if blank else "duplicate" if seen or key == last else "" if closed else "truncated"
                segments.append(segment)
                numbers.append(len(own))
                own.append((role[:1], fault, turn))
                last = key
            n = len(batch)
            head = [batch.column("conv"), pa.array([part] * n, pa.int32()), pa.array(segments, pa.int64()), pa.array(numbers, pa.int32())]
            yield pa.RecordBatch.from_arrays([*head, batch.column("role"), batch.column("text"), pa.nulls(n, arrow["told"]), pa.array([0] * n, pa.int32())], names=kind.names)
            if done:
                yield tables(done, batch.schema)
        if own:
            yield tables([solved()], batch.schema)

    def tables(done: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        n = len(done)
        convs, parts, segments, told = zip(*done, strict=True)
        none = pa.nulls(n, pa.string())
        columns = [pa.array(convs, schema.field("conv").type), pa.array(parts, pa.int32()), pa.array(segments, pa.int64()), pa.nulls(n, pa.int32()), none, none, pa.array(told, arrow["told"]), pa.array([1] * n, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names=kind.names)

    return rows.mapInArrow(run, kind)


def _chosen(stretches: DataFrame) -> DataFrame:
    """The states before and after each stretch, and on its last stretch the conversation's counts and cost."""
    light = stretches.select("conv", "part", "segment", F.struct(F.transform("told.cells", lambda c: c.dropFields("edits")).alias("cells"), *(F.col(f"told.{n}") for n in ("first_role", "last_role", "first_turn", "last_turn", *STATS))).alias("told"))
    dealt = light.repartition("conv").sortWithinPartitions("conv", "part", "segment")
    kind = T.StructType([stretches.schema["conv"]]).add("part", "integer").add("segment", "long").add("before", "integer").add("to", "integer").add("last", "boolean").add("gaps", "long").add("cost", "long")
    for name in STATS[:-1]:
        kind.add(name, "long")

    def report(own: list[dict]) -> Iterator[tuple]:
        told = [r["told"] for r in own]
        cost, way = joined([{(c["before"], c["to"]): (c["cost"], c["rank"]) for c in t["cells"]} for t in told])
        sums = {n: sum(t[n] for t in told) for n in STATS}
        sums["illegal"] += sum(a["last_role"] + b["first_role"] not in LEGAL for a, b in zip(told, told[1:], strict=False))
        turned = [t for t in told if t["first_turn"] is not None]
        sums["turns"] -= sum(a["last_turn"] == b["first_turn"] for a, b in zip(turned, turned[1:], strict=False))
        gaps = turned[-1]["last_turn"] - turned[0]["first_turn"] + 1 - sums["turns"] if turned else 0
        for k, (r, (before, to)) in enumerate(zip(own, way, strict=True)):
            yield r["conv"], r["part"], r["segment"], before, to, k == len(own) - 1, gaps, cost, *(sums[n] for n in STATS[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None

        def rows() -> Iterator[dict]:
            nonlocal schema
            for batch in batches:
                schema = batch.schema
                yield from batch.to_pylist()

        made: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            ints = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), *[pa.int64()] * (len(kind) - 6)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), [schema.field("conv").type, *ints], strict=True)], names=kind.names)

        for _, own in groupby(rows(), key=lambda r: r["conv"]):
            made.extend(report(list(own)))
            if len(made) > 4096:
                yield flushed()
                made = []
        if made:
            yield flushed()

    return dealt.mapInArrow(run, kind)


def _planned(solved: DataFrame) -> DataFrame:
    """What becomes of each row of a stretch: part, segment, op (its place), edit, number of the row, new role."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for r in batch.to_pylist():
                edits = r["edits"] + (ending(r["to"]) if r["last"] else "")
                for op, (edit, number, role) in enumerate(replayed(r["before"], r["initials"], edits)):
                    made.append((r["conv"], r["part"], r["segment"], op, edit, number, role))
            if made:
                types = [batch.schema.field("conv").type, pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names=kind.names)

    kind = T.StructType([solved.schema["conv"]]).add("part", "integer").add("segment", "long").add("op", "integer").add("edit", "string").add("number", "integer").add("new_role", "string")
    return solved.mapInArrow(run, kind)


def repair(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment_rows: int = 2048,
) -> Repaired:
    """The faults of each conversation, the cheapest edits that mend it, and its repaired turns.

    A conversation's rows are taken by turn, nulls first; rows of one turn by
    role and digest of the text. A null role or text counts as one space; rows with null
    conversation are one conversation. A row's first fault counts: blank
    (nothing but ASCII white space), duplicate (an earlier row has its role and
    text), truncated (its last visible character is none of ``.!?``). Keep
    costs 0, another role (user or assistant) 3, deletion 4, an inserted empty
    turn 3, a truncated row that isn't deleted 3 more; blank and duplicate rows
    have to go. Roles have to read an optional s, then pairs of u and a, by
    their initials; no rows at all are legal too. A role with another or no
    initial can't be kept. Of equal costs the edits least by ASCII win. Other
    columns are left out. Turns are whole numbers; gaps ignore null ones.
    """
    scratch, sealed = Scratch(turns.sparkSession, "repair"), Sealed(turns)
    said = lambda c: F.coalesce(F.col(sealed[c]).cast("string"), F.lit(" "))
    rows = sealed.rows.select(F.col(sealed[conv_col]).alias("conv"), F.col(sealed[turn_col]).cast("long").alias("turn"), said(role_col).alias("role"), said(text_col).alias("text"))
    visible = F.rtrim("text", F.lit(BLANKS))
    rows = rows.withColumns({"digest": F.unhex(F.sha2("text", 256)), "blank": visible == "", "closed": F.substring(visible, -1, 1).isin(".", "!", "?")})
    lines = scratch.keep(_stretched(ordered(rows), segment_rows), "kind")
    stretches = lines.where("kind = 1").select("conv", "part", "segment", "told")
    chosen = scratch.keep(_chosen(stretches))
    cell = F.filter("told.cells", lambda c: (c["before"] == F.col("before")) & (c["to"] == F.col("to")))[0]["edits"]
    ways = stretches.join(chosen.drop("conv"), ["part", "segment"])
    solved = scratch.keep(ways.select("conv", "part", "segment", "before", "to", "last", cell.alias("edits"), "told.initials"))
    insertions = F.when(F.col("last"), F.element_at(F.array(*(F.lit(ending(s)) for s in range(STATES))), F.col("to") + 1)).otherwise("")
    audits = solved.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", "segment", F.concat("edits", insertions).alias("edits")))).alias("all"))
    audits = audits.select(F.col("conv").alias("of"), F.array_join("all.edits", "").alias("audit"))
    reports = chosen.where("last").join(audits, F.col("conv").eqNullSafe(F.col("of")))
    reports = reports.select(F.col("conv").alias(conv_col), "gaps", *STATS[:-1], "cost", "audit")
    planned = scratch.keep(_planned(solved).where("edit <> 'D'"))
    place = F.shiftleft(F.col("part").cast("long"), 44) + F.shiftleft("segment", 16) + F.col("op")
    texts = lines.where("kind = 0").select("part", "segment", "number", "role", "text")
    mended = planned.join(texts, ["part", "segment", "number"], "left")
    mended = mended.select(F.col("conv").alias(conv_col), place.alias("place"), F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"), "edit")
    return Repaired(reports, mended)


def digests(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """SHA-256 of each conversation's ``role:text``, joined by newlines in order of place: a running hash over sorted rows, so no conversation is held whole."""
    rows = turns.select(F.col(conv_col).alias("conv"), "place", F.concat_ws(":", "role", "text").alias("line"))
    dealt = rows.repartition("conv").sortWithinPartitions("conv", "place")
    kind = T.StructType([rows.schema["conv"]]).add("sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha, schema, made = None, None, None, []

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], schema.field("conv").type), pa.array([m[1] for m in made], pa.string())], names=kind.names)

        for batch in batches:
            schema, made = batch.schema, []
            for conv, line in zip(batch.column("conv").to_pylist(), batch.column("line"), strict=True):
                if sha is None or conv != at:
                    if sha is not None:
                        made.append((at, sha.hexdigest()))
                    at, sha = conv, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(line.as_buffer())
            if made:
                yield flushed()
        if sha is not None:
            made = [(at, sha.hexdigest())]
            yield flushed()

    return dealt.mapInArrow(run, kind).withColumnsRenamed({"conv": conv_col})
