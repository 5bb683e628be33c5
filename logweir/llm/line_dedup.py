"""Line deduplication by winnowing over line hashes.

The windows are stretches of neighbouring lines that reach ``min_words`` words:
from every line on, and back from every line. The line with the least hash in a
window is its fingerprint. A run of lines of at least min_words words that
stands in two places holds a window whole, and a window selects by its content alone,
so both places have that fingerprint: none is missed.

The minima are counted first, without anything beside them. Where a minimum stands in
more than one place, each of its positions is extended both ways, line by line, until
there are min_words words on each of the ways that it is least in; positions meet
where what they were extended to is the same, and each meets its first place alone,
not all others, so no pairs of a common passage's places are made. A longer match isn't
walked from its seed on: all minima inside it are shared as well, and the stretches that
they are extended to unite to the whole run. What lies in a later repeat, no more
and no less, is deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import bloom
from .scratch import Scratch, Sealed, trim

MIN_WORDS = 50
OWN = ("n_lines", "n_removed", "removed")
FILTER_MB = 32
_FOUND = "fp long, id {}, version long, windows array<struct<win:binary,start:int,stop:int>>"
_WINDOWS = pa.list_(pa.struct([("win", pa.binary()), ("start", pa.int32()), ("stop", pa.int32())]))


def windows(words: list[int], least: int) -> set[tuple[int, int]]:
    """First and last place of every shortest window of at least so many words, forward from each place and back from each."""
    found: set[tuple[int, int]] = set()
    n, stop, total = len(words), 0, 0
    for start in range(n):
        while stop < n and total < least:
            total += words[stop]
            stop += 1
        if total < least:
            break
        found.add((start, stop - 1))
        total -= words[start]
    start, total = n - 1, 0
    for last in range(n - 1, -1, -1):
        while start >= 0 and total < least:
            total += words[start]
            start -= 1
        if total < least:
            break
        found.add((start + 1, last))
        total -= words[last]
    return found


class Lines:
    """The lines of a text that have words: their places, words and hashes. A line without words belongs to the one before."""

    def __init__(self, text: str):
        lines = text.encode("utf-8").split(b"\n")
        counts = [len(x.split()) for x in lines]
        self.place = [i for i, n in enumerate(counts) if n]
        self.words = [n for n in counts if n]
        self.digest = [xxhash.xxh3_128_digest(lines[i]) for i in self.place]
        self.ends = [x - 1 for x in self.place[1:]] + [len(lines) - 1]

    def minima(self, least: int) -> dict[int, list[tuple[int, int]]]:
        """By the line that is least: the windows that it is least in."""
        found: dict[int, list[tuple[int, int]]] = {}
        for a, b in sorted(windows(self.words, least)):
            held = self.digest[a : b + 1]
            found.setdefault(a + held.index(min(held)), []).append((a, b))
        return found

    def hash_of(self, line: int) -> int:
        return int.from_bytes(self.digest[line][:8], "little", signed=True)

    def extended(self, a: int, b: int) -> tuple[bytes, int, int]:
        """A window's digest, first and last line."""
        held = self.digest[a : b + 1]
        return xxhash.xxh3_128_digest(b"".join(held)) if a < b else held[0], self.place[a], self.ends[b]


def fingerprints(text: str, least: int) -> dict[tuple[int, int], list[tuple[bytes, int, int]]]:
    """By line and its hash: what the fingerprint is extended to, each with its digest, first and last line."""
    lines = Lines(text)
    return {(lines.place[k], lines.hash_of(k)): [lines.extended(a, b) for a, b in wins] for k, wins in lines.minima(least).items()}


def _hashes(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[int] = []
            for text in batch.column(0):
                lines = Lines(text.as_py())
                out.extend(map(lines.hash_of, lines.minima(least)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["fp"])
        trim()

    return run


def _extensions(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for i, version, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                for (_, fp), wins in fingerprints(text, least).items():
                    for to, x in zip(out, (fp, i, version, [{"win": w, "start": a, "stop": b} for w, a, b in wins])):
                        to.append(x)
            kinds = (pa.int64(), batch.schema.types[0], pa.int64(), _WINDOWS)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["fp", "id", "version", "windows"])
        trim()

    return run


def repeats(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(id, version, spans): for each document with later repeats, their windows' first and last lines, counted from 0."""
    keyed = docs.where(F.col(id_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))
    minima = keyed.select("text").mapInArrow(_hashes(min_words), "fp long")
    shared = scratch.keep(minima.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select(F.xxhash64("fp").alias("h")), texts=True, small=True)
    # a filter of what is shared: positions of others aren't extended; one that passes by chance meets nothing below
    shared_here = bloom.seen(shared, shared.count(), FILTER_MB, 1)
    positions = keyed.mapInArrow(_extensions(min_words), _FOUND.format(docs.schema[id_col].dataType.simpleString())).where(shared_here(F.xxhash64("fp")))
    extended = scratch.keep(positions.select("id", "version", F.explode("windows").alias("w")).select("id", "version", "w.*"), texts=True)
    scratch.drop(shared)
    at = F.struct("id", "version", "start", "stop")
    first = scratch.keep(extended.groupBy("win").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), small=True)
    same = (F.col("id") == F.col("first.id")) & (F.col("version") == F.col("first.version"))
    later = F.when(same, F.col("start") > F.col("first.stop")).otherwise(F.struct("id", "version") > F.struct("first.id", "first.version"))
    spans = extended.join(first, "win").where(later)
    found = scratch.keep(spans.groupBy("id", "version").agg(F.collect_set(F.struct("start", "stop")).alias("spans")), small=True)  # as many as the text has lines, at most twice
    scratch.drop(extended, first)
    return found


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with later repeated runs cut from the text, and n_lines, n_removed and removed (array of line numbers from 0).

    A line goes if it lies in a run of neighbouring lines with at least
    min_words words that also stands earlier, line by line the same: in a
    document with a smaller id, or further up in its own without overlap. Lines
    without words are skipped when runs are compared, and go or stay with the
    line before them. The first place keeps its lines. Rows repeated with one id and text are
    one document told twice and are cut alike; of different texts under one id
    the one with the smaller hash counts as earlier. A row without id is
    returned as it is and cuts nothing; a null text stays null with no lines.
    Columns named like the added ones are replaced. Ids may be of any type that has an order.
    """
    scratch, sealed = Scratch(docs.sparkSession, "lines"), Sealed(docs, *OWN)
    key, text = F.col(sealed[id_col]), F.col(sealed[text_col])
    found = repeats(sealed.rows, scratch, sealed[id_col], sealed[text_col], min_words)
    hashed = F.xxhash64("id", "version")
    # a filter of what is cut lets most rows pass where they are; only the rest meet the spans
    cut_here = bloom.seen(found.select(hashed.alias("h")), found.count(), FILTER_MB, 1)
    rows = sealed.rows.withColumn("version", F.xxhash64(text)).withColumn("suspect", cut_here(F.xxhash64(key, "version")))
    lines = F.split(text, "\n", -1)
    count = F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines")
    none = F.array().cast("array<int>")
    passed = rows.where(~F.col("suspect")).select(*sealed.restored(), count, F.lit(0).cast("long").alias("n_removed"), none.alias("removed"))
    joined = rows.where("suspect").join(found.withColumnsRenamed({"version": "v"}), (key == F.col("id")) & (F.col("version") == F.col("v")), "left")
    joined = joined.withColumn("lines", lines).withColumn("gone", F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s.start, s.stop))))))
    left = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")), lambda i: F.get(F.col("lines"), i)), "\n")
    cut = {sealed[text_col]: F.when(F.col("gone").isNull(), text).otherwise(left)}
    told = joined.select(*sealed.restored(**cut), count, F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("gone", none).alias("removed"))
    return passed.unionByName(told)
