"""One long line costs its own time and no more; patterns that give nothing back find what the plain ones find."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from logweir.functions import numeric, signature, text as tx
from logweir.plans import batch
from logweir.sources import lines, raw_records, readers

MEGABYTE = 1_000_000
LONG = {
    "quoted": 'a=1 q="' + "x" * MEGABYTE + '" b=2',
    "single": "a=1 q='" + "x" * MEGABYTE + "' b=2",
    "escapes": 'a=1 q="' + '\\"' * 100_000 + '" b=2',
    "open quote": 'a=1 q="' + '\\"' * 100_000 + " b=2",
    "groups": "<34>1 2024-04-15T12:03:20Z host app 12 id " + "[a]" * 100_000 + " hello there",
    "open groups": "<34>1 2024-04-15T12:03:20Z host app 12 id " + "[a" * 100_000,
    "blanks": "a=1" + " " * MEGABYTE + "b=2",
    "tabs": "Jan 5 10:00:00 h p: " + "\t" * MEGABYTE + "b=2",
    "digits": "temp=" + "7" * MEGABYTE + " b=2",
    "word": "x" * MEGABYTE + " b=2 c=3",
    "letters": "|".join(["x" * 300_000, "yy", "z" * 300_000]),
    "odd letters": "x" * 300_000 + "!|" + "y" * 300_000 + "!|z",
    "slashes": "a=/x" * 100_000 + " C:\\" + "dir\\" * 100_000,
    "underscores": "a=" + "1_" * 100_000 + "1 b=" + "1_" * 100_000,
    "cells": "a|" + '"' * 300_000 + "x|" + "'" * 300_000 + "y|c",
    "dots": "a=" + "1." * 200_000 + " b=2",
    "angle": "<" * 300_000,
}


@pytest.fixture(scope="module")
def files(spark):
    return readers.from_bytes(spark, [(k, t.encode()) for k, t in LONG.items()]).repartition(4).cache()


@pytest.mark.parametrize("fmt", ["plain_text", "key_value", "logfmt", "delimiter", "tsv", "syslog"])
def test_line_parsers(files, fmt):
    began = time.time()
    got = readers.ingest(files, fmt).select("source", F.length("message").alias("n"), F.size("fields").alias("k"), "corrupted").collect()
    assert got if fmt in ("delimiter", "tsv") else {r.source for r in got} == set(LONG)  # a file's only line may be its header
    assert time.time() - began < 40


@pytest.mark.parametrize("kind", ["logfmt", "keyvalue", "syslog", "delimiter", "plaintext"])
def test_second_parsers(spark, kind):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(LONG.values())], "id long, text string").withColumn("f", F.lit(kind)).repartition(4)
    began = time.time()
    got = {r.id: r for r in raw_records.parse_texts(frame, "f").select("id", "record").collect()}
    assert len(got) >= len(LONG) - 1 and time.time() - began < 40
    if kind == "logfmt":
        assert len(got[0].record["q"]) == MEGABYTE and got[0].record["b"] == "2"
        assert got[2].record["q"] == '"' * 100_000


def test_values_and_groups_are_whole(files):
    told = {r.source: r.fields for r in readers.ingest(files, "key_value").where("not corrupted").collect()}
    assert len(told["quoted"]["q"]) == len(told["single"]["q"]) == MEGABYTE and told["quoted"]["b"] == "2"
    assert told["escapes"]["q"] == '\\"' * 100_000
    groups = readers.ingest(files.where("source = 'groups'"), "syslog").first()
    assert groups.fields["structured_data"] == "[a]" * 100_000 and groups.message == "hello there"


def test_signature_strip_and_numbers(spark):
    frame = spark.createDataFrame([(t,) for t in LONG.values()], "t string").repartition(4)
    began = time.time()
    frame.select(signature.generate_signature(F.col("t")), F.length(tx.strip(F.col("t"))), F.length(numeric.coerce_value(F.col("t"))), tx.clean_text(F.col("t"))).collect()
    assert time.time() - began < 30


def random_texts(alphabet, n=800, size=30, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, size))) for _ in range(n)]


def told(spark, texts, **columns):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return sorted(frame.select("i", *(c.alias(k) for k, c in columns.items())).collect())


def test_pair_patterns_equal_the_plain_ones(spark):
    texts = random_texts("ab1_ =:\"'.,;\\")
    shown = lambda pattern: F.transform(raw_records._pairs(F.col("t"), pattern), lambda e: F.concat(e["k"], F.lit("\x00"), e["v"]))
    for r in told(spark, texts, lf=shown(raw_records.LOGFMT), kv=shown(raw_records.KEY_VALUE)):
        assert r.lf == ["\0".join(m.groups()) for m in re.finditer(r'(\w+)=("(?:[^"\\]|\\.)*"|\S*)', texts[r.i])]
        assert r.kv == ["\0".join(m.groups()) for m in re.finditer(r"""([A-Za-z_][\w.]*)\s*[=:]\s*([^\s,;|"']+|"[^"]*"|'[^']*')""", texts[r.i])]


def test_masks_equal_the_plain_ones(spark):
    plain = list(signature.MASKS)
    plain[5] = (r"[A-Za-z]:\\(?:[\w.\- ]+\\?)+", "<PATH>")
    plain[6] = (r"(?:^|(?<=\s))(?:/[\w.\-]+){2,}", "<PATH>")
    plain[8] = (r"-?\d+\.\d+(?:[eE][+-]?\d+)?", "<NUM>")
    texts = random_texts("a1-./\\:eC +", size=25)
    for r in told(spark, texts, m=signature.mask_variables(F.col("t"))):
        want = texts[r.i]
        for pattern, name in plain:
            want = re.sub(pattern, name, want, flags=re.ASCII)
        assert r.m == want, texts[r.i]


def test_numbers_and_cells_equal_the_plain_ones(spark):
    real = re.compile(r"^[+-]?(?:(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:e[+-]?\d+)?|inf(?:inity)?|nan)$", re.I)
    unit = re.compile(r"(-?\d+(?:\.\d+)?)\s*(?:°)?(?:[KMGTPE]?[Bb](?:ytes?)?|ms|[km]?W|%)\b", re.I)
    texts = random_texts("12._e+-", size=8) + random_texts("1.5-_ kmWsB%", size=12)
    for r in told(spark, texts, real=F.col("t").rlike(numeric.REAL), whole=F.col("t").rlike(numeric.WHOLE), number=F.col("t").rlike(lines.NUMBER_CELL)):
        t = texts[r.i]
        assert r.real == bool(real.match(t)) and r.whole == bool(re.match(r"^[+-]?\d+(?:_\d+)*$", t)) and r.number == bool(re.match(r"^[.-]*\d[\d.-]*$", t)), t
    assert unit.sub(r"\1", "5.5 ms 12kW") == "5.5 12"
    cells = random_texts("aé_-1 ", size=6)
    for r in told(spark, cells, w=F.col("t").rlike(lines.WORD_CELL), s=tx.strip(F.col("t"))):
        assert r.w == bool(re.match(r"^(?:[^\W\d_]|[_-])*[^\W\d_](?:[^\W\d_]|[_-])*$", cells[r.i])), cells[r.i]
        assert r.s == cells[r.i].strip()
    wide = random_texts(tx.SPACES + "ab", size=9)
    assert all(r.s == wide[r.i].strip() for r in told(spark, wide, s=tx.strip(F.col("t"))))


class Counting:
    def __init__(self, path):
        self.path = path

    def generate(self, lines_, signatures):
        with open(self.path, "a") as f:
            f.writelines(f"{s}\n" for s in signatures)
        return [{"fields": {"temperature": r"temp=(\S+)"}, "confidence": 0.9, "parse_flags": []} for _ in lines_]


def test_provider_is_asked_once_a_signature(spark, tmp_path):
    store = batch.Store(spark, f"file://{tmp_path}/store")
    text = "".join(f"heater {'abcde'[i % 5] * 3} temp={i}.5C ok\n" for i in range(20))
    files = readers.from_bytes(spark, [("a.log", text.encode())])
    batch.run_files(store, files, Counting(f"{tmp_path}/asked"), "plain_text")
    asked = (tmp_path / "asked").read_text().split()
    assert len(asked) == len(set(asked)) == 5
    batch.run_files(store, files, Counting(f"{tmp_path}/asked"), "plain_text")
    assert len((tmp_path / "asked").read_text().split()) == 5
