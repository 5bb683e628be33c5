"""Exact dedup against grouping in Python; the filter's promise; odd rows."""

import hashlib
import random

import numpy as np
import pytest

from logweir.llm import bloom, exact_dedup


def slow(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return out


@pytest.mark.parametrize("n", [0, 3, 800])
def test_against_grouping(spark, n):
    rng = random.Random(n)
    texts = ["", None, " ", "a", "A", "é", "é", "same " * 5000]
    rows = [(i, rng.choice(texts) if rng.random() < 0.3 else f"text {rng.randrange(n)}") for i in range(n)]
    rows += [(9000 + i, "hot") for i in range(n // 3)] + ([(None, "hot"), (None, "alone"), rows[0], rows[0]] if n else [])
    frame = spark.createDataFrame([(i, t, "mine", 7, 8) for i, t in rows], "doc_id long, text string, kept string, h int, suspect int").repartition(5)
    got = exact_dedup.exact_dedup(frame).collect()
    assert sorted(map(str, ((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got))) == sorted(map(str, slow(rows)))


def test_filter_misses_no_repeat(spark):
    rng = np.random.default_rng(5)
    once, twice = rng.integers(-(2**63), 2**63, 40_000), rng.integers(-(2**63), 2**63, 500)
    keys = spark.createDataFrame([(int(x),) for x in [*once, *twice, *twice]], "h long").repartition(7)
    for size in (64, 1):
        may_repeat = bloom.seen(keys, 41_000, size, 2)
        suspects = {r.h for r in keys.where(may_repeat("h")).distinct().collect()}
        assert set(map(int, twice)) <= suspects
        assert len(suspects) < 2500
