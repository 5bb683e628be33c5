"""Near-duplicates by five-word shingles against brute force, in the operator and in the pipeline's stage."""

import random
from collections import Counter
from pathlib import Path

import corpus_pipeline
import numpy as np
import pytest

from logweir.llm import near, simhash
from logweir.llm.components import roots
from logweir.llm.scratch import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def slow_shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def slow_components(texts, least=0.8):
    sets = [slow_shingles(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9 and label[i] != label[j]:
                a, b = max(label[i], label[j]), min(label[i], label[j])
                label = [b if x == a else x for x in label]
    return label


def family(rng, n_words, copies, edits):
    """A text and copies of it with some words changed each."""
    base = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n_words)]
    out = [" ".join(base)]
    for _ in range(copies):
        words = list(base)
        for at in rng.sample(range(n_words), rng.randint(0, edits)):
            words[at] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("common,block", [(5, 4096), (10**6, 4)])
def test_components(spark, monkeypatch, common, block):
    monkeypatch.setattr(near, "COMMON", common)
    monkeypatch.setattr(near, "BLOCK", block)  # of four: groups become cells
    rng = random.Random(common)
    texts = [None, "", " ", "one", "One", "a b c d e", "a b c d e f"]
    for n, copies, edits in [(100, 12, 6), (60, 9, 4), (400, 6, 20), (30, 8, 2), (12, 5, 1)]:
        texts += family(rng, n, copies, edits)
    shared = family(rng, 40, 0, 0)[0]
    texts += [f"{shared} {family(rng, 8 + i, 0, 0)[0]}" for i in range(12)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(5)
    label = slow_components(texts)
    want = {i: c for i, c in enumerate(label) if label.count(c) > 1}
    assert {r.row: r.component_id for r in near.near_components(docs, "row").collect()} == want
    assert near.near_components(docs.where("false"), "row").count() == 0


@pytest.mark.parametrize("most", [200_000, 100])
def test_common_shingles_are_counted_over_all_texts(spark, monkeypatch, most):
    seen, coded = [], near._coded
    monkeypatch.setattr(near, "MOST_COMMON", most)
    monkeypatch.setattr(near, "_coded", lambda width, least, common: seen.append(common.value) or coded(width, least, common))
    texts = [f"t{i} u{i} v{i}" + " every text has these words" * (i % 2) + f" some {i % 2500} have them all" * (i % 3 == 0) for i in range(11_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(7)
    near.near_components(docs, "row")
    count = Counter(int(h) for t in texts for h in near.shingles(t))
    least = max(near.COMMON, -(-count.total() // most))
    want = {h: n for h, n in count.items() if n >= least}
    found, counts = seen[0]
    assert 0 < len(want) <= most and dict(zip(found.tolist(), counts.tolist())) == want and found.tolist() == sorted(want)


def test_tables_of_links_are_few_files(spark, monkeypatch):
    files, write = [], Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, *by: files.append((df.columns, len(list(Path((path := write(self, df, *by)).removeprefix("file://")).glob("*.parquet"))))) or path)
    for key, value in (("spark.sql.shuffle.partitions", "23"), ("spark.sql.adaptive.coalescePartitions.enabled", "false")):
        spark.conf.set(key, value)
    try:
        texts = family(random.Random(2), 60, 30, 4)
        docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
        near.near_components(docs, "row")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    few = [n for columns, n in files if columns == ["u", "v"]]
    assert len(few) > 3 and max(few) <= spark.sparkContext.defaultParallelism


def test_stage_finds_copies_beyond_three_bits(spark):
    rng = random.Random(5)
    texts = [t for _ in range(6) for t in family(rng, 150, 2, 3)]
    rows = [(i, t, "aa", "s", len(t)) for i, t in enumerate(texts)]
    assert any((simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[i + 1])).bit_count() > 3 for i in range(0, len(texts), 3))
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(slow_components(texts)))


def test_stage_decides_by_row(spark):
    rng = random.Random(9)
    a, b, c, d, e, f = (family(rng, 60, 1, 1) for _ in range(6))
    rows = [
        (1, a[0]), (None, a[1]),  # the null id goes, the next two don't
        (None, b[0]), (None, c[0]),
        (2, d[0]), (3, d[1]), (3, e[0]),  # one of two texts under one id is a copy
        (4, f[0]), (4, f[0]), (4, f[1]),  # copies with one id
        (None, e[1] + " of"), (None, "alone and twice here"), (None, "alone and twice here"),
    ]
    docs = spark.createDataFrame([(i, t, "aa", "s", len(t)) for i, t in rows], SCHEMA).repartition(4)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted((i for i, _ in kept), key=str) == [1, 2, 3, 4, None, None, None]
    assert {t for i, t in kept if i is None} == {b[0], c[0], "alone and twice here"}
    assert (3, e[0]) in kept


def test_index_of_wide_codes_equals_brute_force():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, (40, 4), dtype=np.uint64)
    codes = base[rng.integers(0, 40, 400)]
    for _ in range(12):
        at = rng.integers(0, 256, 400)
        codes[np.arange(400), at // 64] ^= np.uint64(1) << (at % 64).astype(np.uint64)
    group = rng.integers(0, 3, 400)
    index = simhash.GrayIndex(group, codes)
    differ = np.bitwise_count(index.codes[:, None] ^ index.codes[None]).sum(axis=2)
    want = {(a, b) for a, b in zip(*np.nonzero((differ <= 20) & (index.group[:, None] == index.group[None]))) if a > b}
    every = lambda a, b: np.ones(len(a), bool)
    got = [(int(x), int(y)) for a, b in index.pairs(20, np.arange(400), every) for x, y in zip(a, b)]
    assert len(got) == len(set(got)) and {(max(p), min(p)) for p in got} == want
    tree = [(int(x), int(y)) for a, b in index.pairs(20, None, every) for x, y in zip(a, b)]
    assert {(max(p), min(p)) for p in tree} <= want
    edges = np.array(list(want))
    label = roots(edges[:, 0], edges[:, 1], 400)
    few = np.array(tree)
    assert np.array_equal(roots(few[:, 0], few[:, 1], 400), label) and len(tree) == 400 - len(set(label))


def test_sketches_lose_no_similar_pair():
    rng = random.Random(4)
    for n, edits in [(9, 1), (30, 1), (200, 8), (3000, 120)]:
        a, *others = (near.shingles(t) for t in family(rng, n, 12, edits))
        for b in others:
            same = len(np.intersect1d(a, b))
            if same >= 0.8 * (len(a) + len(b) - same):
                x, y = (np.frombuffer(near.sketch(s), np.uint64) for s in (a, b))
                assert np.bitwise_count(x[:4] ^ y[:4]).sum() <= near.radius(0.8)
                assert np.bitwise_count(x[4:] ^ y[4:]).sum() <= (len(a) + len(b)) / 9 + 1e-6
                none = np.zeros(0, np.uint64)
                assert len(np.intersect1d(near.keys(a, none, none, 0.8), near.keys(b, none, none, 0.8)))
