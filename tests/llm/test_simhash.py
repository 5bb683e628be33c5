"""Fingerprints, the Gray index and components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from logweir.llm import simhash
from logweir.llm.components import components
from logweir.llm.scratch import Scratch


def slow_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def slow_components(codes):
    label = list(range(len(codes)))
    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= 3 and label[i] != label[j]:
                a, b = max(label[i], label[j]), min(label[i], label[j])
                label = [b if x == a else x for x in label]
    return label


def test_fingerprint():
    for text in ("", " \t", "One", "one TWO", "a b c", "É A\x0bb\x1cc d e f g", "x " * 40_000):
        assert simhash.fingerprint(text) == slow_fingerprint(text), text[:20]


@pytest.mark.parametrize("seed", range(4))
def test_gray_index(seed):
    rng = random.Random(seed)
    codes = {rng.getrandbits(64) for _ in range(60)} | {0}
    for c in list(codes)[:8]:
        for _ in range(30):
            x = c
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
            codes.add(x)
    codes = np.array(sorted(codes), np.uint64)
    index = simhash.GrayIndex(np.zeros(len(codes), np.int64), codes)
    got = index.linked()
    want = slow_components([int(c) for c in index.codes[:, 0]])
    assert list(got) == want
    assert len(np.unique(simhash.gray_rank(codes))) == len(codes)
    ordered = [int(i) ^ (int(i) >> 1) for i in range(64)]
    assert list(simhash.gray_rank(np.array(ordered, np.uint64))) == list(range(64))


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1400)] + [(2000, x) for x in range(2001, 2300)]
    rng.shuffle(pairs)
    edges = spark.createDataFrame(pairs, "u long, v long").repartition(9)
    got = {r.u: r.v for r in components(edges, Scratch(spark, "t")).collect()}
    label = {x: x for p in pairs for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    assert got == {x: c for x, c in label.items() if x != c}
    assert components(edges.where("false"), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("hot", [simhash.HOT, 1])
def test_documents(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)  # of one: every shared route is split further
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(400)]
    rows = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.choice((1, 2, 5, 200, 400)))]
        for k in range(rng.choice((1, 1, 3))):
            text = list(base)
            if k == 2 and len(text) > 50:
                text[7] = "changed"
            rows.append((len(rows) * 3 + 1, " ".join(text), "s", "z"))
    rows += [(5000, None, None, None), (5001, "", "s", "z"), (None, " ", "s", "z"), (rows[0][0], rows[0][1], "s", "z"), (None, "alone in its group", "s", "z")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string, code string")
    got = simhash.simhash_components(docs).collect()
    codes = [slow_fingerprint(r[1] or "") for r in rows]
    label = slow_components(codes)
    lowest = {c: min((rows[i][0] for i in range(len(rows)) if label[i] == c and rows[i][0] is not None), default=None) for c in set(label)}
    want = sorted(((str(r[0]), f"{codes[i]:016x}", str(lowest[label[i]])) for i, r in enumerate(rows)))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert simhash.simhash_components(docs.where("false")).count() == 0
