"""Katz scores against a plain model over dictionaries, and their normalisation."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from logweir.llm import katz


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1


def tokens(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [katz.END]


def plain_discounts(counter, k=5):
    """Katz's discounts from counts of counts on a fitted line, by sums."""
    n = Counter(c for c in counter.values() if c <= 64)
    rs = sorted(n)
    if len(rs) < 2:
        b = -2.0
    else:
        points = []
        for j, r in enumerate(rs):
            before = rs[j - 1] if j else 0
            after = rs[j + 1] if j + 1 < len(rs) else 2 * r - before
            points.append((math.log(r), math.log(2 * n[r] / (after - before))))
        mx, my = (sum(p[i] for p in points) / len(points) for i in (0, 1))
        b = min(-1.1, sum((x - mx) * (y - my) for x, y in points) / sum((x - mx) ** 2 for x, _ in points))
    fit = lambda r: r**b
    rest = (k + 1) * fit(k + 1) / fit(1)
    return {r: ((r + 1) * fit(r + 1) / fit(r) / r - rest) / (1 - rest) for r in range(1, k + 1)}


class Plain:
    """Counts by tuples of words, of every order; start marks fill up the first contexts."""

    def __init__(self, docs, order=2):
        self.order, self.c = order, {k: Counter() for k in range(1, order + 1)}
        for i, t in docs:
            if not held(i):
                padded = [katz.START] * (order - 1) + tokens(t)
                for at in range(order - 1, len(padded)):
                    for k in self.c:
                        self.c[k][tuple(padded[at - k + 1 : at + 1])] += 1
        self.n, self.v = sum(self.c[1].values()), len(self.c[1])
        self.d = {k: plain_discounts(c) for k, c in self.c.items()}
        kept = sum(self.cut(c, 1) for c in self.c[1].values())
        self.unknown = max(1 - kept / self.n, 0.5 / (self.n + 1)) if self.n else 1.0
        self.p1 = {w: self.cut(c, 1) / kept * (1 - self.unknown) for (w,), c in self.c[1].items()}
        self.after = defaultdict(dict)
        for k in range(2, order + 1):
            for g, c in self.c[k].items():
                self.after[g[:-1]][g[-1]] = c

    def cut(self, c, k):
        return c * self.d[k].get(c, 1.0)

    def p(self, w, h):
        if not h:
            return self.p1.get(w, self.unknown)
        seen, k = self.after.get(h, {}), len(h) + 1
        if not seen:
            return self.p(w, h[1:])
        total, used = sum(seen.values()), sum(self.cut(c, k) for c in seen.values())
        total += used >= total
        if w in seen:
            return self.cut(seen[w], k) / total
        return (1 - used / total) / (1 - sum(self.p(x, h[1:]) for x in seen)) * self.p(w, h[1:])

    def score(self, text):
        padded = [katz.START] * (self.order - 1) + tokens(text)
        high = sum(math.log10(self.p(padded[at], tuple(padded[at - self.order + 1 : at]))) for at in range(self.order - 1, len(padded)))
        return high, sum(math.log10((self.c[1][(w,)] + 0.5) / (self.n + 0.5 * (self.v + 1))) for w in tokens(text))


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choice(words[: rng.choice((3, 10, 60))]) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    return docs + [(9001, None), (9002, ""), (9003, "never\x0bSEEN Never\x1cseen"), (None, "w1 w2"), (7, docs[7][1]), (9004, "hot cold " * 300), (9005, "hot odd hot w1"), (9006, "long " * 30_000)]


@pytest.mark.parametrize("order,part", [(2, 1 << 20), (2, 40), (3, 40), (1, 1 << 20), (4, 1 << 20)])
def test_against_plain_model(spark, monkeypatch, order, part):
    docs = corpus(5)
    monkeypatch.setattr(katz, "PART_ENTRIES", part)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    if part < 1000:  # many small blocks
        frame = frame.repartition(23)
    model = Plain(docs, order)
    got = katz.katz_scores(frame, order=order).collect()
    assert len(got) == len(docs)
    want = sorted(((str(i), held(i), len(tokens(t)), sum(model.c[1][(w,)] > 0 for w in tokens(t)), *model.score(t)) for i, t in docs), key=lambda x: (x[0], x[2], x[4]))
    for r, w in zip(sorted(got, key=lambda r: (str(r.doc_id), r.n_tokens, r.score)), want):
        assert (str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (*w[:4], model.n)
        assert r.score == pytest.approx(w[4], abs=1e-7) and r.base_score == pytest.approx(w[5], abs=1e-8)


def test_operator_sums_to_one(spark):
    docs = corpus(6)
    model = Plain(docs)
    free = (i for i in range(20_000, 10**6) if held(i))
    words = [w for (w,) in model.c[1] if w != katz.END]
    asked = [(next(free), h, w) for h in ("w1", "hot", "w59", "neverseen") for w in [*words, "otherword"]]
    frame = spark.createDataFrame(docs + [(i, f"{h} {w}") for i, h, w in asked], "doc_id long, text string")
    told = {r.doc_id: r.score for r in katz.katz_scores(frame).collect()}
    total = Counter()
    for i, h, w in asked:  # the text is P(h | start) P(w | h) P(end | w)
        total[h] += 10 ** told[i] / model.p(h, (katz.START,)) / model.p(katz.END, (w,))
    for h, x in total.items():
        assert x + model.p(katz.END, (h,)) == pytest.approx(1, abs=1e-6)


def test_discounts_are_good_turing_at_any_size():
    for n in ([1000, 300, 150, 90, 60, 40, 30], [5, 9, 2, 0, 7, 1], [3], [0] * 64, [10, 10, 10, 10], [7, 0, 0, 0, 9]):
        d = katz.discounts(n)
        assert all(0 < x < 1 for x in d) and d == sorted(d)


def test_empty_and_untrained(spark):
    frame = spark.createDataFrame([(1, "a b"), (2, "a")], "doc_id long, text string")
    assert katz.katz_scores(frame.where("false")).count() == 0
    only = next(i for i in range(100) if held(i))
    (r,) = katz.katz_scores(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).collect()
    assert (r.held_out, r.n_known, r.train_tokens, r.score, r.base_score) == (True, 0, 0, 0.0, 0.0)


def test_packing():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**64, 1000, np.uint64))
    assert np.array_equal(katz.unpack_sorted(katz.pack_sorted(keys)), keys)
    counts = rng.integers(-5, 2**40, 77)
    assert np.array_equal(katz.unpack(katz.pack(counts)), counts)
    assert list(katz.cuts(keys, 7)) == sorted(katz.cuts(keys, 7))
