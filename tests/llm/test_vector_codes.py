"""Codes against plain Lloyd rounds in Python integers; odd vectors, ties and hot entries."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweir.llm import vector_codes
from logweir.llm.queries import op13_vector_codes


def plain(rows, parts=4, entries=256, rounds=4):
    """{row number: (code, error)} and the books, of (id, vector) rows of one width."""
    kept = [(k, i, [math.floor(1024 * x) for x in v]) for k, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[1] is None, r[1] or 0, r[2]))
    w = len(kept[0][2]) // parts
    cut = lambda v, p: v[p * w : p * w + w]
    books = [[cut(v, p) for _, _, v in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda x, book: min((far(x, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, _, v in kept:
                own.setdefault(best(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(own[e]) for c in zip(*own[e], strict=True)] if e in own else old for e, old in enumerate(books[p])]
    told = {}
    for k, _, v in kept:
        each = [best(cut(v, p), books[p]) for p in range(parts)]
        told[k] = ([e for _, e in each], sum(d for d, _ in each))
    return told, books


def frame(spark, rows):
    return spark.createDataFrame([(i, v, k) for k, (i, v) in enumerate(rows)], "vec_id long, embedding array<double>, k int").repartition(5)


def check(spark, rows, **how):
    told, books = plain(rows, **how)
    got = vector_codes.compress(frame(spark, rows), owner_rows=7, **how)
    assert {r.k: (r.code, r.error) for r in got.rows.collect()} == told
    assert [r.vector for r in got.books.orderBy("part", "entry").collect()] == [c for book in books for c in book]
    return got


@pytest.mark.parametrize("seed", range(2))
def test_plain(spark, seed):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in rng.choice(centres)]) for i in range(120)]
    rows += [(1000, rows[3][1])] * 40  # a hot entry
    rows += [(3, rows[5][1]), (None, rows[6][1]), (7000, None), (7001, [1.0, None, *[0.0] * 6]), (7002, [math.nan] * 8), (7003, [math.inf] * 8)]
    rng.shuffle(rows)
    check(spark, rows, entries=16)


def test_ties_go_to_the_lower_entry_and_unused_ones_stay(spark):
    rows = [(i, [float(i // 2 % 3)] * 4) for i in range(12)] + [(20, [0.5] * 4), (21, [-0.0004] * 4)]
    check(spark, rows, entries=8)


def test_few_rows_large_numbers_and_other_lengths(spark):
    check(spark, [(2, [1.0, 2.0, 3.0, 4.0]), (1, [-1.5, 0.25, 9.0, 0.0])])
    check(spark, [(i, [1e4 * i, -3.0, 0.1 * i, 5e3 - i]) for i in range(9)], entries=3)
    odd = [(1, [1.0] * 6), (2, [1.0, 2.0, 3.0, 4.0]), (3, []), (4, [1e30, 0.0, 0.0, 0.0]), (5, [1.0] * 8)]
    got = {r.vec_id: (r.code, r.error) for r in vector_codes.compress(frame(spark, odd)).rows.collect()}
    assert got == {1: (None, None), 2: ([0] * 4, 0), 3: (None, None), 4: (None, None), 5: (None, None)}


def test_exact_beyond_doubles():
    rng = np.random.default_rng(0)
    parts, book = rng.integers(-(1 << 27), 1 << 27, (50, 4)), rng.integers(-(1 << 27), 1 << 27, (9, 4))
    best, far = vector_codes.nearest(parts, book)
    for x, b, d in zip(parts.tolist(), best, far, strict=True):
        each = [sum((a - c) ** 2 for a, c in zip(x, e, strict=True)) for e in book.tolist()]
        assert (each[b], b) == (d, each.index(min(each)))


def test_empty_and_clashing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int, code string")
    got = vector_codes.compress(none)
    assert got.rows.count() == got.books.count() == 0
    assert got.rows.columns == ["vec_id", "embedding", "label", "code", "error"]
    rows = frame(spark, [(i, [i / 7, 1.0, -i / 3, 0.5]) for i in range(30)])
    odd = rows.select("*", *(F.lit(1).alias(c) for c in ("row", "part", "error", "moved", "a.b", "position")))
    told = vector_codes.compress(odd, entries=4)
    key = lambda r: (r.k, r.code, r.error)
    assert sorted(map(key, told.rows.collect())) == sorted(map(key, vector_codes.compress(rows, entries=4).rows.collect()))
    back = vector_codes.decoded(told.rows, told.books).collect()
    books = {(r.part, r.entry): r.vector for r in told.books.collect()}
    for r in back:
        assert r.approx == [books[p, e][0] for p, e in enumerate(r.code)]
        assert sum((math.floor(1024 * x) - a) ** 2 for x, a in zip(r.embedding, r.approx, strict=True)) == r["error"]


def test_query(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], rng.choice((1, 1, 1, None, 2))) for i in range(80)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    told, books = plain([r[:2] for r in rows])
    by_label = {}
    for k, r in enumerate(rows):
        by_label[r[2]] = by_label.get(r[2], 0) + told[k][1]
    import hashlib

    sha = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    got = {tuple(r) for r in op13_vector_codes(spark, str(tmp_path)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()}
    assert got == {(i, bytes(told[i][0]).hex(), told[i][1], by_label[rows[i][2]], sha) for i in range(80)}
