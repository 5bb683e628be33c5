"""Targets against naive sharing; draws, rounding and odd rows."""

import random

import pytest

from logweir.llm import mixing


def slow_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    left = share * sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total >= cap * sizes[s]}
        if not over:
            return target | {s: left * w[s] / total for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_draws(spark, seed):
    rng = random.Random(seed)
    names = [None, "b", "a", "é", "Z", "￿", "𝄞", ""]
    rows = [(i, " \t".join("w" for _ in range(rng.choice((0, 1, 30, 90)))), rng.choices(names, [40, 5, 1, 3, 1, 1, 2, 9])[0]) for i in range(900)]
    rows += [(5000, None, "b"), (5001, "", "only empty"), (None, "x y", "a"), rows[3]]
    frame = spark.createDataFrame([(*r, "mine", 9, 9) for r in rows], "doc_id long, text string, source string, target string, rate int, copy int").repartition(4)
    got = mixing.mix(frame).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = slow_targets(sizes)
    taken = {}
    for r in got:
        assert r.size == len((r.text or "").split()) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size <= 2 * r.size
        rate = r.target / r.source_size if r.source_size else 0
        assert int(rate) <= r.copies <= int(rate) + 1
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    hot = None
    assert taken[hot] == pytest.approx(want[hot], rel=0.15)
    again = mixing.mix(frame.repartition(9)).collect()
    assert sorted(map(str, ((r.doc_id, r.taken) for r in again))) == sorted(map(str, ((r.doc_id, r.taken) for r in got)))
    assert mixing.emit(mixing.mix(frame)).count() == sum(r.copies for r in got)


def test_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(frame).count() == 0
    one = spark.createDataFrame([(1, "", "s"), (2, None, None)], "doc_id long, text string, source string")
    assert {(r.size, r.target, r.taken) for r in mixing.mix(one).collect()} == {(0, 0.0, 0)}


def test_rows_without_ids_draw_each_by_itself(spark):
    rng = random.Random(4)
    text = lambda k: " ".join("w" for _ in range(rng.randint(5, 15))) + f" {k % 7}"
    rows = [(k if s == "a" else None, "same words here" if s == "c" else text(k), s) for k, s in enumerate("abc" * 700)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = mixing.mix(frame).collect()
    taken, target = {}, {}
    for r in got:
        taken[r.source], target[r.source] = taken.get(r.source, 0) + r.taken, r.target
    assert len(got) == len(rows)
    for s in "abc":
        assert taken[s] == pytest.approx(target[s], rel=0.06)
    again = mixing.mix(frame.repartition(3)).collect()
    assert sorted((r.source, r.text, r.taken) for r in again) == sorted((r.source, r.text, r.taken) for r in got)
