"""Line dedup against brute force over all pairs of runs."""

import random

import pytest

from logweir.llm import line_dedup


def slow(docs, least):
    """docs: (id, text) with distinct ids, in order of id."""
    seq = {i: [(k, x) for k, x in enumerate(t.split("\n")) if x.split()] for i, t in docs}
    runs = {}
    for i in sorted(seq):
        s = seq[i]
        for a in range(len(s)):
            for b in range(a, len(s)):
                if sum(len(x.split()) for _, x in s[a : b + 1]) >= least:
                    runs.setdefault(tuple(x for _, x in s[a : b + 1]), []).append((i, s[a][0], s[b][0]))
    gone = {i: set() for i in seq}
    for places in runs.values():
        first = min(places)
        for i, a, b in places:
            if i > first[0] or i == first[0] and a > first[2]:
                gone[i] |= set(range(a, b + 1))
    for i, t in docs:
        for k, x in enumerate(t.split("\n")):
            if not x.split() and k - 1 in gone[i]:
                gone[i].add(k)
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in docs}


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(12)] + ["", "  "]
    block = [rng.choice(pool) for _ in range(6)]
    docs = []
    for i in range(40):
        lines = [rng.choice(pool) for _ in range(rng.randint(1, 8))]
        if rng.random() < 0.4:
            at = rng.randint(0, len(lines))
            lines[at:at] = block[rng.randint(0, 2) :]
        docs.append((i, "\n".join(lines)))
    want = slow(docs, 8)
    rng.shuffle(docs)
    got = line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string"), min_words=8).collect()
    assert {r.doc_id: r.text for r in got} == want
    assert any(r.n_removed for r in got)
    for r in got:
        assert len(r.removed) == r.n_removed


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long + "\nfirst"), (2, "own\n" + long + "\n\nend"), (2, "own\n" + long + "\n\nend"), (None, long), (3, None), (4, ""), (5, "\n".join([long, "x", long])), (6, "\n".join(["x"] * 70))]
    docs = spark.createDataFrame([(*r, "e", "f") for r in rows], "doc_id long, text string, removed string, spans string")
    got = line_dedup.line_dedup(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == len(rows)
    assert by[1][0].text == long + "\nfirst" and by[1][0].removed == []
    assert [r.text for r in by[2]] == ["own\nend"] * 2
    assert by[None][0].text == long
    assert by[3][0].text is None and by[3][0].n_lines == 0
    assert by[4][0].text == ""
    assert by[5][0].text == "x"
    assert by[6][0].n_removed == 0
    assert line_dedup.line_dedup(docs.where("false")).count() == 0


def test_windows_are_shortest_and_cover():
    assert line_dedup.windows([60, 3], 50) == {(0, 0), (0, 1)}
    assert line_dedup.windows([10, 10], 50) == set()
    assert line_dedup.windows([], 50) == set()


def test_only_shared_minima_are_extended(spark, monkeypatch):
    """What is stored are extensions of minima that stand in more than one place."""
    from logweir.llm.scratch import Scratch

    own = ["\n".join(f"own {i} line {k} of words" for k in range(40)) for i in range(6)]
    run = "\n".join(f"shared line {k} with some words" for k in range(30))
    docs = spark.createDataFrame([(i, t if i < 4 else t + "\n" + run) for i, t in enumerate(own)], "doc_id long, text string")
    kept = []
    keep = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, *by, **how: kept.append((df.columns, (out := keep(self, df, *by, **how)).count())) or out)
    found = line_dedup.repeats(docs, Scratch(spark, "t"), "doc_id", "text", 20).collect()
    assert [r.id for r in found] == [5]
    assert sorted({k for s in found[0].spans for k in range(s.start, s.stop + 1)}) == list(range(40, 70))
    stored = dict((tuple(c), n) for c, n in kept)
    assert stored[("id", "version", "win", "start", "stop")] < 2 * 2 * 40  # the two that share, a window or two a line
    assert all("text" not in c for c, _ in kept)
