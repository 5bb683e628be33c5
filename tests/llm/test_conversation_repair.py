"""Repairs against a search over all edits, path comparison with colliding hashes, and conversations cut into many stretches."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from logweir.llm import audit, conversation_repair
from logweir.llm.queries import op12_conversation_repair

WORD = re.compile(r"[^\x20\x09-\x0D]")


def faults_of(rows):
    """rows: (role, text) in order."""
    told, seen = [], set()
    for r in rows:
        visible = WORD.findall(r[1])
        told.append("blank" if not visible else "duplicate" if r in seen else "" if visible[-1] in ".!?" else "truncated")
        seen.add(r)
    return told


def search(rows):
    """Least (cost, edits, repaired rows) over all edits, by plain recursion over (row, state) with whole strings."""
    faults = faults_of(rows)

    @cache
    def best(k, state, left):
        found = [(0, "", ())] if k == len(rows) and state in (0, 3) else []
        put = lambda cost, edit, line, rest: found.append((cost + rest[0], edit + rest[1], line + rest[2])) if rest else None
        due = {0: "user", 1: "user", 2: "assistant", 3: "user"}[state]
        on = {0: 2, 1: 2, 2: 3, 3: 2}[state]
        if left:
            put(3, "I", (f"{due}:",), best(k, on, left - 1))
        if k < len(rows):
            role, text = rows[k]
            put(4, "D", (), best(k + 1, state, 3))
            if faults[k] not in ("blank", "duplicate"):
                more = 3 * (faults[k] == "truncated")
                if role[:1] == due[0] or role[:1] == "s" and state == 0:
                    put(more, "K", (f"{role}:{text}",), best(k + 1, 1 if role[:1] == "s" else on, 3))
                put(3 + more, "R", (f"{due}:{text}",), best(k + 1, on, 3))
        return min(found, default=None)

    return best(0, 0, 3)


def some_rows(rng, n):
    return [(rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", "sage", " "]), rng.choice(["Yes.", "No!", "so", " \t", "", "cut off", "A?  \n", "Well.", f"x{rng.random()}."])) for _ in range(n)]


@pytest.mark.parametrize("seed", range(60))
def test_stretches_joined_equal_search(seed):
    rng = random.Random(seed)
    rows = some_rows(rng, rng.randint(1, 14))
    cost, edits, _ = search(rows)
    marked = [(r[0][:1], f) for r, f in zip(rows, faults_of(rows), strict=True)]
    for size in (1, 2, 3, 20):
        parts = [audit.stretch(marked[k : k + size]) for k in range(0, len(marked), size)]
        total, way = audit.joined([{k: (c, r) for k, (c, _, r) in p.items()} for p in parts])
        assert (total, "".join(p[w][1] for p, w in zip(parts, way, strict=True)) + audit.ending(way[-1][1])) == (cost, edits)


@pytest.mark.parametrize("mod", [audit.MOD, 7, 1])
def test_paths_compare_like_lists_though_hashes_collide(monkeypatch, mod):
    monkeypatch.setattr(audit, "MOD", mod)
    rng = random.Random(mod)
    paths, nodes = audit.Paths(), [0]
    for _ in range(400):
        nodes.append(paths.add(rng.choice(nodes[-20:]), rng.randint(0, 2)))
    for a, b in (rng.choices(nodes, k=2) for _ in range(1500)):
        assert paths.less(a, b) == (paths.path(a) < paths.path(b))


def frame(spark, rows, schema="conv_id long, turn long, role string, text string"):
    return spark.createDataFrame(rows, schema).repartition(5)


def expected(rows):
    """conv_id: (gaps, blank, duplicate, truncated, illegal, cost, audit, repaired text) of (conv_id, turn, role, text)."""
    told = {}
    digest = lambda t: hashlib.sha256(t.encode()).digest()
    for c in {r[0] for r in rows}:
        own = [(t, " " if role is None else role, " " if text is None else text) for conv, t, role, text in rows if conv == c]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r[2])))
        said = [r[1:] for r in own]
        faults, turns = faults_of(said), [r[0] for r in own if r[0] is not None]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:], strict=False))
        cost, edits, lines = search(said)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        told[c] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, edits, "\n".join(lines))
    return told


def got(spark, rows, **how):
    told = conversation_repair.repair(frame(spark, rows), **how)
    texts = {r[0]: [] for r in rows}
    for r in told.turns.orderBy("place").collect():
        texts[r.conv_id].append(f"{r.role}:{r.text}")
    shas = {r.conv_id: r.sha256 for r in conversation_repair.digests(told.turns).collect()}
    assert shas == {c: hashlib.sha256("\n".join(t).encode()).hexdigest() for c, t in texts.items() if t}
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, "\n".join(texts[r.conv_id])) for r in told.reports.collect()}


@pytest.mark.parametrize("segment_rows", [2, 2048])
def test_repair(spark, segment_rows):
    rng = random.Random(segment_rows)
    rows = []
    for c in [*range(25), None]:
        turns = rng.choices([*range(9), None], k=rng.randint(1, 9))
        rows += [(c, t, *r) for t, r in zip(turns, some_rows(rng, len(turns)), strict=True)]
    rows += [(77, k, r, f"line {k}.") for k, r in enumerate(["user", "assistant"] * 60)]  # over many tasks and stretches
    rows += [(78, 1, "user", "Same.")] * 30 + [(79, None, None, None)] * 3 + [(80, 5, "user", "word " * 50_000)]
    rows += [(77, 4, "assistant", "line 3.")]
    rng.shuffle(rows)
    assert got(spark, rows, segment_rows=segment_rows) == expected(rows)


def test_empty_and_clashing(spark):
    told = conversation_repair.repair(frame(spark, []))
    assert told.reports.count() == told.turns.count() == conversation_repair.digests(told.turns).count() == 0
    rows = [(c, t, *r) for c in range(4) for t, r in enumerate(some_rows(random.Random(c), 6))]
    odd = frame(spark, rows).select("*", *(F.lit(3).alias(n) for n in ("conv", "kind", "told", "part", "a.b", "place", "cost")))
    plain = conversation_repair.repair(frame(spark, rows))
    again = conversation_repair.repair(odd)
    assert sorted(again.reports.collect()) == sorted(plain.reports.collect())
    assert sorted(again.turns.collect()) == sorted(plain.turns.collect())


def test_query(spark, tmp_path):
    rng = random.Random(5)
    rows = [(c, t, *r) for c in range(60) for t, r in enumerate(some_rows(rng, rng.randint(1, 8)))] + [(None, None, None, "x."), (500, None, "user", None)]
    dropped = next(c for c in range(1000, 9999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "gone."))
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    damaged = []
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if fate == 1 else re.sub(r"[.!?]", "", text) if fate == 2 else text
        damaged += [(c, t, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    want = {c: (0, 0, 0, 0, 0, 0, "", "") for c, *_ in rows} | expected(damaged)
    want = {c: (*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest()) for c, w in want.items()}
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert {r.conv_id: tuple(r[n] for n in names) for r in op12_conversation_repair(spark, str(tmp_path)).collect()} == want
