"""The template tree against a pattern for each template, and extraction against a plain walk."""

import random
import re

import pytest
from pyspark.sql import functions as F

from logweir.operators import templates


def best_of(line, table):
    found = []
    for signature, template, names in table:
        t = template.split()
        pattern = "^" + " ".join(r"\S+(?: \S+){0,4}" if x == "<*>" else re.escape(x) for x in t) + "$"
        if t and re.match(pattern, " ".join(line.split())):
            found.append((-sum(x != "<*>" for x in t), ["￿" if x == "<*>" else "" for x in t], template, signature))
    return min(found)[-1] if found else None


def plain_values(line, template, names):
    found, at, wild = {}, 0, 0
    for k, token in enumerate(template):
        if at >= len(line):
            break
        if token != "<*>":
            at += 1
            continue
        stop = template[k + 1] if k + 1 < len(template) else None
        end = at
        while end < len(line) and end - at < 5 and line[end] != stop:
            end += 1
        if end > at:
            found[names.get(wild, f"unknown_field_{wild}")] = " ".join(line[at:end])
        at, wild = end, wild + 1
    return found


@pytest.mark.parametrize("seed", range(3))
def test_tree_equals_patterns(spark, seed):
    rng = random.Random(seed)
    words = ["a", "b", "c", "dd"]
    table = {}
    for k in range(60):
        t = " ".join(rng.choice([*words, "<*>", "<*>"]) for _ in range(rng.randint(1, 7)))
        table[t] = (f"s{k}", t, {0: "x", 1: rng.choice("xy")})
    table = list(table.values())
    lines = [(i, "  ".join(rng.choice([*words, "e"]) for _ in range(rng.randint(0, 14)))) for i in range(400)]
    t = spark.createDataFrame(table, "signature string, template string, position_map map<int,string>")
    rows = spark.createDataFrame(lines, "id long, line string")
    matched = templates.extract_values(templates.match_templates(rows, t).join(rows, "id")).collect()
    by_sig, text = {r[0]: r for r in table}, dict(lines)
    assert {r.id: r.signature for r in matched} == {i: b for i, x in lines if (b := best_of(x, table))}
    for r in matched:
        _, template, names = by_sig[r.signature]
        assert r["values"] == plain_values(text[r.id].split(), template.split(), names)


def test_side_by_side_and_long_lines(spark):
    table = [("w", "<*> <*> <*>", {}), ("m", "go <*> <*> end", {0: "p", 1: "q"}), ("h", "<*> end", {0: "all"})]
    lines = [(1, "one two three"), (2, "go " + "x " * 10 + "end"), (3, "go " + "x " * 11 + "end"), (4, "go x end"), (5, "y " * 15), (6, "y " * 16), (7, "word " * 100_000), (8, "end")]
    t = spark.createDataFrame(table, "signature string, template string, position_map map<int,string>")
    rows = spark.createDataFrame(lines, "id long, line string")
    matched = templates.match_templates(rows, t)
    assert "RLIKE" not in matched._jdf.queryExecution().toString().upper()
    assert {r.id: r.signature for r in matched.collect()} == {1: "w", 2: "m", 3: "w", 4: "h", 5: "w"}
    got = {r.id: r["values"] for r in templates.extract_values(matched.join(rows, "id")).collect()}
    assert got[2] == {"p": "x x x x x", "q": "x x x x x"} and got[4] == {"all": "go x"}
    nothing = t.where("false")
    assert templates.match_templates(rows, nothing).count() == 0 and templates.match_templates(rows.where("false"), t).count() == 0


def test_edges_tell_what_can_be_left(spark):
    t = spark.createDataFrame([("s", "a <*> b", {}), ("t", "a <*>", {}), ("u", "a c", {})], "signature string, template string, position_map map<int,string>")
    edges, leaves = templates.trie(t)
    assert {(r.node, r.token): (r.child, r.least, r.most, r.wild) for r in edges.collect()} == {("", "a"): ("a", 1, 6, 0), ("a", "<*>"): ("a <*>", 0, 1, 1), ("a", "c"): ("a c", 0, 0, 0), ("a <*>", "b"): ("a <*> b", 0, 0, 1)}
    assert leaves.agg(F.count("*")).first()[0] == 3
