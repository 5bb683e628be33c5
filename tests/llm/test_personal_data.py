"""Base spans against the patterns as they are written, votes and reliabilities, added spans, odd texts."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweir.llm import personal_data as pd
from logweir.llm.queries import op11_personal_data


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def by_the_letter(text):
    """The contract's patterns, backtracking and all."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return found


PIECES = ["a", "b.c", "@", "@", "x-y", ".", "..", "com", "+", "1", "23", "255", "256", "007", ".", " ", "-", "(", ")", "é", "𝄞", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "10.0.0.1", "\n", "_", "%", "0" * 15]


@pytest.mark.parametrize("seed", range(4))
def test_base_spans(seed):
    rng = random.Random(seed)
    for _ in range(4000):
        text = "".join(rng.choices(PIECES, k=rng.randint(1, 25)))
        assert [(pd.KINDS[k], s, e) for k, s, e, _ in pd.base_spans(text)] == by_the_letter(text), text


def test_wide_spans_overlap_nothing():
    rng = random.Random(1)
    more = [*PIECES, "me (at) site (dot) org", "x[at]y.com", "2001:db8::1", "4111.1111.1111.1111", "(017) 555-7713", "0044 017 555 7713", "017-555-7713"]
    for _ in range(5000):
        text = "".join(rng.choices(more, k=rng.randint(1, 20)))
        base = pd.base_spans(text)
        wide = pd.wide_spans(text, base)
        spans = sorted((s, e) for _, s, e, _ in wide)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
        assert not any(s < e2 and s2 < e for s, e in spans for _, s2, e2, _ in base)
        for span in [*base, *wide]:
            assert len(pd.votes(text, span)) == len(pd.LABELERS)


@pytest.mark.parametrize("bit", ["1", "1.", "1 ", "a@", "@", "a.", "+1", "+1 ", "1-", "4111 ", ":", "1:", "(at)", "a (at) b", "((", "(017) ", "a@b."])
def test_long_texts_take_linear_time(bit):
    started = time.time()
    text = bit * (1_000_000 // len(bit))
    base = pd.base_spans(text)
    pd.wide_spans(text, base)
    assert time.time() - started < 8


def test_reliabilities_are_found():
    rng = np.random.default_rng(0)
    truth, right = rng.random(20_000) < 0.5, np.array([0.95, 0.85, 0.7, 0.6, 0.9, 0.75])
    sign = np.where(truth, 1, -1)[:, None]
    cast = sign * np.where(rng.random((len(truth), 6)) < right, 1, -1) * (rng.random((len(truth), 6)) < 0.8)
    patterns, counts = np.unique(cast, axis=0, return_counts=True)
    found = pd.reliabilities(patterns, counts.astype(float))
    assert np.abs(found - right).max() < 0.03
    assert ((pd.posterior(cast, found) > 0.5) == truth).mean() > 0.95


TEXTS = ["Mail bo.b@site.example.com or call +1 (017) 555-7713.", "from 129.38.82.176, paid by card 4111 1111 1111 1111", "no data here", "", None, "version 1.2.3.4 build", "order 4929348385146306"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS * 12)], "doc_id long, text string").repartition(3)


def test_added_spans_and_redaction(spark, docs):
    model = pd.train(docs)
    assert model.right.shape == (4, 6) and (model.right >= 0.5).all()
    new = [
        ("write to jane.doe (at) firm (dot) org soon", "write to [EMAIL] soon"),
        ("login from 2001:db8:85a3::8a2e:370:7334 today", "login from [IP] today"),
        ("card 4111.1111.1111.1111 ok", "card [CARD] ok"),
        ("call (017) 555-7713 now", "call [PHONE] now"),
        ("é𝄞 a@b.co é", "é𝄞 [EMAIL] é"),
        ("at 12:30:45 we met in room 101-2020", "at 12:30:45 we met in room 101-2020"),
        (None, None),
        ("", ""),
    ]
    frame = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(new)], "doc_id long, text string")
    told = pd.find(frame, model).collect()
    assert [r.redacted for r in sorted(told)] == [w for _, w in new]
    for r in told:
        assert [s.start for s in r.spans if s.base] == [s[1] for s in by_the_letter(r.text or "")]
    none = pd.find(frame, model, threshold=1.1, keep_text=False)
    assert none.columns == ["doc_id", "spans"] and all(s.base for r in none.collect() for s in r.spans)


def test_empty_and_clashing(spark, docs):
    nothing = docs.where("false")
    model = pd.train(nothing)
    assert pd.find(nothing, model).count() == 0
    assert (model.right == 0.8).all()
    odd = docs.select("*", *(F.lit(5).alias(c) for c in ("spans", "kind", "cast", "words", "count", "a.b", "in0")))
    key = lambda r: (r.doc_id, r.text, r.spans, r.redacted)
    same = pd.train(odd)
    assert np.allclose(same.weights, pd.train(docs).weights)
    assert sorted(map(repr, map(key, pd.find(odd, same).collect()))) == sorted(map(repr, map(key, pd.find(docs, same).collect())))


def test_query(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_personal_data(spark, str(tmp_path)).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(got) == len(texts)
    for r in got:
        base = by_the_letter(texts[r.doc_id])
        joined = ",".join(":".join(map(str, s)) for s in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and set(joined.split(",")) - {""} <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pd.KINDS]
