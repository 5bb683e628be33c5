"""The pipeline against a plain version of its stages, on a small table."""

import random

import corpus_pipeline
import public_tokenizers as P
import pytest

from logweir.llm import bpe, mixing
from tests.llm.test_line_dedup import slow as slow_lines
from tests.llm.test_near import slow_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"aa": "ka lo mi tu ne so ra".split(), "bb": "sch ung eit ver ch ein".split()}


def corpus():
    rng = random.Random(11)
    make = lambda lang, n: " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    passage = make("aa", 70)
    rows = []
    for i in range(90):
        lang = rng.choice(list(SYLLABLES))
        text = "\n".join(make(lang, rng.randint(5, 30)) for _ in range(rng.randint(1, 4)))
        if lang == "aa" and rng.random() < 0.2:
            text += "\n" + passage
        rows.append((i, text, lang, f"s{i % 4}", len(text)))
    rows += [(200 + i, rows[i][1], rows[i][2], "s1", rows[i][4]) for i in range(8)]
    rows += [(300, "12 - 34", "aa", "s0", 7), (301, "", "aa", None, 0), (302, None, "aa", None, None), (303, "ЖЩЪ ФЫЭЮ " * 40, None, "s0", 360)]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages_against_plain_versions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "source_mixing", "byte_bpe"]
    known = corpus_pipeline.identify_language(spark, docs, folder)
    assert {r.doc_id for r in known.collect()} == {r[0] for r in corpus() if r[0] < 300}
    cut = corpus_pipeline.drop_repeated_lines(spark, known, folder)
    want = slow_lines([(r.doc_id, r.text) for r in known.collect()], 50)
    assert {r.doc_id: r.text for r in cut.collect()} == {i: t for i, t in want.items() if t.strip()}
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    rows = sorted((r.doc_id, r.text) for r in cut.collect())
    label = slow_components([t for _, t in rows])
    one = corpus_pipeline.drop_near_duplicates(spark, cut, folder)
    assert sorted(r.doc_id for r in one.collect()) == [rows[k][0] for k in sorted(set(label))]
    mixed = corpus_pipeline.mix_sources(spark, one, folder)
    copies = {r.doc_id: r.copies for r in mixing.mix(one).collect()}
    got = [r.doc_id for r in mixed.collect()]
    assert {i: got.count(i) for i in copies} == copies
    for stage in (known, cut, one, mixed):
        assert stage.columns == docs.columns
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        codec = bpe.codec(f.read(), P.PATTERN)
    texts = {r.doc_id: r.text for r in one.collect()}
    told = corpus_pipeline.run(spark, folder).collect()
    assert sorted(r.doc_id for r in told) == sorted(got)
    for r in told:
        assert codec.decode(r.ids).decode() == texts[r.doc_id]


def test_odd_rows(spark, tmp_path):
    """Null and repeated ids, a very long text, columns with odd names and of the stages' own."""
    rng = random.Random(2)
    make = lambda n: " ".join("".join(rng.choice(SYLLABLES["aa"]) for _ in range(3)) for _ in range(n))
    once = make(80)
    texts = [(i, make(30)) for i in range(12)] + [(None, make(30)), (None, make(30)), (20, once), (20, once), (21, once), (22, make(30)), (22, make(30)), (23, make(30_000))]
    frame = spark.createDataFrame([(i, t, "aa", rng.choice(["s", None]), len(t)) for i, t in texts], SCHEMA).selectExpr("*", "1 as `meta.x`", "2 as row", "3 as copies", "4 as n_removed", "5 as language")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, frame = frame, stage(spark, frame, "")
        assert frame.columns == before.columns
        if stage is corpus_pipeline.drop_near_duplicates:
            left = [(r.doc_id, r.text) for r in frame.collect()]
            assert len(left) == 18 and [i for i, t in left if t == once] == [20]
    assert corpus_pipeline.STAGES[-1][1](spark, frame, "").count() == frame.count()


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
