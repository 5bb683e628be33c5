"""Odd files, long tokens, splits, parsers of the caller's, stored tables."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from logweir.functions import text as tx
from logweir.functions.time import free_form
from logweir.operators import anomaly, detect, staging
from logweir.plans import batch, provider, semantic
from logweir.schema import FIELD_MAPPINGS, LLM_FAILURES, PARSED_LOGS, REGISTRY, TEMPLATES
from logweir.sources import lines, readers, sinks


def test_one_odd_file_does_not_stop_the_job(spark):
    deep = "[" * 100_000 + "]" * 100_000
    files = readers.from_bytes(spark, [("good", b"a,b\n1,x\n2,y"), ("cr", b"a,b\n1,x\n2,y\rz\n"), ("long", b"a,b\n1," + b"x" * 200_000)])
    records = readers.ingest(files, "csv")
    assert {(r.source, r.error.split(":")[0]) for r in readers.errors(records).collect()} == {("cr", "Error")}
    told = {(r.source, r.n) for r in records.where("not corrupted").groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert told == {("good", 2), ("cr", 1), ("long", 1)}
    nested = readers.ingest(readers.from_bytes(spark, [("deep", deep.encode()), ("line", b'{"a": 1}\n' + deep.encode())]), "json")
    assert {(r.source, r.corruption_reason) for r in nested.where("corrupted").collect()} == {("deep", "invalid_json"), ("line", "invalid_json")}


def test_long_tokens_take_linear_time(spark):
    token = "x" * 1_000_000
    began = time.time()
    detect.scores(f"{token} {token}\n{token}=1 b=2".encode())
    assert time.time() - began < 5
    frame = spark.createDataFrame([(f"a=1 {token} b={token}",)], "t string")
    r = frame.select(F.size(tx.pairs(F.col("t"), lines.KEY_VALUE)).alias("kv"), F.size(tx.pairs(F.col("t"), lines.LOGFMT)).alias("lf"), F.size(tx.parse_kv_pairs(F.col("t"))).alias("m"), detect.route_text(F.col("t")).alias("route")).first()
    assert (r.kv, r.lf, r.m, r.route) == (2, 2, 2, "keyvalue")
    assert time.time() - began < 60


def test_keys_are_as_with_the_plain_patterns(spark):
    """The patterns that begin at a run's start find what those find that may begin anywhere."""
    rng = random.Random(3)
    plain = re.compile(r"""([\w.\-/@]+)\s*(?:=|:)\s*(?:"([^"\\]*(?:\\.[^"\\]*)*)"|'([^'\\]*(?:\\.[^'\\]*)*)'|([^\s,;]+))""")
    texts = ["".join(rng.choice("ab1 =:\"'.,;-/@\\") for _ in range(rng.randint(0, 40))) for _ in range(600)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tx.pairs(F.col("t"), lines.KEY_VALUE).alias("p")).collect()
    for r in got:
        want = [(m[1], m[2] or m[3] or m[4] or "") for m in plain.finditer(texts[r.i])]
        assert [(p.k, p.v) for p in r.p] == want, texts[r.i]
    twice = re.compile(r'(?:\w+=(?:"[^"]*"|\S+)\s*){2,}')
    pair = re.compile(r"\w+\s*[=:]\s*\S+")
    told = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.col("t").rlike(detect._LOGFMT_PAIRS).alias("a"), F.regexp_count("t", F.lit(detect._PAIR)).alias("b")).collect()
    for r in told:
        assert (r.a, r.b) == (bool(twice.search(texts[r.i])), len(pair.findall(texts[r.i]))), texts[r.i]


def test_detection_reads_the_files_once(spark):
    files = readers.from_bytes(spark, [("a.json", b'{"level": "INFO", "msg": "x y"}'), ("b.csv", b"level,message\nINFO,hello\nWARN,there"), ("c.log", b"2024-01-01 10:00:00 ERROR broken")])
    records = readers.ingest(files)
    assert {(r.source, r.format) for r in records.collect()} == {("a.json", "json"), ("b.csv", "csv"), ("c.log", "plain_text")}
    plan = records._jdf.queryExecution().toString()
    assert "_detected" not in plan  # each parser reads its folder


def test_files_in_splits(spark, tmp_path):
    rng = random.Random(1)
    text = "".join(f"ts=2024-01-01T00:00:00Z level=INFO n={i} pad={'x' * rng.randint(0, 200)}\n" + "\n" * (i % 3 == 0) for i in range(4000))
    (tmp_path / "big.log").write_text(text)
    whole = readers.ingest_path(spark, str(tmp_path), format_override="logfmt")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        split = readers.ingest_lines(spark, str(tmp_path), "logfmt")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 3
        key = ("line_number", "raw", "level", "timestamp")
        assert sorted(split.select(*key).collect()) == sorted(whole.select(*key).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    with pytest.raises(ValueError):
        readers.read_lines(spark, str(tmp_path), "csv")


def test_parser_of_the_callers(spark):
    def words(files):
        told = files.select("source", "format", F.posexplode(F.split("text", " ")).alias("at", "raw"))
        entry = F.array(F.struct(F.lit("word").alias("k"), F.col("raw").alias("v"), F.lit(True).alias("text")))
        return told.select("source", "format", (F.col("at") + 1).alias("line_number"), "raw", F.lit(False).alias("corrupted"), F.lit("").alias("corruption_reason"), entry.alias("entries"), F.lit(None).cast("string").alias("fallback"))

    readers.register_parser("words", words)
    try:
        assert "words" in readers.supported_formats()
        got = readers.ingest(readers.from_bytes(spark, [("f", b"one two")]), "words").collect()
        assert sorted((r.line_number, r.fields["word"], r.format) for r in got) == [(1, "one", "words"), (2, "two", "words")]
    finally:
        assert readers.unregister_parser("words")
    assert readers.ingest(readers.from_bytes(spark, [("f", b"one two")]), "words").first().format == "plain_text"
    with pytest.raises(ValueError):
        readers.unregister_parser("json")


def test_options(spark):
    files = readers.from_bytes(spark, [("f", b"name;size\n'a;b';2\nc;3")])
    got = readers.ingest(files, "csv", options={"csv": {"delimiter": ";", "quote": "'"}}).collect()
    assert sorted(r.fields["name"] for r in got) == ["a;b", "c"]
    nested = readers.from_bytes(spark, [("f", b'{"a": {"b": 1}}')])
    assert readers.ingest(nested, "json", options={"json": {"flat": False}}).first().fields == {"a": '{"b": 1}'}
    assert readers.ingest(nested, "json").first().fields == {"a.b": "1"}


def test_stored_names_failures_pool_and_swap(spark, tmp_path):
    store = batch.Store(spark, str(tmp_path / "store"))
    store.learn_names({"Druck": "pressure", "Ort": "tool_id"})
    store.learn_names({"druck": "temperature"})
    assert store.learned() == {"druck": "temperature", "ort": "tool_id"}
    with pytest.raises(ValueError):
        store.learn_names({"x": "no such"})
    (tmp_path / "more.json").write_text('{"mappings": {"Druck": "voltage", "Strom": "current", "odd": "nothing"}}')
    assert store.load_names(str(tmp_path / "more.json")) == 1
    assert store.learned() == {"druck": "temperature", "ort": "tool_id", "strom": "current"}
    assert store.table("field_mappings", FIELD_MAPPINGS).count() == 3

    def broken(prompt):
        raise ConnectionError("gone")

    raw = spark.createDataFrame([("1", "s", "json", {"raw_text": "pump 5 failed", "ts": "noon of 3rd May 2024"}), ("2", "s", "json", {"raw_text": "pump 6 failed", "ts": "2024-05-03T00:00:00Z"})], "record_id string, log_source string, format string, record map<string,string>")
    batch.run_records(store, raw, provider.TextModel(broken, attempts=2, wait=lambda s: None))
    failed = store.table("llm_failures", LLM_FAILURES).collect()
    assert [(r.raw_line, r.error, r.attempts) for r in failed] == [("pump 5 failed", "llm_failed", 2)]
    assert store.table("registry", REGISTRY).count() == 0

    old = spark.createDataFrame([(i, f"pump {w} started slowly") for i, w in enumerate(["north", "south", "north"])] + [(9, "something else entirely")], "id long, line string")
    assert store.build_pool(old) == 3
    near = store.alike(spark.createDataFrame([(1, "pump north started")], "id long, line string"), 1).first()
    assert near.example == "pump north started slowly"
    assert batch.learn_templates(store, old.select("line", F.col("id").alias("at"))) > 0
    hits = store.match(old)
    assert store.table("templates", TEMPLATES).agg(F.sum("hit_count")).first()[0] == hits.count() > 0
    assert store.reset("candidates", "nothing") == ["candidates"]


def test_free_times_and_validation(spark):
    rows = spark.createDataFrame([("3 May 2024 5pm", ["timestamp_parse_error", "x"]), ("nonsense", ["timestamp_parse_error"]), ("2024-01-01T00:00:00Z", [])], "timestamp string, parse_flags array<string>")
    whole = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in (x.split(" ", 1) for x in PARSED_LOGS.split(", "))])
    got = {(r.timestamp, tuple(r.parse_flags)) for r in semantic.read_free_times(whole).collect()}
    assert got == {("2024-05-03T17:00:00+00:00", ("x",)), ("nonsense", ("timestamp_parse_error",)), ("2024-01-01T00:00:00Z", ())}
    assert spark.range(1).select(free_form(F.lit(None).cast("string"))).first()[0] is None
    odd = spark.createDataFrame([("line", "alarm", "0.5")], "raw_line string, log_type string, mapping_confidence string")
    assert semantic.validate(odd).first().errors == []


def test_registry_row(spark):
    table = spark.createDataFrame([("a", '{"tool_id": "x(.)"}'), ("b", "not json"), ("a2", None)], "signature string, regex_patterns string")
    assert semantic.registry_row(table, "a").first().regex_patterns == {"tool_id": "x(.)"}
    assert semantic.registry_row(table, "b").first().regex_patterns == {}
    assert semantic.registry_row(table, "zz").count() == 0


def test_report_and_means(spark):
    staged = staging.stage([readers.ingest(readers.from_bytes(spark, [("f", b"level=INFO a=1\nlevel=WARN a=2\nlevel=INFO a=3\nx")]), "logfmt")])
    got = [(r.section, r.name, r.n) for r in staging.report(staged).collect()]
    assert got == [("totals", "total_seen", 4), ("totals", "clean", 3), ("totals", "corrupted", 1), ("totals", "duplicates", 0), ("corruption_reason", "line_too_short", 1), ("format", "logfmt", 3), ("level", "INFO", 2), ("level", "WARN", 1)]
    import numpy as np

    forest = anomaly.Forest.fit(np.random.default_rng(1).normal(size=(300, 4)))
    rows = spark.createDataFrame([(1, 0.5, None, None, 9.0), (2, 1.5, None, None, 11.0), (3, None, None, None, None)], "id int, temperature double, pressure double, rf_power double, flow_rate double")
    told = {r.id: r.anomaly_score for r in anomaly.score_records(rows, forest).collect()}
    want = forest.score(np.array([[0.5, 0, 0, 9.0], [1.5, 0, 0, 11.0]]))
    assert [told[1], told[2]] == pytest.approx(list(want)) and told[3] == 0.0


def test_row_stores(spark):
    rows = spark.createDataFrame([("1", {"a": "b"}, ["x"], 0.0), ("2", None, [], 0.0)], "record_id string, extra map<string,string>, flags array<string>, anomaly_score double")
    flat = sinks.serialised(rows, F.lit("now")).orderBy("record_id").collect()
    assert [(r.extra, r.flags, r.ingested_at) for r in flat] == [('{"a":"b"}', '["x"]', "now"), (None, "[]", "now")]
    scored = sinks.set_scores(rows, spark.createDataFrame([("2", -0.7)], "record_id string, anomaly_score double"))
    assert {r.record_id: r.anomaly_score for r in scored.collect()} == {"1": 0.0, "2": -0.7}


def test_folder_is_listed_in_order(spark, tmp_path):
    for name, text in (("b.json", '{"a": 1, "b": "x y"}'), ("a.csv", "level,msg\nINFO,x\nWARN,y")):
        (tmp_path / name).write_text(text)
    assert [(r.source.rsplit("/", 1)[1], r.format) for r in readers.list_files(spark, str(tmp_path)).collect()] == [("a.csv", "csv"), ("b.json", "json")]
