"""Functions, templates, mapping, batch, stream and model by small literals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweir.functions import generate_signature, mask_variables, parse_timestamp, standardise_timestamp, to_iso8601, try_numeric
from logweir.functions.units import normalise_field
from logweir.operators import analyze, anomaly, detect, similar, staging, templates
from logweir.plans import batch, provider, semantic
from logweir.schema import PARSED_LOGS, REGISTRY, VENDOR_NAMES
from logweir.sources import raw_records, readers, sinks
from logweir.streaming import ingest as stream


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "text,iso",
    [
        ("2024-01-15T10:23:01.5+02:00", "2024-01-15T08:23:01.500Z"), ("15/Jan/2024:10:23:01 -0100", "2024-01-15T11:23:01.000Z"), ("Jan 5 2024 01:02:03", "2024-01-05T01:02:03.000Z"), ("Feb 29 10:00:00", None), ("13-02-2024 10:00:00", "2024-02-13T10:00:00.000Z"),
        ("02-13-2024 10:00:00", "2024-02-13T10:00:00.000Z"), ("04/03/2024", "2024-03-04T00:00:00.000Z"), ("04/03/2024 10:00:00", "2024-04-03T10:00:00.000Z"), ("1900-05-06", "2023-05-06T00:00:00.000Z"), ("2024-13-01", None), ("soon", None), ("", None),
    ],
)
def test_timestamps(spark, text, iso):
    assert one(spark, lambda c: to_iso8601(parse_timestamp(c, 2023)), text) == iso


@pytest.mark.parametrize("text,told", [("1713182600", "2024-04-15T12:03:20+00:00"), ("1713182600000", "2024-04-15T12:03:20+00:00"), ("04/15/2024 12:03:20", "2024-04-15T12:03:20+00:00"), ("15-Apr-2024 12:03:20", "2024-04-15T12:03:20+00:00"), ("2024-04-15T12:03:20Z", "2024-04-15T12:03:20Z"), ("never", "never")])
def test_standard_timestamps(spark, text, told):
    assert one(spark, lambda c: standardise_timestamp(c)[0], text) == told


@pytest.mark.parametrize("text,told", [("1,234", "1234"), ("-007", "-7"), ("+5", "5"), ("1_000", "1000"), ("5d", "5d"), ("1e3", "1000.0"), (".5", "0.5"), ("99999999999999999999", "99999999999999999999"), ("abc", "abc"), ("", "")])
def test_numbers(spark, text, told):
    assert one(spark, try_numeric, text) == told


@pytest.mark.parametrize(
    "field,text,value,flags",
    [
        ("temperature", "185.36F", 85.2, []), ("temperature", "358.35K", 85.2, []), ("pressure", "6749.93mtorr", 899.9142, []), ("temperature", "85.2X", 85.2, ["unknown_unit:temperature:X"]),
        ("temperature", "9999C", None, ["out_of_range:temperature:9999"]), ("voltage", "123456V", None, ["out_of_range:voltage:1.235e+05"]), ("current", "about 5", None, ["unparseable_value:current:about 5"]), ("rf_power", None, None, []),
    ],
)
def test_units(spark, field, text, value, flags):
    v, f = normalise_field(field, F.col("x"))
    r = spark.createDataFrame([(text,)], "x string").select(v.alias("v"), f.alias("f")).first()
    assert r.f == flags and (r.v is None if value is None else r.v == pytest.approx(value, abs=1e-3))


def test_signatures(spark):
    lines = ["TEMP 85.2 at 10.0.0.1", "TEMP 90.0 at 10.0.0.2", "PRES 85.2 at 10.0.0.1"]
    a, b, c = [r.s for r in spark.createDataFrame([(x,) for x in lines], "x string").select(generate_signature(F.col("x")).alias("s")).collect()]
    assert a == b != c and len(a) == 16
    assert one(spark, mask_variables, r"id 550e8400-e29b-41d4-a716-446655440000 /var/log/x ../y 0xFF") == "id <UUID> <PATH> <PATH> <HEX>"
    assert len(VENDOR_NAMES) == 88


def test_detection_votes():
    assert detect.detect_lines(["a=1 b=2", "c=3 d=4"]) == "logfmt"
    assert detect.detect_bytes(b"\0\1\2", "x") == "binary"
    assert detect.detect_bytes(b"", "x.csv") == "csv"
    assert detect.detect_bytes(b"hello", "") == "plain_text"


def test_second_parsers(spark):
    texts = [
        (0, '{"s":{"id":"001","v":[1,{"w":2}]}}\n[bad', "json"), (1, "<L><E id='1'><T>5</T></E></L>", "xml"), (2, "a,b\n1, 2\n3", "csv"), (3, "x: 1\n---\n- {y: [2]}", "yaml"),
        (4, 'a="q \\"z\\"" b= c=3', "logfmt"), (5, "k: 'v w' t=2", "keyvalue"), (6, "n|m\n1|2", "delimiter"), (7, "1;2", "delimiter"), (8, " plain ", "plaintext"), (9, "<34>2024-04-15T12:03:20Z ETCH01 mon[12]: ALARM", "syslog"), (10, "??", "other"), (11, "x", "binary"),
    ]
    got = raw_records.parse_texts(spark.createDataFrame(texts, "id long, text string, f string"), "f").orderBy("id", "at").collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r.record)
    assert by[0][0] == {"s.id": "001", "s.v[0]": "1", "s.v[1].w": "2"} or by[0][0].get("raw_text")
    assert by[1] == [{"E_id": "1", "E.T": "5"}]
    assert by[2] == [{"a": "1", "b": "2"}, {"a": "3", "b": None}]
    assert by[3] == [{"x": "1"}, {"y[0]": "2"}]
    assert by[4] == [{"a": 'q "z"', "b": None, "c": "3"}]
    assert by[5] == [{"k": "v w", "t": "2", "_raw_kv_line": "k: 'v w' t=2"}]
    assert by[6] == [{"n": "1", "m": "2"}] and by[7] == [{"field_0": "1", "field_1": "2"}]
    assert by[8] == [{"raw_text": "plain"}] and by[10] == [{"raw_text": "??"}] and 11 not in by
    assert by[9][0]["facility"] == "auth" and by[9][0]["severity"] == "critical" and by[9][0]["process_id"] == "12"


def test_templates(spark):
    lines = spark.createDataFrame([(0, "TOOL A ALARM 1"), (1, "TOOL B ALARM 1"), (2, "lonely line"), (3, "x")], "at long, line string")
    found = {r.template: r.position_map for r in templates.discover_templates(lines).collect()}
    assert found == {"TOOL <*> ALARM 1": {0: "unknown_field_0"}, "lonely line": {}, "x": {}}
    table = spark.createDataFrame([("s1", "TOOL <*> ALARM <*> SEV <*>", {0: "tool", 1: "alarm", 2: "sev"}), ("s2", "TOOL ETCH ALARM <*> SEV <*>", {0: "alarm"})], "signature string, template string, position_map map<int,string>")
    rows = spark.createDataFrame([(1, "TOOL ETCH ALARM E 3 SEV HIGH"), (2, "TOOL X ALARM E SEV a b c"), (3, "TOOL X")], "id long, line string")
    got = {r.id: (r.signature, r["values"]) for r in templates.extract_values(templates.match_templates(rows, table).join(rows, "id")).collect()}
    assert got == {1: ("s2", {"alarm": "E 3", "unknown_field_1": "HIGH"}), 2: ("s1", {"tool": "X", "alarm": "E", "sev": "a b c"})}
    with pytest.raises(ValueError):
        templates.build_position_map("a <*>", [])


def test_mapping_rules():
    assert semantic.apply_mapping("TOOL=ETCH01 TEMP=85.2", {"tool_id": r"TOOL=(\w+)", "temperature": r"TEMP=[\d.]+", "pressure": r"Q=(\d)", "x": "", "y": "("}) == (
        {"tool_id": "ETCH01", "temperature": "TEMP=85.2", "pressure": None, "x": None, "y": None}, ["pattern_miss:pressure", "empty_pattern:x", "regex_error:y"],
    )
    told = semantic.check_mapping({"confidence": 7, "fields": {"tool_id": "(a)", "bogus": "(a)", "lot_id": "(", "status": "a", "wafer_id": 5}})
    assert told["fields"] == {"tool_id": "(a)"} and told["confidence"] == 1.0
    assert set(told["parse_flags"]) == {"unknown_field:bogus", "invalid_regex:lot_id", "regex_group_count_0:status", "non_string_pattern:wafer_id"}


class Temp:
    def generate(self, lines, signatures):
        return [{"fields": {"temperature": r"temp=(\S+)"}, "confidence": 0.9, "parse_flags": []} for _ in lines]


def test_batch_learns_and_ignores_repeats(spark, tmp_path):
    store = batch.Store(spark, f"file://{tmp_path}/store")
    text = "".join(f"2024-01-15 10:23:{i:02d} INFO heater temp={i}.5C ok\n" for i in range(20)) + "xx\n"
    files = readers.from_bytes(spark, [("a.log", text.encode())])
    first = batch.run_files(store, files, Temp(), "plain_text")
    assert (first.total, first.inserted, first.failed, first.cache_hits) == (20, 20, 1, 0)
    second = batch.run_files(store, files, Temp(), "plain_text")
    assert (second.inserted, second.skipped, second.cache_hits) == (0, 20, 20)
    rows = store.table("parsed_logs", PARSED_LOGS).collect()
    assert sorted(r.temperature for r in rows) == [i + 0.5 for i in range(20)]
    assert all(r.log_type == "alarm" and "schema_error:invalid_alarm_severity:INFO" in r.parse_flags and -1 <= r.anomaly_score < 0 for r in rows)
    (entry,) = store.table("registry", REGISTRY).collect()
    assert entry.hit_count == 20 and entry.regex_patterns == {"temperature": r"temp=(\S+)"}
    assert batch.stored_failures(store).count() == 2
    assert batch.learn_templates(store, spark.createDataFrame([(0, "a 1"), (1, "a 2")], "at long, line string")) == 1


def test_stream(spark, tmp_path):
    store = batch.Store(spark, f"file://{tmp_path}/store")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.log").write_text("TOOL=T1 temp=5C\n<34>2024-04-15T12:03:20Z h p[1]: ALARM E334\n")
    q = stream.start(store, stream.read_lines(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/cp", available_now=True)
    q.awaitTermination(240)
    told = stream.health(q)
    assert not told["active"] and told["error"] is None and told["batch"] is not None
    rows = store.table("parsed_logs", PARSED_LOGS).collect()
    assert len(rows) == 2 and {r.tool_id for r in rows} == {"T1", None} and {r.temperature for r in rows} == {5.0, None}


def test_sinks(spark, tmp_path):
    records = readers.ingest(readers.from_bytes(spark, [("s", b"ts=2024-01-15T10:23:01Z level=info a=1\nb=2 c=3 level=warn\n")]), "logfmt")
    sinks.write_csv(records, f"{tmp_path}/csv")
    assert {"field.a", "field.b", "field.c"} <= set(spark.read.csv(f"{tmp_path}/csv", header=True).columns)
    sinks.write_ndjson(records, f"{tmp_path}/json")
    assert sinks.read_ndjson(spark, f"{tmp_path}/json", "record_id string, level string").count() == 2
    sinks.write_partitioned(records, f"{tmp_path}/parts")
    assert spark.read.parquet(f"{tmp_path}/parts").where("level = 'WARN'").count() == 1
    staged = staging.stage([records, records])
    assert staged.count() == 2 and {r.duplicates for r in staged.collect()} == {1}
    assert len(list(sinks.to_dicts(records))) == 2


def test_forest():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (300, 4)), [[9, 9, 9, 9]]])
    forest = anomaly.Forest.from_json(anomaly.Forest.fit(x).to_json())
    scores = forest.score(x)
    assert forest.raw(x).argmin() == 300 and (-1 <= scores).all() and (scores < 0).all()


def test_clusters(spark):
    lines = ["pump failed on start now", "pump failed on start again now", "valve stuck open", "valve stuck open", "nothing like it 42", "the 17"]
    frame = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    labels = {r.id: r.label for r in similar.cluster(frame).collect()}
    assert labels[2] == labels[3] != -1 and labels[4] == -1 and labels[5] == -1
    reps = similar.representatives(frame, spark.createDataFrame(list(labels.items()), "id long, label int"))
    assert {r.id for r in reps.collect()} >= {2, 4, 5} and 3 not in {r.id for r in reps.collect()}
    idf, _ = similar.fit(frame)
    near = similar.nearest(frame.where("id in (2, 5)"), frame, idf, 2).collect()
    assert sorted((r.id, r["rank"], r.candidate) for r in near) == [(2, 1, 2), (2, 2, 3), (5, 1, 0), (5, 2, 1)]


def test_provider():
    waits = []

    def fails(prompt):
        raise RuntimeError("busy")

    def quota(prompt):
        raise RuntimeError("Error 429: insufficient_quota")

    model = provider.TextModel(fails, wait=waits.append)
    assert model.generate(["a"], ["s"]) == [{"fields": {}, "confidence": 0.0, "parse_flags": ["llm_failed"]}] and waits == [1.0, 2.0, 4.0, 8.0]
    waits.clear()
    assert provider.TextModel(quota, wait=waits.append).generate(["a"], ["s"])[0]["parse_flags"] == ["llm_quota_exceeded"] and not waits
    answer = 'Sure:\n```json\n[{"fields": {"tool_id": "T=(\\\\w+)"}, "confidence": 0.5}, {}, {}]\n```'
    told = provider.TextModel(lambda prompt: answer).generate(["T=1", "x"], ["s1", "s2"])
    assert [t["signature"] for t in told] == ["s1", "s2"] and told[0]["fields"] == {"tool_id": r"T=(\w+)"}
    assert provider.parse_response("nonsense", ["s"])[0]["fields"] == {}
    assert "temperature" in provider.build_prompt(["l"], ["s"], ["e"])


def test_names_views_and_shares(spark):
    assert semantic.learn_name({}, " Chuck ", "tool_id") == {"chuck": "tool_id"}
    with pytest.raises(ValueError):
        semantic.learn_name({}, "x", "bogus")
    frame = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    analyze.register(spark, "my-view", frame)
    assert ("my_view", 4) in analyze.list_tables(spark)
    assert analyze.unregister(spark, "my_view")
    assert {r.label: r.share_pct for r in analyze.with_share(analyze.chart(frame, "k")).collect()} == {"a": 50.0, "b": 25.0, None: 25.0}
    with pytest.raises(ValueError):
        analyze.chart(frame, "nope")


def test_staged_records(spark, tmp_path):
    records = readers.ingest(readers.from_bytes(spark, [("s", b"ts=2024-01-15T10:23:01Z level=info tool=T9 temp=5C\n")]), "logfmt")
    sinks.write_ndjson(records, f"{tmp_path}/in")
    with open(tmp_path / "in" / "extra.json", "w") as f:
        f.write("{broken\n")
    store = batch.Store(spark, f"file://{tmp_path}/store")
    result = batch.run_staged(store, f"{tmp_path}/in")
    assert (result.inserted, result.failed) == (1, 1)
    (row,) = store.table("parsed_logs", PARSED_LOGS).collect()
    assert (row.tool_id, row.temperature) == ("T9", 5.0)
