"""Stored tables: versions, buckets, batches that run again."""

import pytest
from pyspark.sql import functions as F

from logweir.plans import batch
from logweir.schema import LLM_FAILURES, PARSE_FAILURES, PARSED_LOGS, REGISTRY, TEMPLATES
from logweir.sources import readers, sinks
from logweir.streaming import ingest as stream

KV = "k string, n long"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def frame(spark, data):
    return spark.createDataFrame(data, KV)


def test_a_reader_keeps_its_version(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert rows(sinks.read_table(spark, path, KV)) == []
    sinks.replace_table(frame(spark, [("a", 1)]), path)
    held = sinks.read_table(spark, path, KV)
    sinks.replace_table(sinks.read_table(spark, path, KV).withColumn("n", F.col("n") + 1), path)
    sinks.replace_table(sinks.read_table(spark, path, KV).withColumn("n", F.col("n") + 1), path)
    assert rows(held) == [("a", 1)] and rows(sinks.read_table(spark, path, KV)) == [("a", 3)]
    for _ in range(3):
        sinks.replace_table(frame(spark, [("z", 0)]), path)
    assert len(list((tmp_path / "t").glob("data-*"))) == sinks.KEPT
    assert sinks.drop_table(spark, path) and rows(sinks.read_table(spark, path, KV)) == []


def test_a_second_writer_is_told(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    sinks.replace_table(frame(spark, [("a", 1)]), path)
    seen = sinks.current(spark, path)
    sinks.replace_table(frame(spark, [("b", 1)]), path)
    with pytest.raises(RuntimeError):
        sinks._commit(spark, path, sinks.Version(seen.number + 1, seen.parts, seen.done))
    assert rows(sinks.read_table(spark, path, KV)) == [("b", 1)]


def test_only_touched_buckets_are_read_and_written(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    many = frame(spark, [(f"k{i}", i) for i in range(300)])
    put = lambda new: lambda stored: sinks.upsert(stored, new, "k")
    assert sinks.update_buckets(spark, path, KV, "k", many, put(many), ("w", 0))
    before = sinks.current(spark, path)
    two = frame(spark, [("k5", -5), ("new", 7)])
    numbers = sinks.touched(two, "k")
    read = sinks.read_buckets(spark, path, KV, numbers)
    assert {f.rsplit("/", 2)[-2] for f in read.inputFiles()} <= {f"bucket={n}" for n in numbers} and len(numbers) <= 2
    assert sinks.update_buckets(spark, path, KV, "k", two, put(two), ("w", 1))
    after = sinks.current(spark, path)
    assert {k for k in after.parts if after.parts[k] != before.parts.get(k)} == set(map(str, numbers))
    want = {f"k{i}": i for i in range(300)} | {"k5": -5, "new": 7}
    assert dict(rows(sinks.read_table(spark, path, KV))) == want
    assert not sinks.update_buckets(spark, path, KV, "k", two, lambda stored: stored.where("false"), ("w", 1))
    assert sinks.update_buckets(spark, path, KV, "k", two, lambda stored: stored.where("k <> 'new' and k <> 'k5'"), ("v", 1))
    assert dict(rows(sinks.read_table(spark, path, KV))) == {k: n for k, n in want.items() if k not in ("new", "k5")}


class Once:
    def generate(self, lines, signatures):
        return [{"fields": {"temperature": r"temp=(\S+)"} if "temp" in x else {}, "confidence": 0.9, "parse_flags": [] if "temp" in x else ["llm_failed"]} for x in lines]


def everything(store):
    shown = {"parsed_logs": PARSED_LOGS, "parse_failures": PARSE_FAILURES, "llm_failures": LLM_FAILURES, "registry": REGISTRY}
    return {n: rows(store.table(n, s).drop("ingested_at", "failed_at", "created_at", "updated_at")) for n, s in shown.items()}


def test_a_batch_twice_is_a_batch_once(spark, tmp_path):
    store = batch.Store(spark, f"file://{tmp_path}/store")
    text = "".join(f"heater temp={i}.5C ok\n" for i in range(12)) + "pump failed on start\nx\n"
    files = readers.from_bytes(spark, [("a.log", text.encode())])
    first = batch.run_files(store, files, Once(), "plain_text", batch=("files", 0))
    once = everything(store)
    assert (first.inserted, first.failed, len(once["llm_failures"]), len(once["parse_failures"])) == (13, 1, 1, 1)
    again = batch.run_files(store, files, Once(), "plain_text", batch=("files", 0))
    assert again.inserted == 0 and everything(store) == once
    sinks.drop_table(spark, store.at("registry"))  # as if the batch had broken off before its last write
    batch.run_files(store, files, Once(), "plain_text", batch=("files", 0))
    assert everything(store) == once
    batch.run_files(store, files, Once(), "plain_text", batch=("files", 1))
    hits = {r.signature: r.hit_count for r in store.table("registry", REGISTRY).collect()}
    assert list(hits.values()) == [12] and len(everything(store)["parsed_logs"]) == 13


def test_a_stream_batch_that_runs_again(spark, tmp_path):
    store = batch.Store(spark, f"file://{tmp_path}/store")
    lines = spark.createDataFrame([("s", f"TOOL=T{i % 3} temp={i}C") for i in range(20)], "source string, line string")
    stream.process_batch(store, lines, Once(), ("stream", 0))
    once = everything(store)
    stream.process_batch(store, lines, Once(), ("stream", 0))
    assert everything(store) == once
    stream.process_batch(store, lines, Once(), ("stream", 1))
    assert len(everything(store)["parsed_logs"]) == 20
    assert store.table("registry", REGISTRY).agg(F.sum("hit_count")).first()[0] == 20


def test_inserted_templates_stand_at_their_leaf(spark, tmp_path):
    store = batch.Store(spark, f"file://{tmp_path}/store")
    sig = store.insert_template("TOOL <*> ALARM <*>", ["tool", "alarm"])
    lines = spark.createDataFrame([(1, "TOOL A ALARM 7"), (2, "TOOL B ALARM 8 9"), (3, "other")], "id long, line string")
    assert {r.id: r.signature for r in store.match(lines).collect()} == {1: sig, 2: sig}
    assert store.insert_template("TOOL <*> ALARM <*>", ["tool_id", "alarm_code"]) == sig
    (row,) = store.table("templates", TEMPLATES).collect()
    assert row.hit_count == 2 and row.position_map == {0: "tool_id", 1: "alarm_code"}
    with pytest.raises(ValueError):
        store.insert_template("a <*>", [])
