"""Lines flushed by count or by time, against a plain buffer."""

import time

from pyspark.sql import functions as F

from logweir.plans.batch import Store
from logweir.schema import PARSED_LOGS
from logweir.streaming import buffers, ingest as stream


def _wait(query, ready, limit=60):
    end = time.time() + limit
    while time.time() < end and not ready():
        assert query.exception() is None
        time.sleep(0.3)


def _run(spark, tmp_path, drops, size, seconds, ready, shards=1):
    """Drops (name, lines) into a folder one after the other; the rows flushed when ready(rows) holds."""
    inbox = tmp_path / "in"
    inbox.mkdir()
    spark.conf.set(*buffers.PROVIDER)
    files = spark.readStream.format("text").load(f"file://{inbox}")
    lines = files.select(F.substring_index("value", ":", 1).alias("source"), F.col("value").alias("line"))
    name = "held_" + tmp_path.name.replace("-", "_")
    query = buffers.flushed(lines, size, seconds, shards).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(processingTime="200 milliseconds").start()
    try:
        for file, texts in drops:
            part = tmp_path / (file + ".part")
            part.write_text("\n".join(texts))
            part.rename(inbox / file)
        _wait(query, lambda: ready(spark.table(name).collect()))
        return spark.table(name).collect()
    finally:
        query.stop()


def test_by_count(spark, tmp_path):
    lines = [f"{s}:{i}" for i in range(23) for s in "ab"]
    rows = _run(spark, tmp_path, [("1", lines)], 10, 3600, lambda r: len(r) >= 40)
    assert len(rows) == 40 and {r.reason for r in rows} == {"count"}  # three lines a source still wait
    for s in "ab":
        own = sorted((r.flush, r.place, r.line) for r in rows if r.source == s)
        assert [(f, p) for f, p, _ in own] == [(f, p) for f in range(2) for p in range(10)]
        assert len({x for _, _, x in own}) == 20 and {x for _, _, x in own} <= set(lines)


def test_by_time(spark, tmp_path):
    rows = _run(spark, tmp_path, [("1", [f"a:{i}" for i in range(13)] + ["b:0"])], 10, 1, lambda r: len(r) >= 14)
    assert sorted((r.source, r.flush, r.reason) for r in rows) == [("a", 0, "count")] * 10 + [("a", 1, "time")] * 3 + [("b", 0, "time")]
    assert sorted(r.line for r in rows if r.source == "a") == sorted(f"a:{i}" for i in range(13))


def test_held_lines_reach_the_tables(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.log").write_text("\n".join(f"2024-01-01T00:00:00Z tool_id=T{i} temperature={i}" for i in range(7)))
    store = Store(spark, f"file://{tmp_path}/store")
    query = stream.start(store, stream.read_lines(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/cp", seconds=1, size=5)
    stored = lambda: store.table("parsed_logs", PARSED_LOGS).count()
    try:
        _wait(query, lambda: stored() >= 7, 90)
    finally:
        query.stop()
    assert stored() == 7
