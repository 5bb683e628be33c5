"""CSV files cut into many splits against the whole-file reader."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from logweir.sources import documents, readers, splits

CONF = {"spark.sql.files.maxPartitionBytes": "150", "spark.sql.files.openCostInBytes": "1"}


@pytest.fixture
def small(spark):
    before = {k: spark.conf.get(k) for k in CONF}
    for k, v in CONF.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_line_states_equal_the_reader(spark):
    """A line ends inside quotes when the reader would go on to the next line."""
    rng = random.Random(1)
    texts = ["".join(rng.choice('ab," "') for _ in range(rng.randint(0, 14))) for _ in range(1500)]

    def goes_on(text):
        return len(list(csv.reader(io.StringIO(text + '\nx",y\nz')))[0:1][0:1]) and next(csv.reader(io.StringIO(text + "\n\0MARK\n"))) != next(csv.reader(io.StringIO(text + "\n")))

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.col("t").rlike(splits.CLOSED).alias("closed"), F.col("t").rlike(splits.CLOSES).alias("closes")).collect()
    for r in rows:
        assert r.closed == (not goes_on(texts[r.i])), texts[r.i]
        assert r.closes == (not goes_on('"' + texts[r.i])), texts[r.i]


def some_csv(rng, n):
    cell = lambda: rng.choice(["web", "a b", "12", 'say "so"', "one\ntwo", "x,y", "", "three\n\nfour\n", '5" pipe', "é"])
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(["timestamp", "level", "host", "note", "message"])
    for k in range(n):
        writer.writerow([f"2024-01-15T10:{k % 60:02d}:01Z", rng.choice(["INFO", "warning"]), *(cell() for _ in range(rng.choice([3, 3, 3, 3, 2])))])
        if rng.random() < 0.1:
            out.write(rng.choice(["\n", 'a"b,c\n', ",,,,\n", '2024,"open\nline" tail,x,y,z\n']))
    return out.getvalue()


def test_many_splits_equal_the_whole_file(small, tmp_path):
    rng = random.Random(7)
    for k in range(4):
        (tmp_path / f"{k}.csv").write_bytes(some_csv(rng, 60).encode("latin-1" if k == 2 else "utf-8"))
    (tmp_path / "5.csv").write_text("a,b\n")
    (tmp_path / "6.csv").write_text("")
    (tmp_path / "7.csv").write_text('1,2\n3,"never closed\n' + "4,5\n" * 100)
    path = f"file://{tmp_path}"
    assert splits._lines(small, path, None).rdd.getNumPartitions() > 20
    want = readers.ingest_path(small, path, format_override="csv", pattern="*.csv").collect()
    got = splits.ingest_csv(small, path).collect()
    key = lambda r: (r.source, r.line_number, r.record_id)
    assert sorted(map(repr, sorted(got, key=key))) == sorted(map(repr, sorted(want, key=key)))
    assert len(got) > 200 and any("\n" in r.message for r in got)


def test_a_bad_record_is_told_alone(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes(b"a,b\n1,x\n2,y\rz\n3,w\n")
    got = splits.ingest_csv(spark, f"file://{tmp_path}", has_header=True).collect()
    assert sorted((r.line_number, r.corrupted) for r in got) == [(0, True), (2, False), (4, False)]


def test_one_long_cell(spark, tmp_path):
    (tmp_path / "x.csv").write_text('h,message\n1,"' + 'x""' * 200_000 + '"\n2,' + 'y"' * 200_000 + "\n")
    got = splits.ingest_csv(spark, f"file://{tmp_path}", has_header=True).collect()
    assert sorted(len(r.message) for r in got) == [400_000, 400_000]
    assert documents.csv_header(["a", "1"]) == (["col_0", "col_1"], False)
