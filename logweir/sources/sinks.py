"""Tables out: files of records, first-wins inserts, upserts, counters.

What only grows is a folder of batches, each a partition that a rerun of the batch
overwrites. What changes is a folder of parts and a small file for each version
that names the parts in it; keyed tables have a part a bucket, and a batch
writes anew the buckets that its keys fall in.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.staging import keep_first
from ..tables import cut


MOST_COLUMNS = 10_000
BUCKETS = 64


def to_dicts(records: DataFrame):
    """Records one by one, a partition at a time in the driver."""
    for row in records.drop("raw").toLocalIterator():
        yield row.asDict(recursive=True)


def write_ndjson(records: DataFrame, path: str, include_corrupted: bool = False) -> None:
    kept = records if include_corrupted else records.where("not corrupted")
    kept.drop("raw").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def pivot_fields(records: DataFrame, most: int = MOST_COLUMNS) -> DataFrame:
    """The fixed columns and one column field.<key> for each key of fields, sorted. The distinct keys come to the driver: they are the columns of the result. ValueError beyond ``most`` of them."""
    keys = sorted(r[0] for r in records.select(F.explode(F.map_keys("fields")).alias("k")).distinct().limit(most + 1).collect())
    if len(keys) > most:
        raise ValueError(f"more than {most} keys would be columns")
    fixed = ("record_id", "source", "line_number", "format", "timestamp", "level", "message", "corrupted", "corruption_reason")
    return records.select(*fixed, *[F.try_element_at("fields", F.lit(k)).alias(f"field.{k}") for k in keys])


def write_csv(records: DataFrame, path: str, include_corrupted: bool = False, quote_all: bool = False) -> None:
    kept = records if include_corrupted else records.where("not corrupted")
    pivot_fields(kept).write.mode("overwrite").option("header", "true").option("quoteAll", str(quote_all).lower()).option("escape", '"').csv(path)


def write_partitioned(records: DataFrame, path: str, *columns: str) -> None:
    """Parquet in folders by format, level and day."""
    told = records.withColumn("day", F.substring("timestamp", 1, 10))
    told.write.mode("append").partitionBy(*(columns or ("format", "level", "day"))).parquet(path)


def read_ndjson(spark: SparkSession, path: str, schema: str, bad_column: str = "bad_line") -> DataFrame:
    """Staged NDJSON; a line that doesn't parse is kept as text in bad_column."""
    return spark.read.schema(f"{schema}, {bad_column} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad_column).json(path)


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


KEPT = 3


@dataclass
class Version:
    """What a stored table is made of: number of the version, folder of each part, and the last batch of each writer that is in it."""

    number: int = 0
    parts: dict[str, str] = field(default_factory=dict)
    done: dict[str, int] = field(default_factory=dict)


def _numbers(spark: SparkSession, path: str) -> list[int]:
    fs, at = _files(spark, f"{path}/_versions")
    return sorted(int(f.getPath().getName()[:-5]) for f in fs.listStatus(at) if f.getPath().getName().endswith(".json")) if fs.exists(at) else []


def _version(spark: SparkSession, path: str, number: int) -> Version:
    fs, at = _files(spark, f"{path}/_versions/{number:010d}.json")
    stream = fs.open(at)
    try:
        return Version(**json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()


def current(spark: SparkSession, path: str) -> Version:
    """The last version of a table; version 0 is an empty one."""
    path = path.rstrip("/")
    numbers = _numbers(spark, path)
    return _version(spark, path, numbers[-1]) if numbers else Version()


def _commit(spark: SparkSession, path: str, version: Version) -> None:
    """Makes a version the current one by a single rename: a reader sees the one before or this one, both whole. RuntimeError if another writer made this version first. Parts that none of the last KEPT versions has are deleted."""
    path = path.rstrip("/")
    name = f"{path}/_versions/{version.number:010d}.json"
    (fs, final), (_, beside) = _files(spark, name), _files(spark, f"{path}/_versions/{uuid.uuid4().hex}.tmp")
    out = fs.create(beside, True)
    out.write(bytearray(json.dumps(version.__dict__).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(beside, final):
        fs.delete(beside, False)
        raise RuntimeError(f"{path}: another writer made version {version.number}")
    numbers = _numbers(spark, path)
    held = {p.split("/")[0] for n in numbers[-KEPT:] for p in _version(spark, path, n).parts.values()}
    gone = {p.split("/")[0] for n in numbers[:-KEPT] for p in _version(spark, path, n).parts.values()} - held
    for part in gone:
        fs.delete(_files(spark, f"{path}/{part}")[1], True)
    for n in numbers[:-KEPT]:
        fs.delete(_files(spark, f"{path}/_versions/{n:010d}.json")[1], False)


def _rows(spark: SparkSession, path: str, schema: str, parts: Sequence[str]) -> DataFrame:
    return spark.read.schema(schema).parquet(*[f"{path.rstrip('/')}/{p}" for p in parts]) if parts else spark.createDataFrame([], schema)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The current version of a table, or an empty one if nothing was written yet."""
    return _rows(spark, path, schema, sorted(current(spark, path).parts.values()))


def replace_table(rows: DataFrame, path: str) -> None:
    """Writes rows, which may come from the table itself, as its next version. Readers of the versions before go on undisturbed."""
    spark, path = rows.sparkSession, path.rstrip("/")
    before, mark = current(spark, path), f"data-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{mark}")
    _commit(spark, path, Version(before.number + 1, {"": mark}, before.done))


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def is_done(spark: SparkSession, path: str, batch: tuple[str, int] | None) -> bool:
    """Whether a table holds a batch, named by its writer and number, already. A writer's numbers rise."""
    return batch is not None and current(spark, path).done.get(batch[0], -1) >= batch[1]


def touched(keys: DataFrame, key: str, buckets: int = BUCKETS) -> list[int]:
    return sorted(r[0] for r in keys.select(bucket_of(key, buckets)).distinct().collect())  # ``buckets`` numbers at most


def read_buckets(spark: SparkSession, path: str, schema: str, numbers: Sequence[int]) -> DataFrame:
    """The rows of some buckets only; files of others aren't listed nor read."""
    parts = current(spark, path).parts
    return _rows(spark, path, schema, [parts[str(n)] for n in numbers if str(n) in parts])


def update_buckets(
    spark: SparkSession, path: str, schema: str, key: str, keys: DataFrame, change: Callable[[DataFrame], DataFrame], batch: tuple[str, int] | None = None, buckets: int = BUCKETS,
) -> bool:
    """Rewrites the buckets that keys fall in: change gets their stored rows and gives what they are from now on. Other buckets stay where they are.

    The whole update is one version. A batch that the table holds already changes
    nothing; returns whether it did.
    """
    path = path.rstrip("/")
    before = current(spark, path)
    if batch is not None and before.done.get(batch[0], -1) >= batch[1]:
        return False
    numbers, mark = touched(keys, key, buckets), f"data-{uuid.uuid4().hex}"
    if numbers:
        new = change(_rows(spark, path, schema, [before.parts[str(n)] for n in numbers if str(n) in before.parts]))
        new.withColumn("bucket", bucket_of(key, buckets)).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/{mark}")
    parts = {k: p for k, p in before.parts.items() if k not in set(map(str, numbers))}
    for n in numbers:
        fs, at = _files(spark, f"{path}/{mark}/bucket={n}")
        if fs.exists(at):
            parts[str(n)] = f"{mark}/bucket={n}"
    _commit(spark, path, Version(before.number + 1, parts, {**before.done, **({batch[0]: batch[1]} if batch else {})}))
    return True


def batch_label(batch: tuple[str, int] | None) -> str:
    return f"{batch[0]}-{batch[1]}" if batch else uuid.uuid4().hex


def append_batch(rows: DataFrame, path: str, label: str) -> None:
    """Adds rows as the partition of a batch; a batch that runs again takes the place of what it wrote before."""
    told = rows.withColumn("batch", F.lit(label))
    told.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def read_batches(spark: SparkSession, path: str, schema: str, without: str | None = None) -> DataFrame:
    """The rows of all batches, or of all but one."""
    fs, at = _files(spark, path)
    if not fs.exists(at) or not fs.globStatus(_files(spark, f"{path.rstrip('/')}/batch=*")[1]):
        return spark.createDataFrame([], schema)
    told = spark.read.schema(f"{schema}, batch string").parquet(path)
    return (told.where(F.col("batch") != without) if without else told).drop("batch")


def drop_table(spark: SparkSession, path: str) -> bool:
    fs, at = _files(spark, path)
    return fs.delete(at, True)


def new_rows(rows: DataFrame, stored: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The rows that an insert-or-ignore adds: the first of each key that isn't stored."""
    return keep_first(rows, key, order).drop("duplicates").join(stored.select(key), key, "left_anti").select(*rows.columns)


def insert_or_ignore(rows: DataFrame, path: str, schema: str, key: str, order: Sequence[str], label: str | None = None) -> tuple[int, int]:
    """Adds new_rows as a batch; how many went in and how many were skipped. What the same batch wrote before doesn't count as stored."""
    label = label or batch_label(None)
    fresh = cut(new_rows(rows, read_batches(rows.sparkSession, path, schema, label), key, order))
    append_batch(fresh, path, label)
    added = fresh.count()
    return added, rows.count() - added


def upsert(stored: DataFrame, rows: DataFrame, key: str, keep: Sequence[str] = ()) -> DataFrame:
    """stored with rows in place of those of the same key; the columns in keep hold their stored value."""
    columns = stored.columns
    told = stored.select(key, F.struct(*columns).alias("o")).join(rows.select(key, F.struct(*columns).alias("n")), key, "full")
    pick = lambda c: F.coalesce(f"o.{c}", f"n.{c}") if c in keep else F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return told.select(*[F.col(key) if c == key else pick(c).alias(c) for c in columns])


def add_hits(stored: DataFrame, used: DataFrame, key: str = "signature") -> DataFrame:
    """stored with hit_count raised by how often each key occurs in used."""
    counts = used.groupBy(key).agg(F.count("*").alias("hits__"))
    return stored.join(counts, key, "left").withColumn("hit_count", F.coalesce("hit_count", F.lit(0)) + F.coalesce("hits__", F.lit(0))).select(*stored.columns)


def set_scores(stored: DataFrame, scores: DataFrame, key: str = "record_id", column: str = "anomaly_score") -> DataFrame:
    told = scores.select(key, F.col(column).alias("new__"))
    return stored.join(told, key, "left").withColumn(column, F.coalesce("new__", column)).select(*stored.columns)


def serialised(rows: DataFrame, now: Column | None = None) -> DataFrame:
    """Maps and arrays as JSON, with ingested_at, as a row store keeps them."""
    kinds = dict(rows.dtypes)
    out = [F.to_json(c).alias(c) if kinds[c].startswith(("map", "array")) else F.col(c) for c in rows.columns if c != "ingested_at"]
    return rows.select(*out, (now if now is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).alias("ingested_at"))
