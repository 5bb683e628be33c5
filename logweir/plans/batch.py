"""A batch of files or staged records through all layers into stored tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import similar
from ..operators.anomaly import Forest, fit_forest, score_records
from ..operators.staging import stage
from ..functions.signature import generate_signature
from ..operators.templates import as_table, build_position_map, discover_templates, match_templates
from ..schema import CANONICAL, FIELD_MAPPINGS, LLM_FAILURES, PARSE_FAILURES, PARSED_LOGS, REGISTRY, TEMPLATES
from ..sources.readers import ingest, read_files
from ..sources.sinks import add_hits, append_batch, batch_label, drop_table, insert_or_ignore, is_done, new_rows, read_batches, read_ndjson, read_table, replace_table, update_buckets, upsert
from ..tables import cut
from .semantic import MappingProvider, failures, from_log_records, learn, map_records, read_free_times


#: A batch's writer and number; None is one that never runs again.
Batch = tuple[str, int] | None
#: Tables that only grow, by batches.
BATCHED = ("parsed_logs", "parse_failures", "llm_failures")


@dataclass
class Result:
    total: int = 0
    inserted: int = 0
    skipped: int = 0
    failed: int = 0
    cache_hits: int = 0
    provider_batches: int = 0


class Store:
    """The tables of one installation, as folders of Parquet under a shared path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def table(self, name: str, schema: str) -> DataFrame:
        return (read_batches if name in BATCHED else read_table)(self.spark, self.at(name), schema)

    def update(self, name: str, schema: str, keys: DataFrame, change: Callable[[DataFrame], DataFrame], batch: Batch = None, key: str = "signature") -> bool:
        """Changes the buckets of a keyed table that keys fall in; not if the table holds the batch already."""
        return update_buckets(self.spark, self.at(name), schema, key, keys, change, batch)

    def append(self, name: str, rows: DataFrame, label: str) -> None:
        append_batch(rows, self.at(name), label)

    def model(self) -> Forest | None:
        row = self.table("anomaly_model", "model string").first()
        return Forest.from_json(row.model) if row else None

    def learned(self) -> dict[str, str]:
        """The learnt vendor names, a vocabulary small enough for the driver."""
        return {r.vendor_field: r.canonical_field for r in self.table("field_mappings", FIELD_MAPPINGS).collect()}

    def learn_names(self, names: dict[str, str]) -> None:
        """Stores vendor names, in place of what they stood for, and mirrors all of them as JSON. ValueError if one stands for no canonical field."""
        wrong = sorted(set(names.values()) - set(CANONICAL))
        if wrong:
            raise ValueError(f"no canonical field: {', '.join(wrong)}")
        now = _now()
        fresh = self.spark.createDataFrame([(v.lower().strip(), c, now) for v, c in names.items()], FIELD_MAPPINGS)
        replace_table(upsert(self.table("field_mappings", FIELD_MAPPINGS), fresh, "vendor_field"), self.at("field_mappings"))
        self.table("field_mappings", FIELD_MAPPINGS).coalesce(1).write.mode("overwrite").json(self.at("field_mappings_json"))

    def load_names(self, path: str) -> int:
        """Adds the names of a JSON file (one object, or one a line) that stand for canonical fields; learnt ones stay. How many were new."""
        given = self.spark.read.option("multiLine", "true").schema("mappings map<string,string>").json(path).select(F.explode("mappings").alias("v", "c"))
        had = self.learned()
        new = {r.v: r.c for r in given.collect() if r.c in CANONICAL and r.v.lower().strip() not in had}
        if new:
            self.learn_names(new)
        return len(new)

    def build_pool(self, lines: DataFrame) -> int:
        """The candidate pool: the representatives of clusters of past lines (id, line), with their labels."""
        replace_table(similar.representatives(lines, similar.cluster(lines)), self.at("candidates"))
        return self.pool().count()

    def pool(self) -> DataFrame:
        return self.table("candidates", "id long, line string, label int")

    def alike(self, queries: DataFrame, k: int = 3) -> DataFrame:
        """The k lines of the pool nearest to each query (id, line)."""
        pool = self.pool()
        return similar.nearest(queries, pool, similar.fit(pool)[0], k).join(pool.select(F.col("id").alias("candidate"), F.col("line").alias("example")), "candidate")

    def match(self, lines: DataFrame) -> DataFrame:
        """The stored template of each line (id, line); each match is counted."""
        matched = cut(match_templates(lines, self.table("templates", TEMPLATES)))
        self.update("templates", TEMPLATES, matched, lambda stored: add_hits(stored, matched))
        return matched

    def insert_template(self, template: str, names: list[str], source: str = "manual") -> str:
        """Stores a template with the names of its <*>, in place of what stood at its leaf; its hits stay. Its signature; ValueError unless there is a name for each <*>."""
        row = [(template, build_position_map(template, names), source, 0, _now())]
        fresh = cut(self.spark.createDataFrame(row, "template string, position_map map<int,string>, source string, hit_count long, created_at string").withColumn("signature", generate_signature(F.col("template"))))
        self.update("templates", TEMPLATES, fresh, lambda stored: upsert(stored, fresh, "signature", keep=("hit_count", "created_at")))
        return fresh.first().signature

    def reset(self, *names: str) -> list[str]:
        """Drops tables; which of them were there."""
        return [n for n in names if drop_table(self.spark, self.at(n))]


def _now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


def unmapped(signed: DataFrame, made: DataFrame, attempts: int, now: str) -> DataFrame:
    """Rows of llm_failures: each signature for which the provider failed for good, with its first line."""
    failed = made.select("signature", F.get(F.filter("map_flags", lambda f: f.isin("llm_failed", "llm_quota_exceeded")), F.lit(0)).alias("error")).where("error is not null")
    first = signed.groupBy("signature").agg(F.min_by(F.struct("raw_line", "log_source"), "record_id").alias("x"))
    return failed.join(first, "signature").select("signature", "x.raw_line", "x.log_source", "error", F.lit(attempts).alias("attempts"), F.lit(now).alias("failed_at"))


def run_records(store: Store, raw: DataFrame, provider: MappingProvider | None = None, learned: dict[str, str] | None = None, may_fit: bool = True, batch: Batch = None) -> Result:
    """Vendor records (record_id, log_source, format, record) into parsed_logs; the registry learns, and with may_fit a first anomaly model is fitted.

    batch names a batch by its writer and a rising number. The registry is written
    last and holds the batch from then on: a batch that runs again adds nothing,
    and one that broke off before overwrites what it had written.
    """
    if is_done(store.spark, store.at("registry"), batch):
        return Result()
    label = batch_label(batch)
    registry = store.table("registry", REGISTRY)
    rows, signed, made = map_records(raw, registry, provider, {**store.learned(), **(learned or {})})
    now = _now()
    rows = cut(rows.withColumn("ingested_at", F.lit(now)))
    rows = cut(read_free_times(rows))
    signed = cut(signed)
    forest = store.model()
    if forest is None and may_fit:
        forest = fit_forest(rows)
        if forest is not None:
            replace_table(store.spark.createDataFrame([(forest.to_json(),)], "model string"), store.at("anomaly_model"))
    scored = score_records(rows, forest) if forest is not None else rows
    total = rows.count()
    added, skipped = insert_or_ignore(scored, store.at("parsed_logs"), PARSED_LOGS, "dedup_key", ["record_id"], label)
    misses = signed.join(made.select("signature"), "signature", "left_semi").count()
    store.append("llm_failures", unmapped(signed, made, getattr(provider, "attempts", 1), now), label)
    store.update("registry", REGISTRY, signed, lambda stored: learn(stored, signed, made, now), batch)
    return Result(total=total, inserted=added, skipped=skipped, cache_hits=total - misses, provider_batches=-(-made.count() // 20))


def run_files(store: Store, files: DataFrame, provider: MappingProvider | None = None, format_override: str | None = None, reference_year: int | None = None, batch: Batch = None) -> Result:
    """Files (source, content) through parsing, dedup and run_records; corrupted records go to parse_failures."""
    records = cut(stage([ingest(files, format_override, reference_year)]))
    store.append("parse_failures", failures(records), batch_label(batch))
    result = run_records(store, from_log_records(records), provider, batch=batch)
    result.failed = records.where("corrupted").count()
    return result


def run_path(store: Store, path: str, provider: MappingProvider | None = None, pattern: str | None = None) -> Result:
    return run_files(store, read_files(store.spark, path, pattern), provider)


def run_staged(store: Store, path: str, provider: MappingProvider | None = None) -> Result:
    """Staged NDJSON of log records through run_records; lines that don't parse go to parse_failures."""
    staged = cut(read_ndjson(store.spark, path, "record_id string, source string, line_number int, format string, timestamp string, level string, message string, fields map<string,string>, corrupted boolean, corruption_reason string"))
    bad = staged.where("bad_line is not null").select(F.col("bad_line").alias("raw_line"), F.lit("staging").alias("log_source"), F.lit("invalid_json").alias("error"), F.lit(_now()).alias("failed_at"))
    store.append("parse_failures", bad, batch_label(None))
    good = staged.where("bad_line is null").withColumn("corrupted", F.coalesce("corrupted", F.lit(False))).withColumn("fields", F.coalesce("fields", F.create_map().cast("map<string,string>")))
    result = run_records(store, from_log_records(good), provider)
    result.failed = bad.count()
    return result


def learn_templates(store: Store, lines: DataFrame) -> int:
    """Templates of past lines (line, at) into the template table; how many are new."""
    fresh = cut(new_rows(as_table(discover_templates(lines)), store.table("templates", TEMPLATES), "signature", ["template"]))
    store.update("templates", TEMPLATES, fresh, lambda stored: stored.unionByName(fresh))
    return fresh.count()


def stored_failures(store: Store) -> DataFrame:
    return store.table("parse_failures", PARSE_FAILURES)
