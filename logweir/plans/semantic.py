"""Vendor records to canonical ones: signature, registry, extraction, names, units, validation."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.signature import generate_signature
from ..functions.text import dict_to_line, last_wins
from ..functions.time import free_form, standardise_timestamp
from ..functions.units import normalise_units
from ..schema import CANONICAL, LOG_TYPES, MEASUREMENTS, PARSED_LOGS, SEVERITIES, VENDOR_NAMES
from ..sources.sinks import add_hits, upsert
from ..tables import cut

BATCH = 20
_MAPPED = "signature string, patterns map<string,string>, confidence double, map_flags array<string>"
_NO_STRINGS = "array<string>"


class MappingProvider(Protocol):
    """Makes patterns for lines of new signatures. Runs on executors, so it is pickled; it gets BATCH lines at most."""

    def generate(self, lines: Sequence[str], signatures: Sequence[str]) -> list[dict]:
        """A dict for each line: fields (canonical name to a pattern with one group), confidence, parse_flags."""


class Bypass:
    """Maps nothing."""

    def generate(self, lines: Sequence[str], signatures: Sequence[str]) -> list[dict]:
        return [{"fields": {}, "confidence": 0.0, "parse_flags": ["llm_bypass"]} for _ in lines]


def check_mapping(entry) -> dict:
    """A provider's answer with what can be used: canonical names, patterns that compile and have a group, confidence in [0, 1]; flags tell what was wrong."""
    if not isinstance(entry, dict):
        return {"fields": {}, "confidence": 0.0, "parse_flags": ["llm_response_not_dict"]}
    flags, fields = list(entry.get("parse_flags") or []), {}
    try:
        confidence = min(1.0, max(0.0, float(entry.get("confidence", 0.0))))
    except (TypeError, ValueError):
        confidence = 0.0
        flags.append("invalid_confidence_value")
    given = entry.get("fields", {})
    if not isinstance(given, dict):
        given = {}
        flags.append("fields_not_dict")
    for name, pattern in given.items():
        if name not in CANONICAL:
            flags.append(f"unknown_field:{name}")
        elif not isinstance(pattern, str):
            flags.append(f"non_string_pattern:{name}")
        else:
            try:
                groups = re.compile(pattern).groups
            except re.error:
                flags.append(f"invalid_regex:{name}")
                continue
            if groups != 1:
                flags.append(f"regex_group_count_{groups}:{name}")
            if groups:
                fields[name] = pattern
    if not fields and confidence > 0:
        confidence = 0.0
        flags.append("no_valid_fields")
    return {"fields": fields, "confidence": confidence, "parse_flags": flags}


def apply_mapping(line: str, patterns: dict[str, str]) -> tuple[dict[str, str | None], list[str]]:
    """The first group of each pattern, or all of the match; a flag for each that is empty, broken or not there."""
    values: dict[str, str | None] = {}
    flags = []
    for name, pattern in patterns.items():
        values[name] = None
        if not pattern:
            flags.append(f"empty_pattern:{name}")
            continue
        try:
            found = re.search(pattern, line)
        except re.error:
            flags.append(f"regex_error:{name}")
            continue
        if not found:
            flags.append(f"pattern_miss:{name}")
            continue
        value = found[1] if found.re.groups else found[0]
        values[name] = value.strip() if value else None
    return values, flags


@F.pandas_udf(T.StructType([T.StructField("values", T.MapType(T.StringType(), T.StringType())), T.StructField("flags", T.ArrayType(T.StringType()))]))
def extract(line: pd.Series, patterns: pd.Series) -> pd.DataFrame:
    told = [apply_mapping(x or "", dict(p) if p is not None else {}) for x, p in zip(line, patterns)]
    return pd.DataFrame(told, columns=["values", "flags"])


def from_log_records(records: DataFrame) -> DataFrame:
    """Clean log records as vendor records: their fields with raw_text, timestamp and level."""
    extra = F.array_compact(F.array(F.struct(F.lit("raw_text").alias("key"), F.coalesce("message", F.lit("")).alias("value")), F.when(F.col("timestamp").isNotNull(), F.struct(F.lit("timestamp").alias("key"), F.col("timestamp").alias("value"))), F.when(F.col("level").isNotNull(), F.struct(F.lit("level").alias("key"), F.col("level").alias("value")))))
    entries = F.transform(F.concat(F.map_entries("fields"), extra), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
    return records.where("not corrupted").select("record_id", F.col("source").alias("log_source"), "format", F.map_from_entries(last_wins(entries)).alias("record"))


def failures(records: DataFrame) -> DataFrame:
    """Corrupted log records as rows of parse_failures, with their raw text."""
    return records.where("corrupted").select(F.col("raw").alias("raw_line"), F.col("source").alias("log_source"), F.coalesce(F.nullif("corruption_reason", F.lit("")), F.lit("corrupted")).alias("error"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("failed_at"))


def sign(raw: DataFrame) -> DataFrame:
    """raw (record_id, log_source, format, record) with raw_line and signature."""
    full = lambda k: F.nullif(F.try_element_at("record", F.lit(k)), F.lit(""))
    told = raw.withColumn("raw_line", F.coalesce(full("raw_line"), full("raw_text"), full("_raw_kv_line"), dict_to_line(F.col("record"))))
    return told.withColumn("signature", generate_signature(F.col("raw_line")))


def new_mappings(signed: DataFrame, registry: DataFrame, provider: MappingProvider) -> DataFrame:
    """(signature, patterns, confidence, map_flags) for the signatures that the registry has no patterns for, one line each, in batches on the executors."""
    known = registry.where(F.size("regex_patterns") > 0).select("signature")
    wanted = signed.join(known, "signature", "left_anti").groupBy("signature").agg(F.min("raw_line").alias("line"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for at in range(0, len(frame), BATCH):
                some = frame.iloc[at : at + BATCH]
                told = list(provider.generate(list(some["line"]), list(some["signature"])))
                told = [check_mapping(t) for t in (told + [{}] * len(some))[: len(some)]]
                yield pd.DataFrame({"signature": some["signature"].to_numpy(), "patterns": [t["fields"] for t in told], "confidence": [t["confidence"] for t in told], "map_flags": [t["parse_flags"] for t in told]})

    return wanted.mapInPandas(run, _MAPPED)


def learn(registry: DataFrame, signed: DataFrame, made: DataFrame, now: str) -> DataFrame:
    """The registry after a run: hits of what it knew, and the new patterns that aren't empty."""
    known = registry.where(F.size("regex_patterns") > 0).select("signature")
    hit = add_hits(registry, signed.join(known, "signature", "left_semi"))
    formats = signed.groupBy("signature").agg(F.min("format").alias("format_type"))
    fresh = made.where(F.size("patterns") > 0).join(formats, "signature").select("signature", "format_type", F.col("patterns").alias("regex_patterns"), "confidence", F.lit(0).cast("long").alias("hit_count"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"))
    return upsert(hit, fresh, "signature", keep=("hit_count", "created_at"))


def learn_name(learned: dict[str, str], vendor: str, name: str) -> dict[str, str]:
    """learned with one more vendor name; ValueError if what it stands for isn't canonical."""
    if name not in CANONICAL:
        raise ValueError(f"{name} is no canonical field")
    return {**learned, vendor.lower().strip(): name}


def canonical_name(key: Column, learned: dict[str, str] | None = None) -> Column:
    """The canonical field for a vendor's, or null: canonical names as they are, others by the synonym table, without case."""
    table = {**VENDOR_NAMES, **(learned or {})}  # a vocabulary of the driver's
    names = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.when(key.isin(*CANONICAL), key).otherwise(F.try_element_at(names, F.lower(F.trim(key))))


def infer_log_type(value) -> Column:
    """value: canonical name to Column."""
    full = lambda *names: F.coalesce(*[F.nullif(value(n), F.lit("")) for n in names]).isNotNull()
    there = lambda *names: F.coalesce(*[value(n) for n in names]).isNotNull()
    return F.when(full("alarm_code", "alarm_severity"), "alarm").when(there("temperature", "pressure", "rf_power", "flow_rate"), "sensor").when(full("recipe_name", "process_step"), "process").when(full("event_description", "status"), "event").otherwise("unknown")


def validation_errors(raw_line: Column, log_type: Column, severity: Column, confidence: Column) -> Column:
    return F.array_compact(F.array(
        F.when(raw_line.isNull(), "missing_required:raw_line"), F.when(~log_type.isin(*LOG_TYPES), F.concat(F.lit("invalid_log_type:"), log_type)),
        F.when(~severity.isin(*SEVERITIES), F.concat(F.lit("invalid_alarm_severity:"), severity)), F.when(~confidence.between(0.0, 1.0), F.concat(F.lit("mapping_confidence_out_of_range:"), confidence.cast("string"))),
    ))


def validate(rows: DataFrame) -> DataFrame:
    """rows with ``errors``: columns that aren't canonical, what is required and missing, values outside their lists and ranges, and shapes that don't fit."""
    kinds, there = dict(rows.dtypes), set(rows.columns)
    text = lambda c: F.col(c).cast("string") if c in there else F.lit(None).cast("string")
    given = text("mapping_confidence")
    confidence = given.try_cast("double")
    tests = [F.lit(f"unknown_top_level_field:{c}") for c in rows.columns if c not in CANONICAL]
    tests += [F.when(F.col("extra_fields").isNotNull(), "extra_fields_not_dict")] if not kinds.get("extra_fields", "map").startswith(("map", "struct")) else []
    tests += [F.when(F.col("parse_flags").isNotNull(), "parse_flags_not_list")] if not kinds.get("parse_flags", "array").startswith("array") else []
    tests.append(F.when(given.isNotNull() & confidence.isNull(), F.concat(F.lit("mapping_confidence_not_float:"), given)))
    return rows.withColumn("errors", F.concat(F.array_compact(F.array(*tests)), validation_errors(text("raw_line"), text("log_type"), text("alarm_severity"), confidence)))


def registry_row(registry: DataFrame, signature: str) -> DataFrame:
    """The row of a signature, its patterns as a map: JSON text is decoded, and what isn't JSON is an empty one."""
    row = registry.where(F.col("signature") == signature)
    if dict(registry.dtypes)["regex_patterns"] == "string":
        read = F.when(F.try_parse_json("regex_patterns").isNotNull(), F.from_json("regex_patterns", "map<string,string>"))
        row = row.withColumn("regex_patterns", F.coalesce(read, F.create_map().cast("map<string,string>")))
    return row


def signatures(registry: DataFrame) -> DataFrame:
    return registry.select("signature").distinct()


def dedup_key(tool_id: Column, timestamp: Column, raw_line: Column) -> Column:
    return F.sha2(F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in (tool_id, timestamp, raw_line))), 256)


def read_free_times(rows: DataFrame) -> DataFrame:
    """Rows of parsed_logs, stored ones, with the timestamps that no known shape fits read from free wording; flag and key follow. Only these cross to Python."""
    unread = F.array_contains(F.coalesce("parse_flags", F.array().cast(_NO_STRINGS)), "timestamp_parse_error")
    told = rows.withColumn("free__", free_form(F.when(unread, F.col("timestamp"))))
    free = F.col("free__")
    changed = {"timestamp": F.coalesce(free, "timestamp"), "parse_flags": F.when(free.isNull(), F.col("parse_flags")).otherwise(F.array_remove("parse_flags", "timestamp_parse_error")), "dedup_key": F.when(free.isNull(), F.col("dedup_key")).otherwise(dedup_key(F.col("tool_id"), free, F.col("raw_line")))}
    return told.select(*[changed.get(c, F.col(c)).alias(c) for c in rows.columns])


def canonicalise(mapped: DataFrame, learned: dict[str, str] | None = None) -> DataFrame:
    """record_id, log_source, raw_line, record, values, flags and confidence to rows of parsed_logs: names, type, units, timestamp, flags and dedup_key."""
    shown = F.filter(F.map_entries("record"), lambda e: ~e["key"].startswith("_"))
    named = F.transform(shown, lambda e: F.struct(canonical_name(e["key"], learned).alias("k"), e["key"].alias("vendor"), e["value"].alias("v")))
    told = mapped.withColumn("named", named)
    from_record = F.transform(F.filter("named", lambda e: e["k"].isNotNull()), lambda e: F.struct(e["k"].alias("k"), e["v"].alias("v")))
    found = F.transform(F.filter(F.map_entries(F.coalesce("values", F.create_map().cast("map<string,string>"))), lambda e: e["value"].isNotNull()), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
    told = told.withColumn("t", F.map_from_entries(last_wins(F.concat(from_record, found))))
    told = told.withColumn("extra_fields", F.map_from_entries(last_wins(F.transform(F.filter("named", lambda e: e["k"].isNull()), lambda e: F.struct(e["vendor"].alias("k"), e["v"].alias("v"))))))
    value = lambda name: F.try_element_at("t", F.lit(name))
    raw_line = F.coalesce(value("raw_line"), F.col("raw_line"))
    values, unit_flags = normalise_units({f: value(f) for f in MEASUREMENTS})
    timestamp, readable = standardise_timestamp(value("timestamp"))
    told = told.select("*", *[v.alias(f) for f, v in values.items()], unit_flags.alias("unit_flags"), timestamp.alias("timestamp"), readable.alias("readable"), infer_log_type(value).alias("log_type"), raw_line.alias("line__"))
    errors = F.transform(validation_errors(F.col("line__"), F.col("log_type"), value("alarm_severity"), F.col("confidence")), lambda e: F.concat(F.lit("schema_error:"), e))
    one = lambda test, flag: F.when(test, F.array(F.lit(flag))).otherwise(F.array().cast(_NO_STRINGS))
    cleaned = F.concat(one(~F.col("readable"), "timestamp_parse_error"), one(F.coalesce("line__", F.lit("")) == "", "missing_required:raw_line"))
    key = dedup_key(value("tool_id"), F.col("timestamp"), F.col("line__"))
    own = {
        "record_id": F.coalesce(value("record_id"), F.col("record_id")), "log_source": F.coalesce(value("log_source"), F.col("log_source")), "raw_line": F.col("line__"), "mapping_confidence": F.col("confidence"),
        "parse_flags": F.concat(F.coalesce("flags", F.array().cast(_NO_STRINGS)), "unit_flags", cleaned, errors), "anomaly_score": F.lit(None).cast("double"), "dedup_key": key,
        "ingested_at": F.lit(None).cast("string"), **{c: F.col(c) for c in ("timestamp", "log_type", "extra_fields", *MEASUREMENTS)},
    }
    return told.select(*[own.get(c, value(c)).alias(c) for c in (x.split()[0] for x in PARSED_LOGS.split(", "))])


def map_records(raw: DataFrame, registry: DataFrame, provider: MappingProvider | None = None, learned: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Canonical rows of raw, with the signed records and the new mappings behind them. The provider is asked once for each new signature: its answers are written, and rows and registry read them from there."""
    signed = sign(raw)
    made = cut(new_mappings(signed, registry, provider or Bypass()))
    known = registry.where(F.size("regex_patterns") > 0).select("signature", F.col("regex_patterns").alias("patterns"), "confidence", F.array().cast(_NO_STRINGS).alias("map_flags"))
    joined = signed.join(known.unionByName(made), "signature", "left")
    told = joined.withColumn("x", extract("raw_line", "patterns"))
    mapped = told.select("record_id", "log_source", "raw_line", "record", F.col("x.values").alias("values"), F.concat("x.flags", F.coalesce("map_flags", F.array().cast(_NO_STRINGS))).alias("flags"), "confidence")
    return canonicalise(mapped, learned), signed, made
