"""Parsed entries to canonical log records: which entry is the timestamp, the level, the message; what stays a field."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.level import LEVELS, SYSLOG, extract_level, level_name
from ..functions.numeric import coerce_value, remove_units, try_numeric
from ..functions.text import clean_text, normalize_whitespace, strip
from ..functions.time import extract_timestamp, need_utc, parse_timestamp, to_iso8601

# Key names by role, in order of priority.
TIME = ("timestamp", "time", "datetime", "date", "ts", "@timestamp", "log_time")
TIME_JSON = (*TIME, "created_at", "logged_at", "event_time", "occurredAt")
TIME_SHORT = ("timestamp", "time", "datetime", "date", "ts", "log_time")
TIME_COLUMN = ("timestamp", "time", "date", "datetime", "ts", "col_0")
LEVEL = ("level", "severity", "loglevel", "log_level", "lvl", "priority")
LEVEL_JSON = (*LEVEL, "log.level", "@level")
LEVEL_SHORT = ("level", "severity", "priority", "loglevel")
LEVEL_COLUMN = ("level", "severity", "loglevel", "col_1")
MESSAGE = ("message", "msg", "text", "event", "description", "log", "detail")
MESSAGE_JSON = (*MESSAGE, "error", "exception", "reason", "@message")
MESSAGE_SHORT = ("message", "msg", "text", "event", "description", "detail")
MESSAGE_COLUMN = ("message", "msg", "text", "event", "description")
STACK = ("stack_trace", "stacktrace", "stack", "exception", "traceback")


@dataclass(frozen=True)
class Roles:
    """Where a format keeps what. time_scan and level_scan also look at all values; known_levels wants a level word; given keeps the first key's text even if it is no time."""

    time: tuple[str, ...]
    level: tuple[str, ...]
    message: tuple[str, ...]
    given: bool = False
    time_scan: bool = False
    level_scan: bool = False
    known_levels: bool = True
    level_in_message: bool = False
    by_value: bool = False
    keep_empty: bool = False
    coerce_twice: bool = True


ROLES = {
    "key_value": Roles(TIME, LEVEL, MESSAGE, given=True, known_levels=False, keep_empty=True),
    "logfmt": Roles(TIME, LEVEL, MESSAGE, given=True, known_levels=False, keep_empty=True),
    "delimiter": Roles(TIME_COLUMN, LEVEL_COLUMN, MESSAGE_COLUMN, time_scan=True, level_scan=True, by_value=True, keep_empty=True),
    "csv": Roles(TIME, LEVEL, MESSAGE, time_scan=True),
    "tsv": Roles(TIME, LEVEL, MESSAGE, time_scan=True, level_scan=True),
    "json": Roles(TIME_JSON, LEVEL_JSON, MESSAGE_JSON, keep_empty=True),
    "xml": Roles(TIME_SHORT, LEVEL_SHORT, MESSAGE_SHORT, known_levels=False, level_in_message=True, keep_empty=True, coerce_twice=False),
    "yaml": Roles(TIME_SHORT, LEVEL_SHORT, MESSAGE_SHORT, known_levels=False, level_in_message=True, keep_empty=True, coerce_twice=False),
}
#: Of line formats, corrupted lines get a timestamp and level from their raw text too.
LINE_FORMATS = ("plain_text", "key_value", "logfmt", "delimiter", "tsv", "syslog")


def _coerced(entries: Column, twice: bool) -> Column:
    def one(e: Column) -> Column:
        v = coerce_value(try_numeric(remove_units(e["v"]))) if twice else coerce_value(e["v"])
        return F.struct(e["k"].alias("k"), F.when(e["text"], v).otherwise(e["v"]).alias("v"))

    return F.map_from_entries(F.transform(entries, one))


def assign_roles(parsed: DataFrame, roles: Roles, reference_year: int | None = None) -> DataFrame:
    """parsed with timestamp_raw, ts, level, message and fields, of the records that aren't corrupted."""
    table = F.map_from_entries(F.transform("entries", lambda e: F.struct(e["k"].alias("k"), e["v"].alias("v"))))
    told = parsed.withColumn("table", table)
    of = lambda keys: F.filter(F.array(*[F.try_element_at("table", F.lit(k)) for k in keys]), lambda v: v.isNotNull())
    cells = F.transform("entries", lambda e: strip(e["v"]))
    full = lambda a: F.filter(a, lambda v: v != "")

    timed = F.transform(full(F.concat(of(roles.time), cells) if roles.time_scan else of(roles.time)), lambda v: F.struct(v.alias("raw"), parse_timestamp(v, reference_year).alias("ts")))
    if roles.given:
        first = F.get(of(roles.time), F.lit(0))
        time = F.struct(first.alias("raw"), parse_timestamp(first, reference_year).alias("ts"))
    else:
        time = F.get(F.filter(timed, lambda x: x["ts"].isNotNull()), F.lit(0))

    named = F.transform(of(roles.level), lambda v: F.upper(strip(v)))
    if roles is ROLES["json"]:
        digit = F.array(*map(F.lit, SYSLOG))
        named = F.transform(F.filter(named, lambda v: v.isin(*LEVELS) | v.rlike("^[0-7]$")), lambda v: F.when(v.rlike("^[0-7]$"), F.get(digit, v.try_cast("int"))).otherwise(v))
    elif roles.known_levels:
        named = F.filter(F.concat(named, F.transform(cells, F.upper)) if roles.level_scan else named, lambda v: v.isin(*LEVELS))
    elif roles.level_in_message:
        named = full(named)
    level = level_name(F.get(named, F.lit(0)))

    candidates = of(roles.message) if roles.given or roles.by_value else full(of(roles.message))
    message = F.get(F.transform(candidates, normalize_whitespace if roles.given or roles.by_value else lambda v: normalize_whitespace(clean_text(v))), F.lit(0))
    fallback = normalize_whitespace(clean_text(F.col("fallback")))
    message = F.coalesce(F.when(message != "", message), fallback, F.lit(""))
    told = told.withColumn("time", time).withColumn("message", message).withColumn("level", level)
    if roles.level_in_message:
        told = told.withColumn("level", F.coalesce("level", extract_level(F.col("message"))))

    if roles.by_value:
        taken = F.array_compact(F.array("time.raw", "level", "message"))
        kept = F.filter("entries", lambda e: ~F.coalesce(F.array_contains(taken, e["v"]), F.lit(False)))
    else:
        reserved = {*roles.time, *roles.level, *roles.message, *(STACK if roles is ROLES["json"] else ())}
        kept = F.filter("entries", lambda e: ~e["k"].isin(*sorted(reserved)) & (F.lit(roles.keep_empty) | (e["v"] != "")))
    if roles is ROLES["json"]:
        stack = F.get(F.filter(F.array(*[F.try_element_at("table", F.lit(k)) for k in STACK]), lambda v: v.isNotNull() & (v != "")), F.lit(0))
        kept = F.when(stack.isNotNull(), F.concat(kept, F.array(F.struct(F.lit("stack_trace").alias("k"), stack.alias("v"), F.lit(True).alias("text"))))).otherwise(kept)
    told = told.withColumn("kept", kept)
    own = [F.col(c) for c in ("source", "format", "line_number", "raw", "corrupted", "corruption_reason")]
    return settled(told, *own, F.col("time.raw").alias("timestamp_raw"), F.col("time.ts").alias("ts"), F.col("level"), F.col("message"), _coerced(F.col("kept"), roles.coerce_twice).alias("fields"))


def settled(df: DataFrame, *columns: Column) -> DataFrame:
    """df's columns, each computed once: a filter on them stays above instead of repeating their expressions below."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def finish(records: DataFrame, normalise: bool, reference_year: int | None = None) -> DataFrame:
    """Log records: with normalise, what is missing is looked for in the message or else the raw text; record_id is 16 hex digits of source, line and raw."""
    where = F.when(F.col("message") != "", F.col("message")).otherwise(F.col("raw"))
    wanted = F.lit(normalise) & (~F.col("corrupted") | F.col("format").isin(*LINE_FORMATS))
    told = records.withColumn("token", F.when(wanted & F.col("ts").isNull(), extract_timestamp(where))).withColumn("found", parse_timestamp(F.col("token"), reference_year))
    level = F.when(wanted & F.col("level").isNull(), extract_level(where)).otherwise(F.col("level"))
    return settled(
        told,
        F.substring(F.sha1(F.concat_ws(":", "source", F.col("line_number").cast("string"), "raw")), 1, 16).alias("record_id"), F.col("source"), F.col("line_number"), F.col("format"),
        to_iso8601(F.coalesce("ts", "found")).alias("timestamp"), F.when(F.col("found").isNotNull(), F.col("token")).otherwise(F.col("timestamp_raw")).alias("timestamp_raw"),
        level.alias("level"), (clean_text(F.col("message")) if normalise else F.col("message")).alias("message"), F.col("fields"), F.col("corrupted"), F.col("corruption_reason"), F.col("raw"),
    )


def assemble(parsed: DataFrame, fmt: str, reference_year: int | None = None) -> DataFrame:
    """What a parser of one format made, as log records."""
    need_utc(parsed.sparkSession)
    roles = ROLES.get(fmt) or (None if "timestamp_raw" in parsed.columns else ROLES["key_value"])  # a caller's parser may leave the roles to the names
    if roles:
        told = assign_roles(parsed, roles, reference_year)
        blank = F.col("corrupted")
        told = told.select("source", "format", "line_number", "raw", "corrupted", "corruption_reason", *[F.when(~blank, F.col(c)).alias(c) for c in ("timestamp_raw", "ts", "level")], F.when(blank, "").otherwise(F.col("message")).alias("message"), "fields")
        return finish(told, True, reference_year)
    told = parsed.withColumn("ts", parse_timestamp(F.col("timestamp_raw"), reference_year)).withColumn("message", F.coalesce("message", F.lit(""))).withColumn("fields", _coerced(F.col("entries"), False))
    if fmt == "binary":
        told = told.withColumn("fields", F.map_from_entries(F.transform("entries", lambda e: F.struct(e["k"].alias("k"), e["v"].alias("v")))))
    return finish(told, fmt != "binary", reference_year)
