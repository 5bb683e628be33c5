"""Analytics over any table: charts, profiles, search, registry health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from ..functions.numeric import parse_numeric

AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
# The signals whose coverage is told, and the sizes of lists.
SIGNALS = ("timestamp", "tool_id", "alarm_code", "event_code", "lot_id", "recipe", "chamber", "wafer_id")
FORMATS_SHOWN, SIGNALS_SHOWN, ROWS_SHOWN, BLOB_SHOWN = 8, 12, 8, 96


def _known(df: DataFrame, column: str) -> str:
    if column not in df.columns:
        raise ValueError(f"no column {column}")
    return column


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def list_tables(spark: SparkSession) -> list[tuple[str, int]]:
    """The session's tables and views with their numbers of rows."""
    return [(t.name, spark.table(t.name).count()) for t in sorted(spark.catalog.listTables(), key=lambda t: t.name)]


def register(spark: SparkSession, name: str, df: DataFrame) -> None:
    """A view under a name of letters, digits and _; others are replaced by _."""
    df.createOrReplaceTempView("".join(c if c.isalnum() else "_" for c in name))


def unregister(spark: SparkSession, name: str) -> bool:
    return spark.catalog.dropTempView(name)


def with_share(charted: DataFrame) -> DataFrame:
    """(label, value) with each value's percentage of all, for a chart's few rows."""
    total = F.sum("value").over(W.partitionBy(F.lit(0)))
    return charted.withColumn("share_pct", F.when(total != 0, F.round(100 * F.col("value") / total, 1)).otherwise(0.0))


def describe(df: DataFrame) -> list[dict]:
    return [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable, "numeric": isinstance(f.dataType, T.NumericType)} for f in df.schema]


def health(view: DataFrame) -> dict[str, DataFrame]:
    """All that a registry page shows, by name."""
    return {"totals": registry_totals(view), "formats": registry_formats(view), "signals": registry_signals(view), "coverage": registry_coverage(view), "recent": recent_activity(view), "watchlist": watchlist(view)}


def chart(df: DataFrame, dimension: str, aggregation: str = "count", metric: str | None = None, limit: int = 25) -> DataFrame:
    """(label, value) of the groups with the greatest values, ties by label; limit is held between 1 and 100, and a missing metric counts rows."""
    if aggregation not in AGGREGATES:
        raise ValueError(f"no aggregation {aggregation}")
    label = F.col(_known(df, dimension))
    value = F.count("*") if aggregation == "count" or metric is None else AGGREGATES[aggregation](_known(df, metric))
    return df.groupBy(label.alias("label")).agg(value.alias("value")).orderBy(F.col("value").desc_nulls_last(), F.col("label").asc_nulls_first()).limit(min(100, max(1, limit)))


def profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """A row for each column: rows, non-null, null, distinct, least and greatest value as text, share filled and distinct, in one pass over the table.

    Exact distinct counts expand each row once a column; exact=False sketches them.
    """
    columns = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    distinct = F.count_distinct if exact else F.approx_count_distinct
    facts = []
    for i, c in enumerate(columns):
        q = F.col(f"`{c}`")
        facts += [F.count(q).alias(f"n{i}"), distinct(q).alias(f"d{i}"), F.min(q).cast("string").alias(f"a{i}"), F.max(q).cast("string").alias(f"b{i}")]
    one = df.agg(F.count("*").alias("rows"), *facts)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("non_null"), F.col(f"d{i}").alias("distinct"), F.col(f"a{i}").alias("min"), F.col(f"b{i}").alias("max")) for i, c in enumerate(columns)])
    told = one.select("rows", F.explode(rows).alias("p")).select("p.column", "rows", "p.non_null", (F.col("rows") - F.col("p.non_null")).alias("nulls"), "p.distinct", "p.min", "p.max")
    share = lambda n, of: F.when(F.col(of) > 0, F.round(100 * F.col(n) / F.col(of), 1)).otherwise(0.0)
    return told.withColumn("fill_pct", share("non_null", "rows")).withColumn("distinct_pct", share("distinct", "non_null"))


def search(df: DataFrame, term: str, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """Rows with a column whose text is like %term%, without case; % and _ in the term match anything. The first limit (1 to 1000) rows, and all."""
    plain = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType, T.BinaryType, T.VariantType))]
    found = df.where(reduce(Column.__or__, [F.col(f"`{c}`").cast("string").ilike(f"%{term}%") for c in plain])) if term else df
    return found.limit(min(1000, max(1, limit))), found


def blob_preview(df: DataFrame) -> DataFrame:
    """Binary columns as 0x and their first hex digits."""
    hexed = lambda c: F.lower(F.hex(c))
    shown = lambda c: F.concat(F.lit("0x"), F.substring(hexed(c), 1, BLOB_SHOWN), F.when(F.length(hexed(c)) > BLOB_SHOWN, "...").otherwise(""))
    return df.select(*[shown(f.name).alias(f.name) if isinstance(f.dataType, T.BinaryType) else F.col(f"`{f.name}`") for f in df.schema])


def _pick(df: DataFrame, exact: str, *parts: str, numeric: bool = False) -> Column:
    """The column of that name, else the first whose name holds one of the parts, else null."""
    names = numeric_columns(df) if numeric else df.columns
    found = exact if exact in df.columns else next((c for c in names if any(p in c.lower() for p in parts)), None)
    return F.col(f"`{found}`") if found else F.lit(None).cast("string")


def registry_view(df: DataFrame) -> DataFrame:
    """signature, format, confidence, hits, pattern fields and the time of change, under whatever names a registry-like table has them."""
    keys = lambda c: F.coalesce(F.json_object_keys(c), F.array().cast("array<string>"))
    patterns = _pick(df, "regex_patterns", "pattern", "regex")
    if "regex_patterns" in df.columns and isinstance(df.schema["regex_patterns"].dataType, T.MapType):
        fields = F.coalesce(F.map_keys("regex_patterns"), F.array().cast("array<string>"))
    else:
        fields = keys(patterns.cast("string"))
    text = lambda c: F.nullif(F.trim(c.cast("string")), F.lit(""))
    updated, created = _pick(df, "updated_at", "updated", "modified"), _pick(df, "created_at", "created")
    return df.select(
        F.coalesce(text(_pick(df, "signature", "signature")), F.lit("unknown")).alias("signature"), F.coalesce(text(_pick(df, "format_type", "format", "type")), F.lit("unknown")).alias("format"),
        parse_numeric(_pick(df, "confidence", "confidence", numeric=True)).alias("confidence"), F.floor(F.coalesce(parse_numeric(_pick(df, "hit_count", "hit", "count", numeric=True)), F.lit(0.0))).alias("hit_count"),
        fields.alias("pattern_fields"), F.coalesce(text(updated), text(created)).alias("updated_at"),
    )


def registry_totals(view: DataFrame) -> DataFrame:
    """One row: rows, avg_confidence, total_hits and the bands from 0.9, from 0.75 and below."""
    c = F.col("confidence")
    return view.agg(F.count("*").alias("row_count"), F.avg("confidence").alias("avg_confidence"), F.sum("hit_count").alias("total_hits"), F.count_if(c >= 0.9).alias("high"), F.count_if((c >= 0.75) & (c < 0.9)).alias("medium"), F.count_if(c < 0.75).alias("low"))


def registry_formats(view: DataFrame) -> DataFrame:
    return view.groupBy(F.col("format").alias("label")).agg(F.count("*").alias("count")).orderBy(F.col("count").desc(), "label").limit(FORMATS_SHOWN)


def registry_signals(view: DataFrame) -> DataFrame:
    return view.select(F.explode("pattern_fields").alias("signal")).groupBy("signal").agg(F.count("*").alias("count")).orderBy(F.col("count").desc(), "signal").limit(SIGNALS_SHOWN)


def registry_coverage(view: DataFrame) -> DataFrame:
    """For each tracked signal, how many rows have it and what share of all."""
    told = view.agg(F.count("*").alias("rows"), *[F.count_if(F.array_contains("pattern_fields", s)).alias(s) for s in SIGNALS])
    pct = lambda s: F.when(F.col("rows") > 0, F.round(100 * F.col(s) / F.col("rows"), 1)).otherwise(0.0)
    return told.select(F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).alias("count"), pct(s).alias("coverage_pct")) for s in SIGNALS])).alias("x")).select("x.*")


def recent_activity(view: DataFrame) -> DataFrame:
    return view.where("updated_at is not null").orderBy(F.col("updated_at").desc(), "signature").limit(ROWS_SHOWN).drop("pattern_fields")


def watchlist(view: DataFrame) -> DataFrame:
    """The rows that want attention, with up to two reasons; least confident first, then most hit."""
    c, hits = F.col("confidence"), F.col("hit_count")
    reasons = F.array_compact(F.array(F.when(c < 0.75, "low-confidence mapping"), F.when((hits >= 10) & (c < 0.9), "high-volume signature needs tuning"), F.when(F.size("pattern_fields") <= 1, "thin field extraction")))
    told = view.withColumn("reasons", reasons).where(F.size("reasons") > 0)
    told = told.orderBy(F.coalesce(c, F.lit(1.0)), hits.desc(), "signature").limit(ROWS_SHOWN)
    return told.select("signature", "format", "confidence", "hit_count", F.array_join(F.slice("reasons", 1, 2), ", ").alias("reason"))


# The listings by which the stored tables are read: table, condition, columns and order.
LISTINGS = {
    "anomalies": ("parsed_logs", "anomaly_score < -0.5", "timestamp, tool_id, temperature, pressure, rf_power, anomaly_score", "anomaly_score asc"),
    "alarms": ("parsed_logs", "alarm_code is not null", "timestamp, tool_id, alarm_code, alarm_severity, event_description", "timestamp desc"),
    "low_confidence": ("parsed_logs", "mapping_confidence < 0.7", "tool_id, raw_line, mapping_confidence, parse_flags", "mapping_confidence asc"),
    "parse_failures": ("parse_failures", "true", "*", "failed_at desc"),
    "learned_names": ("field_mappings", "true", "*", "created_at desc"),
    "provider_failures": ("llm_failures", "true", "signature, raw_line, error, attempts", "signature asc"),
    "mappings": ("registry", "true", "signature, format_type, confidence, hit_count", "hit_count desc"),
}


def listing(table: DataFrame, name: str) -> DataFrame:
    """A listing over its table; ties follow the first column."""
    _, condition, columns, order = LISTINGS[name]
    key, way = order.split()
    told = table.where(condition)
    first = F.col((table.columns if columns == "*" else columns.split(", "))[0])
    ordered = told.orderBy(F.col(key).desc_nulls_last() if way == "desc" else F.col(key).asc_nulls_last(), first)
    return ordered.select(*(table.columns if columns == "*" else columns.split(", ")))
