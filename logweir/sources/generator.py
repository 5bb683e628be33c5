"""A deterministic table of tool logs in all formats, from spark.range: for round trips and benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schema import FORMATS

TOOLS, CHAMBERS, RECIPES, HOSTS = ("ETCH01", "ETCH02", "CVD01", "PVD03"), ("CH1", "CH2", "CH3"), ("OXIDE_A", "METAL_B", "POLY_C"), ("fab-a", "fab-b")
ALARMS, SEVERITIES = ("E101", "E334", "W210", "A777"), ("INFO", "NOTICE", "WARN", "ERROR", "CRITICAL")
START, STEP = 1776816000, 19


def _draw(seed: int, name: str) -> Column:
    """In [0, 1), by row and name."""
    return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(name)), F.lit(1_000_003)) / 1_000_003


def _one(seed: int, name: str, values: tuple[str, ...]) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.floor(_draw(seed, name) * len(values)).cast("int"))


def tool_logs(spark: SparkSession, rows: int = 5000, seed: int = 334455) -> DataFrame:
    """sequence_no, the facts, format_type (all in turn), raw_log and raw_payload (of binary rows)."""
    near = lambda name, low, high, places: F.round(low + _draw(seed, name) * (high - low), places)
    ts = F.date_format(F.timestamp_seconds(F.lit(START) + F.col("id") * STEP + F.floor(_draw(seed, "ts") * 12)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    facts = spark.range(rows).select(
        "id", (F.col("id") + 1).alias("sequence_no"), ts.alias("event_ts"), _one(seed, "tool", TOOLS).alias("tool_id"), _one(seed, "chamber", CHAMBERS).alias("chamber_id"),
        F.format_string("LOT%d", (F.lit(1200) + F.floor(_draw(seed, "lot") * 700)).cast("int")).alias("lot_id"), F.format_string("W%02d", (F.lit(1) + F.floor(_draw(seed, "wafer") * 25)).cast("int")).alias("wafer_id"),
        _one(seed, "recipe", RECIPES).alias("recipe"), _one(seed, "alarm", ALARMS).alias("alarm_code"), _one(seed, "severity", SEVERITIES).alias("severity"), near("temp", 48.0, 92.0, 1).alias("temperature_c"),
        near("pressure", 4.0, 42.0, 2).alias("pressure_mtorr"), near("power", 180.0, 980.0, 1).alias("rf_power_w"), _one(seed, "host", HOSTS).alias("host"), F.format_string("SIG%05d", F.col("id").cast("int")).alias("signature"),
        F.get(F.array(*map(F.lit, FORMATS)), (F.col("id") % len(FORMATS)).cast("int")).alias("format_type"),
    )
    named = {"timestamp": "event_ts", "tool": "tool_id", "chamber": "chamber_id", "lot": "lot_id", "wafer": "wafer_id", "recipe": "recipe", "alarm": "alarm_code", "severity": "severity", "temp_c": "temperature_c", "pressure_mtorr": "pressure_mtorr", "rf_power_w": "rf_power_w", "host": "host"}
    text = {k: F.col(c).cast("string") for k, c in named.items()}
    listed = lambda form, by: F.concat_ws(by, *[F.concat(F.lit(form[0] + k + form[1]), v, F.lit(form[2])) for k, v in text.items()])
    cells = lambda by: F.concat_ws(by, *text.values())
    payload = F.encode(F.concat(F.lit("\x01\x02"), cells("|"), F.lit("\x7f")), "UTF-8")
    forms = {
        "plain_text": F.concat_ws(" ", text["timestamp"], F.lit("Tool"), text["tool"], F.lit("chamber"), text["chamber"], F.lit("triggered"), text["severity"], F.lit("alarm"), text["alarm"], F.lit("at"), F.concat(text["temp_c"], F.lit("C"))),
        "key_value": listed(("", ": ", ""), " "), "logfmt": listed(("", "=", ""), " "), "delimiter": cells("|"), "csv": cells(","), "tsv": cells("\t"), "json": F.to_json(F.struct(*[F.col(c).alias(k) for k, c in named.items()])),
        "xml": F.concat(F.lit("<log "), listed(("", '="', '"'), " "), F.lit(" />")), "yaml": listed(("", ": ", ""), "\n"), "binary": F.lower(F.hex(payload)),
        "syslog": F.concat(F.lit("<34>"), text["timestamp"], F.lit(" "), text["host"], F.lit(" "), text["tool"], F.lit("[1234]: "), listed(("", "=", ""), " ")),
    }
    raw = F.lit(None).cast("string")
    for fmt, form in forms.items():
        raw = F.when(F.col("format_type") == fmt, form).otherwise(raw)
    return facts.withColumn("raw_log", raw).withColumn("raw_payload", F.when(F.col("format_type") == "binary", payload)).drop("id")
