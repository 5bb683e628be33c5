"""Transforms by name, from raw text to a canonical value. What can't be converted is null."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

from .numeric import parse_numeric
from .text import strip
from .time import isoformat, parse_timestamp


def _one_of(allowed: Sequence[str]) -> Callable[[Column], Column]:
    def run(x: Column) -> Column:
        s = F.replace(F.replace(F.lower(strip(x)), F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_"))
        out = F.lit(None).cast("string")
        for name in reversed(allowed):
            out = F.when(s.contains(name) | F.lit(name).contains(s), name).otherwise(out)
        return F.when(s.isin(*allowed), s).otherwise(out)

    return run


def _unit_id(x: Column) -> Column:
    s = F.lower(strip(x))
    digits = F.regexp_extract(s, r"(\d+)", 1)
    bare = F.regexp_replace(digits, r"^0+(?=\d)", "")
    return F.when(digits == "", s).otherwise(F.concat(F.lit("unit_"), F.when(F.length(bare) < 2, F.lpad(bare, 2, "0")).otherwise(bare)))


def _whole(x: Column) -> Column:
    return F.replace(strip(x), F.lit("_")).try_cast("long")


TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "identity": lambda x: x,
    "to_float": parse_numeric,
    "to_int": _whole,
    "to_string": strip,
    "parse_datetime": lambda x: isoformat(parse_timestamp(x)),
    "epoch_ms_to_utc": lambda x: isoformat(F.timestamp_millis(_whole(x))),
    "epoch_s_to_utc": lambda x: isoformat(F.timestamp_seconds(_whole(x))),
    "celsius_to_celsius": parse_numeric,
    "fahrenheit_to_celsius": lambda x: (parse_numeric(x) - 32.0) * 5.0 / 9.0,
    "kelvin_to_celsius": lambda x: parse_numeric(x) - 273.15,
    "pa_to_pa": parse_numeric,
    "kpa_to_pa": lambda x: parse_numeric(x) * 1_000.0,
    "torr_to_pa": lambda x: parse_numeric(x) * 133.322,
    "mbar_to_pa": lambda x: parse_numeric(x) * 100.0,
    "psi_to_pa": lambda x: parse_numeric(x) * 6_894.76,
    "w_to_w": parse_numeric,
    "kw_to_w": lambda x: parse_numeric(x) * 1_000.0,
    "mw_to_w": lambda x: parse_numeric(x) / 1_000.0,
    "normalize_unit_id": _unit_id,
    "normalize_alarm_severity": _one_of(("critical", "warning", "info")),
    "normalize_status": _one_of(("active", "idle", "failure", "normal", "processing")),
}


def apply_transform(name: str, value: Column) -> Column:
    """KeyError for a name that isn't in TRANSFORMS."""
    return TRANSFORMS[name](value)
