"""Measurements in canonical units."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .text import let, strip

# Per measurement, each unit's factor and offset to the canonical unit, and the range that counts as physical.
UNITS: dict[str, dict[str, tuple[str, float]]] = {
    "temperature": {"C": ("same", 0), "°C": ("same", 0), "F": ("fahrenheit", 0), "°F": ("fahrenheit", 0), "K": ("minus", 273.15)},
    "pressure": {"Pa": ("same", 0), "kPa": ("times", 1_000), "MPa": ("times", 1_000_000), "mTorr": ("times", 0.133322), "Torr": ("times", 133.322), "psi": ("times", 6_894.76), "bar": ("times", 100_000), "mbar": ("times", 100), "atm": ("times", 101_325)},
    "rf_power": {"W": ("same", 0), "kW": ("times", 1_000), "mW": ("over", 1_000)},
    "flow_rate": {"sccm": ("same", 0), "slm": ("times", 1_000), "slpm": ("times", 1_000), "ccm": ("same", 0)},
    "voltage": {"V": ("same", 0), "mV": ("over", 1_000), "kV": ("times", 1_000)},
    "current": {"A": ("same", 0), "mA": ("over", 1_000), "uA": ("over", 1_000_000)},
}
RANGES = {"temperature": (-200.0, 1500.0), "pressure": (0.0, 1e8), "rf_power": (0.0, 1e6), "flow_rate": (0.0, 1e5), "voltage": (-1e4, 1e4), "current": (-1e4, 1e4)}
VALUE = r"^([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\s*([A-Za-z°µ/]+)?$"


def _converted(kind: str, by: float, x: Column) -> Column:
    return {"same": x, "fahrenheit": (x - 32) * 5 / 9, "minus": x - by, "times": x * float(by), "over": x / float(by or 1)}[kind]


def general(x: Column) -> Column:
    """Four significant digits, for flags: plain between 1e-4 and 1e4, else with an exponent. Rounded half up from the shortest decimal form."""

    def shown(e: Column) -> Column:
        digits, power = F.substring_index(e, "e", 1), F.substring_index(e, "e", -1)
        bare = lambda text: F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")
        return F.when(power.cast("int").between(-4, 3), bare(F.format_string("%.7f", e.cast("double")))).otherwise(F.concat(bare(digits), F.lit("e"), power))

    return F.when(x == 0, "0").otherwise(let(F.format_string("%.3e", x), shown))


def normalise_field(field: str, text: Column) -> tuple[Column, Column]:
    """The value in the canonical unit, and an array of flags. A unit is looked up as written, then without case; an unknown one leaves the number."""
    table, (low, high) = UNITS[field], RANGES[field]

    def converted(number: Column, unit: Column) -> tuple[Column, Column]:
        known, value = F.lit(False), number
        for exact in (False, True):  # the exact names go outside, so they are asked first
            for name, (kind, by) in reversed(table.items()):
                fits = unit == name if exact else F.lower(unit) == name.lower()
                value, known = F.when(fits, _converted(kind, by, number)).otherwise(value), known | fits
        return value, known

    def parts(s: Column) -> Column:
        return F.struct(s.alias("s"), s.rlike(VALUE).alias("ok"), F.regexp_extract(s, VALUE, 1).try_cast("double").alias("number"), F.regexp_extract(s, VALUE, 2).alias("unit"))

    def measured(p: Column) -> Column:
        value, known = converted(p["number"], p["unit"])
        return F.struct(p["s"].alias("s"), p["ok"].alias("ok"), p["unit"].alias("unit"), value.alias("value"), known.alias("known"))

    def told(p: Column) -> Column:
        inside = p["value"].between(low, high)
        flags = [
            F.when((p["s"] != "") & ~p["ok"], F.concat(F.lit(f"unparseable_value:{field}:"), F.substring(p["s"], 1, 30))),
            F.when(p["ok"] & (p["unit"] != "") & ~p["known"], F.concat(F.lit(f"unknown_unit:{field}:"), p["unit"])),
            F.when(p["ok"] & ~inside, F.concat(F.lit(f"out_of_range:{field}:"), general(p["value"]))),
        ]
        return F.struct(F.when(p["ok"] & inside, p["value"]).alias("value"), F.array_compact(F.array(*flags)).alias("flags"))

    x = let(let(let(strip(text), parts), measured), told)
    return F.when(text.isNotNull(), x["value"]), F.when(text.isNotNull(), x["flags"]).otherwise(F.array().cast("array<string>"))


def normalise_units(values: dict[str, Column]) -> tuple[dict[str, Column], Column]:
    """Texts by measurement to values by measurement, and all flags."""
    told = {f: normalise_field(f, c) for f, c in values.items()}
    return {f: v for f, (v, _) in told.items()}, reduce(F.concat, [x for _, x in told.values()])
