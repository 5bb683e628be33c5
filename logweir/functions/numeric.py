"""Units off, numbers out of text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import let, strip

# The units that are taken off values, and what reads as a number.
UNIT = (
    r"(?i)(-?(?<!\d)\d++(?:\.\d++)?)\s*+(?:°)?(?:[KMGTPE]?[Bb](?:ytes?)?|[KMGTPE]?[Bb]ps?|[kmµunp]?(?:s|ms|us|ns)|[km]?Hz|[KMGT]?Hz|[kmMG]?W"
    r"|[mMkKuU]?[aAvV]|[°℃℉]?[CF]|rpm|dB|lx|Pa|psi|bar|%)\b"
)
_DIGITS = r"\d++(?:_\d++)*+"
WHOLE = rf"^[+-]?{_DIGITS}$"
REAL = rf"(?i)^[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:e[+-]?\d+)?|inf(?:inity)?|nan)$"


def remove_units(text: Column) -> Column:
    return let(text, lambda t: F.when(t.rlike(r"\d"), strip(F.regexp_replace(t, UNIT, "$1"))).otherwise(strip(t)))


def try_numeric(text: Column) -> Column:
    """The text of the number that a text is, in plain form, or the text itself. Whole numbers of any length stay whole."""

    def number(text: Column, given: Column) -> Column:
        bare = F.replace(given, F.lit("_"))
        digits = F.regexp_replace(bare, r"^[+-]?0*(?=\d)", "")
        whole = F.when(bare.startswith("-") & (digits != "0"), F.concat(F.lit("-"), digits)).otherwise(digits)
        return F.when(given.rlike(WHOLE), whole).when(given.rlike(REAL), F.regexp_replace(F.lower(bare), r"^\+", "").try_cast("double").cast("string")).otherwise(text)

    likely = r"(?i)^[^a-z]*\d|^\s*[+-]?\.?\d|^\s*[+-]?(?:inf|nan)"  # all else is no number
    return let(text, lambda t: F.when(t.rlike(likely), let(F.replace(strip(t), F.lit(",")), lambda given: number(t, given))).otherwise(t))


def coerce_value(text: Column, units: bool = True) -> Column:
    v = strip(text)
    return try_numeric(remove_units(v) if units else v)


def parse_numeric(text: Column) -> Column:
    """A double, or null for what is no number."""
    s = strip(text.cast("string"))
    return F.when(s.rlike(REAL), F.replace(s, F.lit("_")).try_cast("double"))
