"""Encoding, control characters, white space, key-value text."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

# What ends a line, what counts as an escape sequence or a control character.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"
ANSI = r"\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
KEY_VALUE = r"""(?<![\w.\-/])([\w.\-/]++)\s*+[:=]\s*+(?:"([^"]*+)"|'([^']*+)'|(\S++))"""
DELIMITERS = r"[|;,\t]+"
QUOTED_TEXT = r""""[^"]*"|'[^']*'"""


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def decode_bytes(content: Column) -> Column:
    """UTF-8 where the bytes are valid UTF-8, else ISO-8859-1, which fits any bytes."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.trim(text, F.lit(SPACES))


def split_lines(text: Column) -> Column:
    """The lines that aren't blank."""
    return F.filter(F.split(text, LINE_BREAK, -1), lambda x: strip(x) != "")


def strip_control_characters(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, ANSI, ""), CONTROL, "")


def normalize_whitespace(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"[ \t]+", " "))


def clean_text(text: Column) -> Column:
    return normalize_whitespace(strip_control_characters(F.make_valid_utf8(text)))


def normalize_delimiter(line: Column, target: str = ",") -> Column:
    return F.regexp_replace(line, DELIMITERS, target)


def mask_quotes(line: Column) -> Column:
    """Quoted stretches as QQQ, so that what is in them isn't counted."""
    return F.regexp_replace(line, QUOTED_TEXT, "QQQ")


def pairs(text: Column, pattern: str, groups: int = 3) -> Column:
    """(k, v) structs of all matches of a pattern with a key and alternative value groups; the first group that isn't empty is the value."""
    value = lambda x: reduce(lambda a, b: F.when(a != "", a).otherwise(b), [x[str(i)] for i in range(1, groups + 1)])

    def zipped(line: Column) -> Column:
        found = [F.regexp_extract_all(line, F.lit(pattern), F.lit(i)) for i in range(1, groups + 2)]
        return F.transform(F.arrays_zip(*[f.alias(str(i)) for i, f in enumerate(found)]), lambda x: F.struct(x["0"].alias("k"), value(x).alias("v")))

    return let(text, zipped)


def last_wins(entries: Column) -> Column:
    """(k, v) structs with each key once, at its first place with its last value. Sorted by key and place, so a line of a million keys takes no square of them."""
    placed = F.transform(entries, lambda e, i: F.struct(e["k"].alias("k"), i.alias("i"), e["v"].alias("v")))

    def kept(all_: Column) -> Column:
        other = lambda e, at: F.coalesce(~F.get(all_, at)["k"].eqNullSafe(e["k"]), F.lit(True))
        first = F.filter(all_, lambda e, j: (j == 0) | other(e, j - 1))
        last = F.filter(all_, lambda e, j: (j == F.size(all_) - 1) | other(e, j + 1))
        runs = F.arrays_zip(first.alias("a"), last.alias("z"))
        return F.array_sort(F.transform(runs, lambda r: F.struct(r["a"]["i"].alias("i"), r["a"]["k"].alias("k"), r["z"]["v"].alias("v"))))

    return F.transform(let(F.array_sort(placed), kept), lambda e: F.struct(e["k"].alias("k"), e["v"].alias("v")))


def parse_kv_pairs(text: Column) -> Column:
    """A map of the key=value and key:value pairs in a text."""
    return F.map_from_entries(last_wins(pairs(text, KEY_VALUE)))


def special_characters(line: Column) -> Column:
    """The distinct structural characters of a line, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(line, F.lit(r"[=:_./\[\]{}@#]"), F.lit(0))))


def dict_to_line(record: Column) -> Column:
    """k=v pairs of a map, joined by blanks; keys that begin with _ are left out."""
    shown = F.filter(F.map_entries(record), lambda e: ~e["key"].startswith("_"))
    return F.array_join(F.transform(shown, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("None")))), " ")
