"""Format detection: a weighted vote over a file's head, and a first-match cascade for single texts."""

from __future__ import annotations

import csv
import io
import json
import os
import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from ..functions.text import LINE_BREAK, strip
from ..schema import FORMATS

# The weights of the votes, the size of the sample, file endings, line shapes.
EXTENSION, STRUCTURE, PATTERN, BASELINE = 40, 35, 25, 5
SAMPLE_BYTES, SAMPLE_LINES, CSV_ROWS = 16_384, 50, 20
ENDINGS = {
    "json": "json", "jsonl": "json", "ndjson": "json", "xml": "xml", "yaml": "yaml", "yml": "yaml", "bin": "binary", "dat": "binary", "syslog": "syslog",
    "logfmt": "logfmt", "csv": "csv", "tsv": "tsv", "txt": "plain_text", "log": "plain_text", "out": "plain_text",
}
# A key starts where its run of characters does and gives none of them back: time is linear in the line.
KEY_VALUE = re.compile(r'(?<![\w.\-/])[\w.\-/]++\s*+[:=]\s*+(?:"[^"]*"|\S+)')
LOGFMT = re.compile(r'(?<![\w.\-/@])[\w.\-/@]++\s*+=\s*+(?:"[^"]*"|\'[^\']*\'|\S+)')
SYSLOG = re.compile(r"^(?:<\d{1,3}>)?(?:[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\S+|\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})")
XML = re.compile(r"^\s*<[^>]+>")
YAML = re.compile(r"^\s*+(?:---|-?\s*+[\w.-]+\s*:\s*.+)$")


def _tiered(ratio: float, high: float = 0.7, low: float = 0.3) -> float:
    return STRUCTURE + PATTERN * ratio if ratio >= high else PATTERN * ratio if ratio >= low else 0.0


def _is_json(text: str, kind=object) -> bool:
    try:
        return isinstance(json.loads(text), kind)
    except (ValueError, RecursionError):
        return False


def _xml(text: str, lines: list[str]) -> float:
    if not (text.startswith("<") and text.endswith(">")):
        return 0.0
    try:
        ET.fromstring(text)
        return STRUCTURE + PATTERN
    except ET.ParseError:
        return PATTERN * 0.7 if lines and all(map(XML.match, lines[:5])) else 0.0


def _binary(data: bytes, text: str) -> float:
    if b"\0" in data:
        return STRUCTURE + 5
    odd = sum(ord(c) < 32 and c not in "\n\r\t" or c == "�" for c in text) / max(len(text), 1)
    return STRUCTURE * odd + PATTERN if odd > 0.25 else 0.0


def _csv(text: str, lines: list[str]) -> float:
    try:
        widths = [len(r) for r, _ in zip(csv.reader(io.StringIO(text)), range(CSV_ROWS))]
    except csv.Error:
        return 0.0
    if len(widths) < 2 or sum("\t" in x for x in lines) / len(lines) > 0.6:
        return 0.0
    even = STRUCTURE * widths.count(widths[0]) / len(widths) if widths[0] > 1 else 0.0
    return even + PATTERN * sum("," in x for x in lines) / len(lines)


def _tsv(lines: list[str]) -> float:
    widths = [x.count("\t") for x in lines if "\t" in x]
    if not widths:
        return 0.0
    head = widths[:20]
    return (STRUCTURE * head.count(head[0]) / len(head) + PATTERN) * len(widths) / len(lines)


def scores(data: bytes, ending: str = "") -> dict[str, float]:
    """The votes for each format."""
    text = data.decode("utf-8", errors="replace")
    lines = [x for x in text.splitlines() if x.strip()][:SAMPLE_LINES]
    votes = dict.fromkeys(FORMATS, 0.0)
    if ending in ENDINGS:
        votes[ENDINGS[ending]] += EXTENSION
    votes["plain_text"] += BASELINE
    votes["binary"] += _binary(data, text)
    whole = text.strip()
    if (whole[:1], whole[-1:]) in (("{", "}"), ("[", "]")) and _is_json(whole):
        votes["json"] += STRUCTURE + PATTERN
    elif lines:
        votes["json"] += _tiered(sum(_is_json(x.strip(), dict) for x in lines) / len(lines), 0.8, 0.5)
    votes["xml"] += _xml(whole, lines)
    if lines:
        share = lambda test: sum(map(bool, map(test, lines))) / len(lines)
        votes["yaml"] += _tiered(share(lambda x: YAML.match(x) and "=" not in x))
        votes["syslog"] += _tiered(share(SYSLOG.match))
        votes["logfmt"] += _tiered(share(lambda x: len(LOGFMT.findall(x)) >= 2))
        votes["key_value"] += _tiered(share(lambda x: len(KEY_VALUE.findall(x)) >= 2))
        votes["csv"] += _csv(text, lines)
        votes["tsv"] += _tsv(lines)
        votes["delimiter"] += PATTERN * share(lambda x: "|" in x or ";" in x)
    return votes


def detect_bytes(data: bytes, name: str = "") -> str:
    """The format with most votes; of equals, the first in FORMATS."""
    votes = scores(data[:SAMPLE_BYTES], os.path.splitext(name)[1].lower().lstrip("."))
    return max(FORMATS, key=votes.__getitem__)


def detect_lines(lines: list[str]) -> str:
    return detect_bytes("\n".join(lines[:200]).encode("utf-8", errors="replace"))


@F.pandas_udf(T.StringType())
def _detected(head: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([detect_bytes(bytes(h) if h is not None else b"", n or "") for h, n in zip(head, name)])


def detect_format(content: Column, name: Column) -> Column:
    """The format of each file from its first bytes and name; only the sample crosses to Python."""
    return _detected(F.substring(content, F.lit(1), F.lit(SAMPLE_BYTES)), name)


# Shapes of the cascade.
_TAG = r"^\s*<[A-Za-z_][\w:.-]*[\s>]"
_YAML_KEY = r"^\s*\w[\w\s]*:\s+\S"
_LOGFMT_PAIRS = r'\w=(?:\S+\w=\S|(?:"[^"]*"|\S++)\s++\w++=\S|"[^"]*"\w++=\S)'  # two pairs in a row
_PAIR = r"(?<!\w)\w++\s*+[=:]\s*+\S+"


def route_text(content: Column) -> Column:
    """The parser for a single text: json, xml, yaml, syslog, logfmt, keyvalue, delimiter or plaintext, by the first test that holds over twenty lines.

    A text of one line is never plaintext: half of one line, rounded down, is none.
    """
    lines = F.slice(F.split(content, LINE_BREAK, -1), 1, 20)
    first = strip(F.get(lines, F.lit(0)))
    full = F.filter(lines, lambda x: strip(x) != "")
    half = F.floor(F.size(full) / 2)
    count = lambda test: F.size(F.filter(full, test))
    valid = lambda x: F.try_parse_json(x).isNotNull()
    json_here = (first.startswith("{") | first.startswith("[")) & (valid(first) | (count(lambda x: strip(x).startswith("{") & valid(strip(x))) > 0))
    at_least = F.greatest(F.lit(1).cast("long"), half)
    return (
        F.when(json_here, "json")
        .when(first.rlike(r"(?i)^\s*<\?xml") | first.rlike(_TAG), "xml")
        .when(first.rlike(r"^---\s*$") | (count(lambda x: x.rlike(_YAML_KEY)) >= 3), "yaml")
        .when(first.rlike(r"^<\d{1,3}>"), "syslog")
        .when(count(lambda x: x.rlike(_LOGFMT_PAIRS) & ~x.rlike("[|;]")) >= at_least, "logfmt")
        .when(count(lambda x: F.regexp_count(x, F.lit(_PAIR)) >= 2) >= at_least, "keyvalue")
        .when((F.size(full) > 0) & ((count(lambda x: x.contains("|")) >= half) | (count(lambda x: x.contains(";")) >= half)), "delimiter")
        .otherwise("plaintext")
    )
