"""Template signatures of lines, fingerprints of schemas."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import strip

# What is variable in a line, in the order of masking, and what separates tokens.
MASKS = (
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<UUID>"),
    (r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?\b", "<TIME>"),
    (r"\b\d{10,13}\b", "<TIME>"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b|\b(?:[0-9a-fA-F]{1,4}:){2,7}[0-9a-fA-F]{1,4}\b", "<IP>"),
    (r"\b0[xX][0-9a-fA-F]+\b", "<HEX>"),
    (r"[A-Za-z]:\\(?:[\w.\- ]++\\?+)++", "<PATH>"),
    (r"(?:^|(?<=\s))(?:/[\w.\-]++){2,}+", "<PATH>"),
    (r"(?:^|(?<=\s))\.{1,2}/[\w./\-]+", "<PATH>"),
    (r"-?(?<!\d)\d++\.\d++(?:[eE][+-]?\d++)?", "<NUM>"),
    (r"-?\b\d+\b", "<NUM>"),
)
SEPARATORS = r"""[\s,;|=:"'()\[\]{}]+"""


def mask_variables(line: Column) -> Column:
    for pattern, name in MASKS:
        line = F.regexp_replace(line, pattern, name)
    return line


def tokenise(line: Column) -> Column:
    return F.filter(F.split(strip(line), SEPARATORS), lambda t: t != "")


def generate_signature(line: Column) -> Column:
    """Sixteen hex digits that lines of one template share."""
    return F.substring(F.sha2(F.array_join(tokenise(mask_variables(strip(line))), " "), 256), 1, 16)


def schema_fingerprint(record: Column) -> Column:
    """Sixteen hex digits of a map's sorted keys."""
    return F.substring(F.sha2(F.array_join(F.array_sort(F.map_keys(record)), "|"), 256), 1, 16)
