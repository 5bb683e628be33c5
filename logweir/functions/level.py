"""Log levels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Level words, and the names of syslog severities 0 to 7.
WORDS = r"(?i)\b(TRACE|DEBUG|INFO|NOTICE|WARN(?:ING)?|ERROR|CRITICAL|FATAL|SEVERE|ALERT|EMERGENCY)\b"
LEVELS = ("TRACE", "DEBUG", "INFO", "NOTICE", "WARN", "WARNING", "ERROR", "CRITICAL", "FATAL", "SEVERE", "ALERT")
SYSLOG = ("EMERGENCY", "ALERT", "CRITICAL", "ERROR", "WARN", "NOTICE", "INFO", "DEBUG")


def level_name(text: Column) -> Column:
    """Upper case; WARNING is WARN."""
    upper = F.upper(text)
    return F.when(upper == "WARNING", "WARN").otherwise(upper)


def extract_level(text: Column) -> Column:
    """The first level word of a text, or null."""
    return level_name(F.nullif(F.regexp_extract(text, WORDS, 1), F.lit("")))


def syslog_level(priority: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SYSLOG)), (priority % 8 + 1).cast("int"))
