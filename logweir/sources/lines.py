"""Parsers of line formats, as expressions over arrays of lines. Input: source, format, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.level import extract_level, syslog_level
from ..functions.text import clean_text, last_wins, let, mask_quotes, normalize_whitespace, pairs, split_lines, strip
from ..functions.time import extract_timestamp

# Line shapes.
_MONTHS = "(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
PLAIN_SYSLOG = rf"^{_MONTHS}\s+(\d{{1,2}})\s+(\d{{2}}:\d{{2}}:\d{{2}})\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s+(.+)$"
ACCESS = r'^(\S+)\s+\S+\s+(\S+)\s+\[([^\]]+)\]\s+"([^"]+)"\s+(\d{3})\s+(\S+)'
RFC3164 = rf"^(?:<(\d{{1,3}})>)?{_MONTHS}\s+(\d{{1,2}})\s+(\d{{2}}:\d{{2}}:\d{{2}})\s+(\S+)\s+([^\s:]+?)(?:\[(\d+)\])?:\s*(.+)$"
RFC5424 = r"^<(\d{1,3})>(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(-|(?:\[[^\]]*+\])++)\s*+(.*)$"
# A group that repeats gives nothing back ("++", "*+"): Java walks such a group in a loop, any other by calls within calls, which a long line turns into a stack overflow.
_VALUE = r"""(?:"([^"\\]*+(?:\\.[^"\\]*+)*+)"|'([^'\\]*+(?:\\.[^'\\]*+)*+)'|([^\s,;]++))"""
_KEY = r"(?<![\w.\-/@])([\w.\-/@]++)"  # from the start of a run of its characters, so time is linear in the line
KEY_VALUE = _KEY + r"\s*+(?:=|:)\s*+" + _VALUE
LOGFMT = _KEY + r"\s*+=\s*+" + _VALUE
CANDIDATES = ("|", ";", ":", "\t", ",")
WORD_CELL = r"^(?=[_-]*+\p{L})[\p{L}_-]++$"
NUMBER_CELL = r"^[.-]*+\d[\d.-]*+$"


def line_fault(line: Column) -> Column:
    """Why a line is no text, or null: too short, undecodable, or full of control characters."""
    size = F.greatest(F.length(line), F.lit(1))
    return (
        F.when(F.length(strip(line)) < 3, "line_too_short")
        .when(F.regexp_count(line, F.lit(r"\x{FFFD}")) / size > 0.2, "encoding_error")
        .when(F.regexp_count(line, F.lit(r"[\p{C}&&[^\t\n\r]]")) / size > 0.3, "excessive_control_chars")
    )


def _entry(k: str, v: Column) -> Column:
    return F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"), F.lit(True).alias("text"))


_NONE = "array<struct<k:string,v:string,text:boolean>>"


def _entries(found: Column) -> Column:
    return F.transform(found, lambda e: F.struct(e["k"].alias("k"), e["v"].alias("v"), F.lit(True).alias("text")))


def explode_lines(files: DataFrame) -> DataFrame:
    """One row for each line that isn't blank, with its number from 1 and fault; lines that readers.read_lines numbered stay as they are."""
    if "line_number" in files.columns:
        return files.select("source", "format", "line_number", "raw", line_fault(F.col("raw")).alias("fault"))
    lines = files.select("source", "format", F.posexplode(split_lines(F.col("text"))).alias("at", "raw"))
    return lines.select("source", "format", (F.col("at") + 1).alias("line_number"), "raw", line_fault(F.col("raw")).alias("fault"))


def _told(lines: DataFrame, reason: Column, entries: Column, fallback: Column | None = None) -> DataFrame:
    return lines.select(
        "source", "format", "line_number", "raw", reason.isNotNull().alias("corrupted"), F.coalesce(reason, F.lit("")).alias("corruption_reason"),
        F.when(reason.isNull(), entries).otherwise(F.array().cast(_NONE)).alias("entries"), (F.lit(None) if fallback is None else fallback).cast("string").alias("fallback"),
    )


def parse_key_value(files: DataFrame, pattern: str = KEY_VALUE) -> DataFrame:
    lines = explode_lines(files)
    found = last_wins(F.transform(pairs(clean_text(F.col("raw")), pattern), lambda e: F.struct(F.lower(e["k"]).alias("k"), e["v"].alias("v"))))
    lines = lines.withColumn("found", found)
    few = F.when(F.size("found") < 2, F.concat(F.lit("insufficient_kv_pairs (found "), F.size("found").cast("string"), F.lit(", need 2)")))
    return _told(lines, F.coalesce("fault", few), _entries(F.col("found")))


def parse_logfmt(files: DataFrame) -> DataFrame:
    return parse_key_value(files, LOGFMT)


def _plain(line: Column) -> Column:
    """A struct of timestamp_raw, level, message and entries for a cleaned line: syslog-like, access log, else generic."""
    part = lambda shape, i: F.regexp_extract(line, shape, i)
    syslog = let(part(PLAIN_SYSLOG, 7), lambda message: F.struct(
        F.concat_ws(" ", part(PLAIN_SYSLOG, 1), part(PLAIN_SYSLOG, 2), part(PLAIN_SYSLOG, 3)).alias("timestamp_raw"), extract_level(message).alias("level"), message.alias("message"),
        F.array(_entry("hostname", part(PLAIN_SYSLOG, 4)), _entry("process", part(PLAIN_SYSLOG, 5)), _entry("pid", F.nullif(part(PLAIN_SYSLOG, 6), F.lit("")))).alias("entries"),
    ))

    def access(request: Column) -> Column:
        words, status = F.filter(F.split(request, r"\s+"), lambda w: w != ""), part(ACCESS, 5).try_cast("int")
        word = lambda i: F.coalesce(F.get(words, F.lit(i)), F.lit(""))
        entries = F.array(_entry("client", part(ACCESS, 1)), _entry("user", part(ACCESS, 2)), _entry("method", word(0)), _entry("path", word(1)), _entry("status_code", status), _entry("bytes_sent", part(ACCESS, 6)))
        return F.struct(part(ACCESS, 3).alias("timestamp_raw"), F.when(status >= 500, "ERROR").when(status >= 400, "WARN").otherwise("INFO").alias("level"), request.alias("message"), entries.alias("entries"))

    def without(text: Column, hit: Column, at: Column) -> Column:
        cut = F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(hit), F.length(text)))
        return F.when(hit.isNull(), text).otherwise(normalize_whitespace(cut))

    def levelled(p: Column) -> Column:
        mark = lambda level: F.concat(F.lit(r"(?i)\[?\b"), level, F.lit(r"\b\]?"))
        bare = let(mark(p["level"]), lambda m: without(p["rest"], F.regexp_substr(p["rest"], m), F.regexp_instr(p["rest"], m)))
        return F.struct(p["token"].alias("timestamp_raw"), p["level"].alias("level"), F.when(p["level"].isNull(), p["rest"]).otherwise(bare).alias("message"), F.array().cast(_NONE).alias("entries"))

    timed = let(extract_timestamp(line), lambda token: F.struct(token.alias("token"), normalize_whitespace(without(line, token, F.instr(line, token))).alias("rest")))
    generic = let(let(timed, lambda p: F.struct(p["token"].alias("token"), p["rest"].alias("rest"), extract_level(p["rest"]).alias("level"))), levelled)
    return F.when(line.rlike(PLAIN_SYSLOG), syslog).when(line.rlike(ACCESS), let(part(ACCESS, 4), access)).otherwise(generic)


def _with_parts(lines: DataFrame, parts: Column, fault: Column) -> DataFrame:
    """Lines whose timestamp, level and message come out of their shape."""
    lines = lines.withColumn("fault", fault).withColumn("p", F.when(F.col("fault").isNull(), parts))
    return lines.select(
        "source", "format", "line_number", "raw", F.col("fault").isNotNull().alias("corrupted"), F.coalesce("fault", F.lit("")).alias("corruption_reason"),
        F.coalesce("p.entries", F.array().cast(_NONE)).alias("entries"), F.lit(None).cast("string").alias("fallback"), F.col("p.timestamp_raw").alias("timestamp_raw"), F.col("p.level").alias("level"), F.col("p.message").alias("message"),
    )


def parse_plain_text(files: DataFrame) -> DataFrame:
    lines = explode_lines(files)
    return _with_parts(lines, let(clean_text(F.col("raw")), _plain), F.col("fault"))


def parse_syslog(files: DataFrame) -> DataFrame:
    lines = explode_lines(files).withColumn("line", clean_text(F.col("raw")))
    line = F.col("line")
    part = lambda shape, i: F.regexp_extract(line, shape, i)
    given = lambda shape, i, *none: F.when(~part(shape, i).isin("", *none), part(shape, i))
    level = lambda pri, message: F.coalesce(syslog_level(pri.try_cast("int")), extract_level(message))
    new_message, old_message = normalize_whitespace(part(RFC5424, 9)), normalize_whitespace(part(RFC3164, 8))
    new = F.struct(
        part(RFC5424, 3).alias("timestamp_raw"), level(part(RFC5424, 1), new_message).alias("level"), new_message.alias("message"),
        F.concat(
            F.array(_entry("priority", part(RFC5424, 1).try_cast("int")), _entry("version", part(RFC5424, 2)), _entry("hostname", part(RFC5424, 4)), _entry("app_name", given(RFC5424, 5, "-")), _entry("pid", given(RFC5424, 6, "-")), _entry("msgid", given(RFC5424, 7, "-"))),
            F.when(part(RFC5424, 8) != "-", F.array(_entry("structured_data", part(RFC5424, 8)))).otherwise(F.array().cast(_NONE)),
        ).alias("entries"),
    )
    old = F.struct(
        F.concat_ws(" ", part(RFC3164, 2), part(RFC3164, 3), part(RFC3164, 4)).alias("timestamp_raw"), level(part(RFC3164, 1), old_message).alias("level"), old_message.alias("message"),
        F.array(_entry("priority", given(RFC3164, 1).try_cast("int")), _entry("hostname", part(RFC3164, 5)), _entry("app_name", part(RFC3164, 6)), _entry("pid", given(RFC3164, 7))).alias("entries"),
    )
    fits = line.rlike(RFC5424) | line.rlike(RFC3164)
    return _with_parts(lines, F.when(line.rlike(RFC5424), new).otherwise(old), F.coalesce("fault", F.when(~fits, "invalid_syslog")))


def detect_delimiter(lines: Column) -> Column:
    """Of | ; : tab , the one with the greatest mean count times share of lines, over the first thirty; ties go to the earlier, none to |."""
    some = F.transform(F.slice(lines, 1, 30), mask_quotes)
    scores = []
    for rank, d in enumerate(CANDIDATES):
        counts = F.transform(some, lambda x, d=d: F.length(x) - F.length(F.replace(x, F.lit(d))))
        total = F.aggregate(counts, F.lit(0), lambda a, x: a + x)
        hits = F.size(F.filter(counts, lambda x: x > 0))
        scores.append(F.struct((total.cast("double") * hits).alias("score"), F.lit(-rank).alias("rank"), F.lit(d).alias("d")))
    return F.when(F.size(some) > 0, F.array_max(F.filter(F.array(*scores), lambda s: (s["score"] > 0) | (s["rank"] == 0)))["d"]).otherwise("|")


def _cells(line: Column, delimiter: Column) -> Column:
    return F.split(line, F.concat(F.lit(r"\Q"), delimiter, F.lit(r"\E")), F.lit(-1))


def header_like(cells: Column) -> Column:
    """Half the cells or more are words, and none is a number."""
    bare = F.transform(cells, strip)
    words = F.size(F.filter(bare, lambda c: c.rlike(WORD_CELL)))
    numbers = F.size(F.filter(bare, lambda c: c.rlike(NUMBER_CELL)))
    return (words / F.greatest(F.size(cells), F.lit(1)) >= 0.5) & (numbers == 0)


def delimiter_header_like(cells: Column) -> Column:
    """Three cells of five or more begin with a letter."""
    return F.size(F.filter(cells, lambda c: strip(c).rlike("^[A-Za-z_]"))) / F.greatest(F.size(cells), F.lit(1)) >= 0.6


def _tabled(files: DataFrame, delimiter: Column, head: Column, first_number: int) -> DataFrame:
    """Lines with their cells and the header of their file; the header itself isn't a line."""
    told = files.withColumn("lines", split_lines(F.col("text"))).withColumn("delimiter", delimiter)
    told = told.withColumn("first", _cells(F.get("lines", F.lit(0)), F.col("delimiter"))).withColumn("headed", F.coalesce(head, F.lit(False)))
    header = F.when(F.col("headed"), F.transform("first", lambda c: F.lower(strip(c))))
    told = told.select("source", "format", "delimiter", "headed", header.alias("header"), F.size("first").alias("width"), F.posexplode(F.when(F.col("headed"), F.slice("lines", 2, 1 << 30)).otherwise(F.col("lines"))).alias("at", "raw"))
    number = F.col("at") + 1 + F.when(F.col("headed"), first_number - 1).otherwise(0)
    return told.withColumn("line_number", number).withColumn("fault", line_fault(F.col("raw")))


def parse_delimiter(files: DataFrame, delimiter: str | None = None) -> DataFrame:
    found = F.lit(delimiter) if delimiter else detect_delimiter(F.col("lines"))
    lines = _tabled(files, found, delimiter_header_like(F.col("first")), 1)
    lines = lines.withColumn("parts", F.transform(_cells(clean_text(F.col("raw")), F.col("delimiter")), lambda c: F.trim(F.trim(strip(c), F.lit('"')), F.lit("'"))))
    n = F.size("parts")
    reason = F.when(F.col("headed") & (n != F.size("header")), F.concat(F.lit("column_mismatch: expected "), F.size("header").cast("string"), F.lit(", got "), n.cast("string"))).when(n < 2, "too_few_columns")
    names = F.coalesce("header", F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lit("col_"), i.cast("string"))))
    zipped = F.transform(F.arrays_zip(names.alias("k"), F.col("parts").alias("v")), lambda e: F.struct(e["k"].alias("k"), e["v"].alias("v")))
    return _told(lines, F.coalesce("fault", reason), _entries(last_wins(zipped)), F.element_at("parts", -1))


def parse_tsv(files: DataFrame, has_header: bool | None = None) -> DataFrame:
    head = header_like(F.col("first")) if has_header is None else F.lit(has_header)
    lines = _tabled(files, F.lit("\t"), head, 2).withColumn("parts", F.split("raw", "\t", -1))
    n = F.size("parts")
    reason = F.when(n != F.col("width"), F.concat(F.lit("column_mismatch: expected "), F.col("width").cast("string"), F.lit(", got "), n.cast("string")))
    names = F.coalesce("header", F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.concat(F.lit("col_"), i.cast("string"))))
    zipped = F.transform(F.arrays_zip(names.alias("k"), F.col("parts").alias("v")), lambda e: F.struct(e["k"].alias("k"), clean_text(e["v"]).alias("v")))
    return _told(lines, F.coalesce("fault", reason), _entries(last_wins(zipped)), clean_text(F.element_at("parts", -1)))


def parse_binary(files: DataFrame, chunk_size: int = 16) -> DataFrame:
    """Chunks of content as records; a text's bytes are its ISO-8859-1 ones. Timestamp and level come from the printable preview."""
    size = F.length("content")
    starts = F.when(size > 0, F.sequence(F.lit(0), size - 1, F.lit(chunk_size)))
    told = files.select("source", "format", "content", F.posexplode(starts).alias("at", "start"))
    told = told.withColumn("chunk", F.substring("content", F.col("start") + 1, F.lit(chunk_size)))
    hexed = F.lower(F.hex("chunk"))
    preview = F.regexp_replace(F.decode("chunk", "ISO-8859-1"), "[^ -~]", ".")
    told = told.withColumn("ascii", preview).withColumn("clean", clean_text(preview))
    number = (F.col("at") + 1).cast("int")
    entries = F.array(_entry("offset", F.col("start")), _entry("size_bytes", F.length("chunk")), _entry("hex", hexed), _entry("ascii", F.col("ascii")))
    return told.select(
        "source", "format", number.alias("line_number"), hexed.alias("raw"), F.lit(False).alias("corrupted"), F.lit("").alias("corruption_reason"), entries.alias("entries"), F.lit(None).cast("string").alias("fallback"),
        extract_timestamp(F.col("clean")).alias("timestamp_raw"), extract_level(F.col("clean")).alias("level"), F.when(F.col("clean") != "", F.col("clean")).otherwise(F.concat(F.lit("binary_chunk_"), number.cast("string"))).alias("message"),
    )
