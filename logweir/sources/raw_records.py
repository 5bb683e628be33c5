"""The second family of parsers: one text to maps of vendor field names, for streams. Input: a frame with id and text; output: id, at, record."""

from __future__ import annotations

import csv
import io
import json
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import REAL
from ..functions.text import LINE_BREAK, last_wins, strip
from ..operators.detect import route_text

# Pair and syslog shapes, facility and severity names.
# Keys begin where their run of characters does and repeated groups give nothing back: linear time, and no calls within calls in the JVM.
LOGFMT = r'(?<!\w)(\w++)=("(?:[^"\\]++|\\.)*+"|\S*+)'
KEY_VALUE = r"""(?<![\w.])[0-9.]*+([A-Za-z_][\w.]*+)\s*+[=:]\s*+([^\s,;|"']++|"[^"]*+"|'[^']*+')"""
FACILITIES = (
    "kern", "user", "mail", "daemon", "auth", "syslog", "lpr", "news", "uucp", "cron", "security", "ftp", "ntp", "logaudit", "logalert", "clock",
    "local0", "local1", "local2", "local3", "local4", "local5", "local6", "local7",
)
SEVERITIES = ("emergency", "alert", "critical", "error", "warning", "notice", "informational", "debug")
RFC5424 = r"^<(\d{1,3})>(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\[.*?\]|-)\s*(.*)?$"
_DAY = r"([A-Za-z]{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})"
BSD = rf"^<(\d{{1,3}})>{_DAY}\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s*(.*)?$"
PRI_ISO = r"^<(\d{1,3})>(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?)\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s*(.*)?$"
NO_PRI = rf"^{_DAY}\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s*(.*)?$"

_MAP = "map<string,string>"


def _map(**values: Column) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])


def syslog_record(line: Column) -> Column:
    """The fields of the first of four shapes that fits, with facility and severity names; else raw_text alone."""
    part = lambda shape, i: F.regexp_extract(line, shape, i)
    given = lambda shape, i: F.nullif(part(shape, i), F.lit(""))
    undashed = lambda i: F.when(part(RFC5424, i) != "-", part(RFC5424, i))

    def decoded(shape: str) -> dict[str, Column]:
        pri = part(shape, 1).try_cast("int")
        facility = F.shiftright(pri, 3)
        return {"priority": pri, "facility": F.coalesce(F.get(F.array(*map(F.lit, FACILITIES)), facility), facility.cast("string")), "severity": F.get(F.array(*map(F.lit, SEVERITIES)), pri.bitwiseAND(7))}

    rest = lambda shape, at: {"timestamp": part(shape, at), "hostname": part(shape, at + 1), "app_name": part(shape, at + 2), "process_id": given(shape, at + 3), "message": part(shape, at + 4), "raw_text": line}
    new = _map(**decoded(RFC5424), timestamp=undashed(3), hostname=undashed(4), app_name=undashed(5), process_id=undashed(6), message_id=undashed(7), message=part(RFC5424, 9), raw_text=line)
    return (
        F.when(line.rlike(RFC5424), new).when(line.rlike(BSD), _map(**decoded(BSD), **rest(BSD, 2))).when(line.rlike(PRI_ISO), _map(**decoded(PRI_ISO), **rest(PRI_ISO, 2)))
        .when(line.rlike(NO_PRI), _map(**rest(NO_PRI, 1))).otherwise(_map(raw_text=line))
    )


def _pairs(line: Column, pattern: str) -> Column:
    found = F.arrays_zip(F.regexp_extract_all(line, F.lit(pattern), F.lit(1)).alias("k"), F.regexp_extract_all(line, F.lit(pattern), F.lit(2)).alias("v"))
    return F.transform(found, lambda e: F.struct(e["k"].alias("k"), e["v"].alias("v")))


def logfmt_record(line: Column) -> Column:
    """Quoted values without quotes, empty ones as null; raw_text where there is no pair."""
    quoted = lambda v: v.rlike(r'(?s)^".*"$') & (F.length(v) > 1)
    value = lambda v: F.nullif(F.when(quoted(v), F.replace(F.substring(v, F.lit(2), F.length(v) - 2), F.lit('\\"'), F.lit('"'))).otherwise(v), F.lit(""))
    found = F.transform(_pairs(line, LOGFMT), lambda e: F.struct(e["k"].alias("k"), value(e["v"]).alias("v")))
    return F.when(F.size(found) > 0, F.map_from_entries(last_wins(found))).otherwise(_map(raw_text=line))


def keyvalue_record(line: Column) -> Column:
    """As logfmt_record for = and :, with the line itself under _raw_kv_line."""
    bare = lambda v: F.nullif(F.when(v.rlike(r"""^(".*"|'.*')$"""), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v), F.lit(""))
    found = F.transform(_pairs(line, KEY_VALUE), lambda e: F.struct(e["k"].alias("k"), bare(e["v"]).alias("v")))
    whole = F.array(F.struct(F.lit("_raw_kv_line").alias("k"), line.alias("v")))
    return F.when(F.size(found) > 0, F.map_from_entries(last_wins(F.concat(found, whole)))).otherwise(_map(raw_text=line))


def _lines(frame: DataFrame) -> DataFrame:
    full = F.filter(F.transform(F.split("text", LINE_BREAK, -1), strip), lambda x: x != "")
    return frame.select("id", F.posexplode(full).alias("at", "line"))


def _delimited(frame: DataFrame) -> DataFrame:
    """Cells between | or ;, whichever is more frequent; named by the first line if it has no number and the second has one, else by place."""
    told = frame.withColumn("lines", F.filter(F.split("text", LINE_BREAK, -1), lambda x: strip(x) != ""))
    count = lambda c: F.length("text") - F.length(F.replace("text", F.lit(c)))
    told = told.withColumn("d", F.when(count("|") >= count(";"), r"\|").otherwise(";"))
    cells = lambda line: F.transform(F.split(line, F.col("d"), F.lit(-1)), strip)
    numbers = lambda line: F.size(F.filter(cells(line), lambda c: c.rlike(REAL)))
    headed = (F.size("lines") >= 2) & (numbers(F.get("lines", F.lit(0))) == 0) & (numbers(F.get("lines", F.lit(1))) > 0)
    told = told.withColumn("headed", headed).withColumn("header", F.when(F.col("headed"), cells(F.get("lines", F.lit(0)))))
    rows = told.select("id", "d", "header", F.posexplode(F.when(F.col("headed"), F.slice("lines", 2, 1 << 30)).otherwise(F.col("lines"))).alias("at", "line"))
    entry = lambda v, i: F.struct(F.coalesce(F.get("header", i), F.concat(F.lit("field_"), i.cast("string"))).alias("k"), v.alias("v"))
    return rows.select("id", "at", F.map_from_entries(last_wins(F.transform(cells(F.col("line")), entry))).alias("record"))


def flatten_all(value, path: str = "") -> dict:
    """Dotted keys for objects and [i] for lists, to any depth."""
    if isinstance(value, dict):
        return {k: v for key, x in value.items() for k, v in flatten_all(x, f"{path}.{key}" if path else str(key)).items()}
    if isinstance(value, list):
        return {k: v for i, x in enumerate(value) for k, v in flatten_all(x, f"{path}[{i}]").items()}
    return {path: value}


def json_records(text: str) -> list[dict]:
    text = text.strip()
    if text[:1] in ("{", "["):
        try:
            whole = json.loads(text)
            return [flatten_all(x) for x in (whole if isinstance(whole, list) else [whole]) if isinstance(x, dict)]
        except ValueError:
            pass
    out = []
    for line in filter(None, map(str.strip, text.splitlines())):
        try:
            item = json.loads(line)
            out.append(flatten_all(item) if isinstance(item, dict) else {"raw_text": line})
        except ValueError as e:
            out.append({"raw_text": line, "_parse_error": str(e)})
    return out


def xml_records(text: str) -> list[dict]:
    bare = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else str(e.tag)

    def entries(element, path: str = "") -> dict:
        here = f"{path}.{bare(element)}" if path else bare(element)
        found = {f"{here}_{k}": v for k, v in element.attrib.items()}
        if (element.text or "").strip():
            found[here] = element.text.strip()
        for child in element:
            found |= entries(child, here)
        return found

    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        return []
    return [r for r in map(entries, list(root) or [root]) if r]


def table_records(text: str, delimiter: str) -> list[dict]:
    rows = csv.DictReader(io.StringIO(text), delimiter=delimiter)
    return [{k.strip(): v.strip() if v else None for k, v in r.items() if k is not None} for r in rows]


def yaml_records(text: str) -> list[dict]:
    import yaml

    try:
        whole = list(yaml.safe_load_all(text))
    except yaml.YAMLError:
        return []
    return [flatten_all(x) for d in whole for x in (d if isinstance(d, list) else [d]) if isinstance(x, dict)]


WHOLE = {"json": json_records, "xml": xml_records, "csv": lambda t: table_records(t, ","), "tsv": lambda t: table_records(t, "\t"), "yaml": yaml_records}


def _whole(frame: DataFrame) -> DataFrame:
    kind = pa.schema([("id", pa.int64()), ("at", pa.int32()), ("record", pa.map_(pa.string(), pa.string()))])

    def text_of(v):
        return v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False, default=str)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = WHOLE[row["format"]](row["text"] or "")
                yield pa.RecordBatch.from_pylist([{"id": row["id"], "at": i, "record": [(k, text_of(v)) for k, v in r.items()]} for i, r in enumerate(found)], kind)

    return frame.select("id", "format", "text").mapInArrow(run, f"id long, at int, record {_MAP}")


def parse_texts(frame: DataFrame, format_col: str | None = None) -> DataFrame:
    """id and text to id, format, at and record; the format is told by a column or found by route_text. Binary has no records, unknown formats are plaintext."""
    told = frame.withColumn("format", F.col(format_col) if format_col else route_text(F.col("text")))
    line_kinds = {"syslog": syslog_record, "logfmt": logfmt_record, "keyvalue": keyvalue_record}
    special = [*line_kinds, *WHOLE, "delimiter", "binary"]
    out = []
    for kind, record in line_kinds.items():
        rows = _lines(told.where(F.col("format") == kind))
        out.append(rows.select("id", "at", record(F.col("line")).cast(_MAP).alias("record")))
    out.append(_lines(told.where(~F.col("format").isin(*special))).select("id", "at", _map(raw_text=F.col("line")).alias("record")))
    out.append(_delimited(told.where(F.col("format") == "delimiter")))
    out.append(_whole(told.where(F.col("format").isin(*WHOLE))))
    return reduce(DataFrame.unionByName, out).join(told.select("id", "format"), "id")
