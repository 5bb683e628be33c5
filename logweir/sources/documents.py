"""Parsers whose grammar spans lines: csv, json, xml, yaml. Arrow batches of whole documents in, parsed records out."""

from __future__ import annotations

import csv
import io
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..schema import PARSED

# The record tags of XML logs, and how long a JSON record's raw text may be.
RECORD_TAGS = {"log", "entry", "event", "record", "alarm", "message"}
RAW_LIMIT = 512
CELL_LIMIT = (1 << 31) - 1
_YAML_PAIR = re.compile(r"^([^:#][^:]*?):(?:\s+(.*))?$")

Record = tuple[int, str, str, dict, str | None]  # line number, raw, fault, entries, fallback message


def shown(value) -> tuple[str | None, bool]:
    """A value's text and whether it was a string."""
    if value is None or isinstance(value, str):
        return value, isinstance(value, str)
    return json.dumps(value, ensure_ascii=False), False


def line_fault(line: str) -> str:
    """As lines.line_fault."""
    import unicodedata

    size = max(len(line), 1)
    if len(line.strip()) < 3:
        return "line_too_short"
    if line.count("�") / size > 0.2:
        return "encoding_error"
    if sum(unicodedata.category(c)[0] == "C" and c not in "\t\n\r" for c in line) / size > 0.3:
        return "excessive_control_chars"
    return ""


def header_like(cells: list[str]) -> bool:
    bare = [c.strip() for c in cells]
    words = sum(c.replace("_", "").replace("-", "").isalpha() for c in bare if c)
    return bool(cells) and words / len(cells) >= 0.5 and not any(c.replace(".", "").replace("-", "").isdigit() for c in bare)


def csv_rows(text: str, delimiter: str = ",", quote: str = '"') -> Iterator[list[str]]:
    csv.field_size_limit(CELL_LIMIT)
    return csv.reader(io.StringIO(text), delimiter=delimiter, quotechar=quote)


def csv_header(row: list[str], has_header: bool | None = None) -> tuple[list[str], bool]:
    """The column names that a file's first row gives, and whether it is a header, not a record."""
    headed = header_like(row) if has_header is None else has_header
    return ([c.strip().lower() for c in row] if headed else [f"col_{i}" for i in range(len(row))]), headed


def csv_record(number: int, row: list[str], header: list[str]) -> Iterator[Record]:
    """What a row that isn't the header says; nothing if it is blank."""
    raw = ",".join(row)
    if not any(c.strip() for c in row):
        return
    if len(row) != len(header):
        yield number, raw, f"column_mismatch: expected {len(header)}, got {len(row)}", {}, None
    elif sum(c.count("�") / max(len(c), 1) > 0.3 for c in row) / len(row) > 0.5:
        yield number, raw, "cell_encoding_error", {}, None
    else:
        yield number, raw, "", {h: c.strip() for h, c in zip(header, row)}, row[-1]


def read_csv(text: str, has_header: bool | None = None, delimiter: str = ",", quote: str = '"') -> Iterator[Record]:
    header: list[str] | None = None
    for number, row in enumerate(csv_rows(text, delimiter, quote), 1):
        if header is None:
            header, headed = csv_header(row, has_header)
            if headed:
                continue
        yield from csv_record(number, row, header)


def flatten(value: dict, depth: int = 5, prefix: str = "", separator: str = ".") -> dict:
    """Dotted keys for nested objects, down to depth; lists and what lies deeper stay whole."""
    flat: dict = {}
    for k, v in value.items():
        key = f"{prefix}{separator}{k}" if prefix else str(k)
        if isinstance(v, dict) and v and depth > 1:
            flat |= flatten(v, depth - 1, key, separator)
        else:
            flat[key] = v
    return flat


def load(text: str):
    """The JSON value, also of a text with trailing commas; ValueError if there is none."""
    try:
        return json.loads(text)
    except RecursionError as e:
        raise ValueError("nested too deeply") from e
    except ValueError:
        return json.loads(re.sub(r",\s*+([}\]])", r"\1", text))


def read_json(text: str, depth: int = 5, flat: bool = True) -> Iterator[Record]:
    depth = depth if flat else 1  # nested objects stay whole
    whole = text.strip()
    one = None
    if whole.startswith("[") or whole.startswith("{") and "\n{" not in whole:
        try:
            one = json.loads(whole)
        except (ValueError, RecursionError):
            pass
    if isinstance(one, list):
        for number, item in enumerate(one, 1):
            ok = isinstance(item, dict)
            yield number, f"[{number}]" if ok else str(item), "" if ok else "array_item_not_object", flatten(item, depth) if ok else {}, None
        return
    if isinstance(one, dict):
        yield 1, whole[:80], "", flatten(one, depth), None
        return
    for number, line in enumerate((x for x in text.splitlines() if x.strip()), 1):
        fault, found = line_fault(line), {}
        if not fault:
            try:
                item = load(line.strip())
            except ValueError:
                fault = "invalid_json"
            else:
                found, fault = (flatten(item, depth), "") if isinstance(item, dict) else ({}, "json_not_object")
        yield number, line if fault or len(line) < RAW_LIMIT else line[:RAW_LIMIT] + "…", fault, found, None


def _bare(tag: str) -> str:
    return tag.split("}", 1)[-1]


def element_entries(element: ET.Element, path: str = "") -> dict:
    """Texts by path and by tag, attributes by path.@name and by @name."""
    tag = _bare(element.tag)
    here = path or tag
    found: dict = {}
    for k, v in element.attrib.items():
        found[f"{here}.@{_bare(k)}"] = found[f"@{_bare(k)}"] = v
    text = (element.text or "").strip()
    if text:
        found[here] = text
        if path:
            found[tag] = text
    for child in element:
        if isinstance(child.tag, str):
            found |= element_entries(child, f"{here}.{_bare(child.tag)}")
    return found


def read_xml(text: str) -> Iterator[Record]:
    whole = text.strip()
    if not whole:
        return
    root = None
    for form in (whole, f"<root>{whole}</root>"):
        try:
            root = ET.fromstring(form)
            break
        except ET.ParseError:
            continue
    if root is None:
        yield 1, whole[:200], "invalid_xml", {}, None
        return
    children = [c for c in root if isinstance(c.tag, str)]
    tags = {_bare(c.tag).lower() for c in children}
    apart = len(tags) == 1 or len(children) > 1 and tags & RECORD_TAGS
    for number, element in enumerate(children if apart else [root], 1):
        found = element_entries(element)
        yield number, ET.tostring(element, encoding="unicode"), "", found, ([v for v in found.values() if v.strip()] or [_bare(element.tag)])[-1]


def yaml_blocks(text: str) -> list[list[str]]:
    """Documents between --- lines, and list items, without blank lines."""
    blocks: list[list[str]] = [[]]
    for line in text.splitlines():
        bare = line.strip()
        if not bare or bare == "...":
            continue
        now = blocks[-1]
        item = bare.startswith("- ") and now and (now[0].lstrip().startswith("- ") or not any(x.lstrip().startswith("- ") for x in now))
        if bare == "---" or item:
            blocks.append([])
        if bare != "---":
            blocks[-1].append(line)
    return [b for b in blocks if b]


def yaml_entries(lines: list[str]) -> dict:
    """Scalars by dotted path; the path follows the indentation."""
    found: dict = {}
    parents: list[tuple[int, str]] = []
    for line in lines:
        bare = line.strip()
        if bare.startswith("#"):
            continue
        indent = len(line) - len(line.lstrip(" "))
        bare = bare[2:].strip() if bare.startswith("- ") else bare
        while parents and parents[-1][0] >= indent:
            parents.pop()
        pair = _YAML_PAIR.match(bare)
        if not pair:
            continue
        key, value = pair[1].strip().strip('"').strip("'"), (pair[2] or "").strip()
        if not value:
            parents.append((indent, key))
            continue
        quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "\"'"
        words = {"null": None, "true": True, "false": False}
        found[".".join([*(p for _, p in parents), key])] = value[1:-1] if quoted else words.get(value.lower(), value)
    return found


def read_yaml(text: str) -> Iterator[Record]:
    for number, lines in enumerate(yaml_blocks(text), 1):
        found = yaml_entries(lines)
        raw = "\n".join(lines)
        fallback = next((v for v in found.values() if isinstance(v, str) and v.strip()), "yaml_record")
        yield (number, raw, "", found, fallback) if found else (number, raw[:200], "invalid_yaml", {}, None)


READERS: dict[str, Callable[..., Iterator[Record]]] = {"csv": read_csv, "json": read_json, "xml": read_xml, "yaml": read_yaml}
_ENTRY = pa.list_(pa.struct([("k", pa.string()), ("v", pa.string()), ("text", pa.bool_())]))
_PARSED = pa.schema([("source", pa.string()), ("format", pa.string()), ("line_number", pa.int32()), ("raw", pa.string()), ("corrupted", pa.bool_()), ("corruption_reason", pa.string()), ("entries", _ENTRY), ("fallback", pa.string())])
_CHUNK = 2000


def read_safely(read: Callable[[], Iterator[Record]]) -> Iterator[Record]:
    """The records, and where the file can't be read on, one of line 0 that says why."""
    try:
        yield from read()
    except (csv.Error, ET.ParseError, RecursionError, ValueError) as e:
        yield 0, "", f"file_error: {type(e).__name__}: {e}", {}, None


def parsed_row(source: str, fmt: str, record: Record) -> dict:
    number, raw, fault, found, fallback = record
    entries = [{"k": k, "v": v, "text": t} for k, (v, t) in ((k, shown(v)) for k, v in found.items())]
    return {"source": source, "format": fmt, "line_number": number, "raw": raw, "corrupted": bool(fault), "corruption_reason": fault, "entries": entries, "fallback": fallback}


def parse_documents(files: DataFrame, **options) -> DataFrame:
    """Files whose format is csv, json, xml or yaml, with source, format and text; options go to the readers by format name.

    A file that can't be read to its end gives what came before and a corrupted record of line 0 with the error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out: list[dict] = []
                reader, given = READERS[row["format"]], options.get(row["format"], {})
                for record in read_safely(lambda: reader(row["text"] or "", **given)):  # noqa: B023
                    out.append(parsed_row(row["source"], row["format"], record))
                    if len(out) >= _CHUNK:
                        yield pa.RecordBatch.from_pylist(out, _PARSED)
                        out = []
                if out:
                    yield pa.RecordBatch.from_pylist(out, _PARSED)

    return files.select("source", "format", "text").mapInArrow(run, PARSED)
