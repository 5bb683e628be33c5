"""Records of each format against expected ones, record ids included. The texts are small literals of the shapes that the formats have."""

import hashlib
import json

import pytest

from logweir.sources import readers

YEAR = 2026
CASES = {
    "plain_text": (
        "2024-01-15 10:23:01 INFO Application started in 1,234 ms\nJan 15 10:23:02 web01 nginx[123]: ERROR upstream timed out\n\n"
        '10.0.0.1 - bob [15/Jan/2024:10:23:03 +0000] "GET /x HTTP/1.1" 401 512\n[WARNING] 2024/01/15 10:23:04 disk  low\nab\n',
        [
            (1, "2024-01-15T10:23:01.000Z", "INFO", "Application started in 1,234 ms", {}, ""),
            (2, "2026-01-15T10:23:02.000Z", "ERROR", "ERROR upstream timed out", {"hostname": "web01", "process": "nginx", "pid": "123"}, ""),
            (3, "2024-01-15T10:23:03.000Z", "WARN", "GET /x HTTP/1.1", {"client": "10.0.0.1", "user": "bob", "method": "GET", "path": "/x", "status_code": "401", "bytes_sent": "512"}, ""),
            (4, "2024-01-15T10:23:04.000Z", "WARN", "[WARNING] disk low", {}, ""),
            (5, None, None, "", {}, "line_too_short"),
        ],
    ),
    "key_value": (
        'ts=2024-01-15T10:23:01Z level: warning host=a msg="disk  full" cpu=90% mem=512MB\nonly=one\n',
        [(1, "2024-01-15T10:23:01.000Z", "WARN", "disk full", {"host": "a", "cpu": "90%", "mem": "512"}, ""), (2, None, None, "", {}, "insufficient_kv_pairs (found 1, need 2)")],
    ),
    "logfmt": ("ts=2024-01-15T10:23:01Z level=error msg='a b' temp=72C\n", [(1, "2024-01-15T10:23:01.000Z", "ERROR", "a b", {"temp": "72"}, "")]),
    "delimiter": (
        "timestamp|level|host|message\n2024-01-15 10:23:01|ERROR|web|boom now\n2024-01-15 10:23:02|INFO|web\n",
        [(1, "2024-01-15T10:23:01.000Z", "ERROR", "boom now", {"timestamp": "2024-01-15 10:23:01"} and {"host": "web"}, ""), (2, "2024-01-15T10:23:02.000Z", "INFO", "", {}, "column_mismatch: expected 4, got 3")],
    ),
    "csv": (
        'timestamp,level,host,note,message\n2024-01-15T10:23:01Z,warning,web,,"a, ""b""\nc"\n\n2024-01-15T10:23:02Z,INFO,web\n',
        [(2, "2024-01-15T10:23:01.000Z", "WARN", 'a, "b"\nc', {"host": "web"}, ""), (4, None, None, "", {}, "column_mismatch: expected 5, got 3")],
    ),
    "tsv": ("timestamp\tlevel\tpid\tmessage\n2024-01-15 10:23:01\tINFO\t12\thello\n\t\t\t\n2024-01-15 10:23:02\tnone\t13\tbye\n", [(2, "2024-01-15T10:23:01.000Z", "INFO", "hello", {"pid": "12"}, ""), (3, "2024-01-15T10:23:02.000Z", None, "bye", {"pid": "13"}, "")]),
    "json": (
        '{"time":"2024-01-15T10:23:01.5Z","severity":"4","msg":"x","ctx":{"a":{"b":"30s"},"l":[1,"2s"]},"ok":true}\n{"a": 1,}\n[1]\nnope!\n',
        [(1, "2024-01-15T10:23:01.500Z", "WARN", "x", {"ctx.a.b": "30", "ctx.l": '[1, "2s"]', "ok": "true"}, ""), (2, None, None, "", {"a": "1"}, ""), (3, None, None, "", {}, "json_not_object"), (4, None, None, "", {}, "invalid_json")],
    ),
    "xml": (
        '<logs><log><timestamp>2024-01-15T10:23:01Z</timestamp><level>info</level><t unit="C">72.5</t><message>hi there</message></log><alarm code="E1">bad thing</alarm></logs>',
        None,
    ),
    "yaml": ("---\ntimestamp: 2024-01-15T10:23:01Z\nlevel: Error\ntool:\n  id: ETCH\n  t: '72C'\nmessage: \"oh no\"\n---\n- a: null\n", [(1, "2024-01-15T10:23:01.000Z", "ERROR", "oh no", {"tool.id": "ETCH", "tool.t": "72"}, ""), (2, None, None, "yaml_record", {"a": None}, "")]),
    "syslog": (
        "<34>Oct 11 22:14:15 mymachine su[77]: failed for lonvick\n<165>1 2024-01-15T10:23:01.003Z host app - ID47 [x y=\"1\"] An event\nnothing here\n",
        [
            (1, "2026-10-11T22:14:15.000Z", "CRITICAL", "failed for lonvick", {"priority": "34", "hostname": "mymachine", "app_name": "su", "pid": "77"}, ""),
            (2, "2024-01-15T10:23:01.003Z", "NOTICE", "An event", {"priority": "165", "version": "1", "hostname": "host", "app_name": "app", "pid": None, "msgid": "ID47", "structured_data": '[x y="1"]'}, ""),
            (3, None, None, "", {}, "invalid_syslog"),
        ],
    ),
}


@pytest.mark.parametrize("fmt", CASES)
def test_records(spark, fmt):
    text, want = CASES[fmt]
    got = sorted(readers.ingest(readers.from_bytes(spark, [("src", text.encode())]), fmt, YEAR).collect(), key=lambda r: r.line_number)
    for r in got:
        assert r.record_id == hashlib.sha1(f"src:{r.line_number}:{r.raw}".encode()).hexdigest()[:16]
        assert r.format == fmt and r.corrupted == bool(r.corruption_reason)
    if want is not None:
        assert [(r.line_number, r.timestamp, r.level, r.message, r.fields, r.corruption_reason) for r in got] == want
    else:
        assert [(r.message, r.level) for r in got] == [("hi there", "INFO"), ("bad thing", None)]
        assert got[0].fields["log.t"] == "72.5" and got[0].fields["@unit"] == "C" and got[1].fields["@code"] == "E1"


def test_binary(spark):
    data = bytes.fromhex("000145544c1002323032342d30312d31355431303a32333a30315a004552524f52")
    got = sorted(readers.ingest(readers.from_bytes(spark, [("b", data)]), "binary").collect(), key=lambda r: r.line_number)
    assert [r.raw for r in got] == [data[i : i + 16].hex() for i in range(0, len(data), 16)]
    assert got[0].message == "..ETL..2024-01-1" and got[0].fields["offset"] == "0" and got[-1].fields["size_bytes"] == "1"


def test_encodings_and_empty(spark):
    files = readers.from_bytes(spark, [("l", "caf\xe9 at noon".encode("latin-1")), ("u", "café at noon".encode()), ("e", b"")])
    got = {r.source: r.message for r in readers.ingest(files, "plain_text").collect()}
    assert got == {"l": "café at noon", "u": "café at noon"}


def test_detected_formats(spark):
    names = {f: f + {"plain_text": ".log", "json": ".jsonl"}.get(f, "") for f in CASES}
    files = readers.from_bytes(spark, [(names[f], t.encode()) for f, (t, _) in CASES.items()])
    got = {r.source.split(".")[0]: r.format for r in readers.with_format(files).select("source", "format").collect()}
    assert got["json"] == "json" and got["xml"] == "xml" and got["yaml"] == "yaml" and got["tsv"] == "tsv" and got["syslog"] == "syslog" and got["logfmt"] == "logfmt"


def test_folder(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps({"msg": "x", "level": "info"}) + "\n")
    (tmp_path / "b.txt").write_text("hello there world\n")
    got = readers.ingest_path(spark, str(tmp_path), pattern="*.*").collect()
    assert sorted((r.format, r.message) for r in got) == [("json", "x"), ("plain_text", "hello there world")]
