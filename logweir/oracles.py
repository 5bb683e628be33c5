"""DuckDB SQL for the registered queries."""

from __future__ import annotations

FACTS = r"""
files as (select greatest(10, count(*) // 50000) as n from events),
f as (select event_id, ts, event_type, props, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') as iso,
  case event_type when 'error' then 'ERROR' when 'signup' then 'WARN' when 'purchase' then 'NOTICE' else 'INFO' end as level,
  'user ' || user_id || ' did ' || event_type as message, user_id as "user", floor(value * 100)::bigint as cents from events)"""

_LINES = {
    "plain_text": "iso || ' [' || level || '] ' || message",
    "key_value": """'ts: ' || iso || ' level=' || level || ' user=' || "user" || ' cents=' || cents || ' msg="' || message || '"'""",
    "logfmt": """'ts=' || iso || ' level=' || level || ' user=' || "user" || ' cents=' || cents || ' msg=''' || message || ''''""",
    "delimiter": """concat_ws('|', iso, level, "user", cents, message)""",
    "csv": """concat_ws(',', iso, level, "user", cents, message)""",
    "tsv": """concat_ws(chr(9), iso, level, "user", cents, message)""",
    "json": """'{"time":"' || iso || '","severity":"' || lower(level) || '","ctx":{"user":' || "user" || ',"cents":"' || cents || '"},"msg":"' || message || '"}'""",
    "xml": """'<entry id="' || "user" || '"><ts>' || iso || '</ts><level>' || level || '</level><cents>' || cents || '</cents><message>' || message || '</message></entry>'""",
    "yaml": """'ts: ' || iso || chr(10) || 'level: ' || level || chr(10) || 'ctx:' || chr(10) || '  user: ' || "user" || chr(10) || '  cents: ' || cents || chr(10) || 'message: ''' || message || ''''""",
    "syslog": """'<' || case level when 'ERROR' then 11 when 'WARN' then 12 when 'NOTICE' then 13 else 14 end || '>1 ' || iso || ' host' || "user" || ' app ' || cents || ' ID' || event_id || ' - ' || message""",
}
#: An element's raw text goes on to the next element.
_TAIL = {"xml": " || case when lead(event_id) over (partition by event_id % (select n from files) order by event_id) is null then '' else chr(10) end"}
_START = {"csv": 1, "tsv": 1}


def _parsed(fmt: str) -> str:
    user = {"plain_text": "null", "syslog": """'host' || "user" """}.get(fmt, '"user"')
    cents = {"plain_text": "null"}.get(fmt, "cents")
    return f"""
with {FACTS},
l as (select *, {_LINES[fmt]}{_TAIL.get(fmt, '')} as line, 'f' || (event_id % (select n from files)) as source, row_number() over (partition by event_id % (select n from files) order by event_id) + {_START.get(fmt, 0)} as line_number from f)
select source, line_number::int as line_number, substr(sha1(source || ':' || line_number || ':' || line), 1, 16) as record_id, iso as timestamp, level, message, {user}::varchar as "user", {cents}::varchar as cents, false as corrupted from l
"""


ORACLES: dict[str, str] = {f"parse_{fmt}": _parsed(fmt) for fmt in _LINES}

ORACLES["parse_binary"] = f"""
with {FACTS},
b as (select 'f' || (event_id % (select n from files)) as source, string_agg(hex(encode(level || ' ' || "user" || ' ' || cents || chr(1))), '' order by event_id) as h from f group by 1),
c as (select source, lower(h) as h, unnest(range(0, (len(h) / 2)::bigint, 16)) as p from b)
select source, (p // 16 + 1)::int as line_number, substr(sha1(source || ':' || (p // 16 + 1) || ':' || substr(h, p * 2 + 1, 32)), 1, 16) as record_id, substr(h, p * 2 + 1, 32) as hex, p::varchar as "at" from c
"""

ORACLES["route_lines"] = """
select kind, route, n from (select event_id % 5 as kind, case event_id % 5 when 0 then 'json' when 1 then 'logfmt' when 2 then 'syslog' when 3 then 'delimiter' else 'xml' end as route, count(*) as n from events group by 1, 2)
"""

ORACLES["stream_records"] = f"""
with {FACTS}
select event_id as id, case event_id % 4 when 0 then 'json' when 1 then 'logfmt' when 2 then 'syslog' else 'delimiter' end as format,
  case when event_id % 4 = 2 then 'host' || "user" else "user"::varchar end as who, case when event_id % 4 = 1 then '''user' else message end as what,
  case event_id % 4 when 1 then level when 2 then case level when 'ERROR' then 'error' when 'WARN' then 'warning' when 'NOTICE' then 'notice' else 'informational' end end as level from f
"""

ORACLES["fn_timestamps"] = """
with g as (select event_id, event_id % 12 as k, ts, date_trunc('second', ts) as s from events),
x as (select event_id, k, case k when 0 then strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') when 1 then strftime(ts, '%Y-%m-%dT%H:%M:%SZ') when 2 then strftime(ts, '%Y-%m-%dT%H:%M:%S') when 3 then strftime(ts, '%d/%b/%Y:%H:%M:%S +0130')
  when 4 then strftime(ts, '%b %-d %Y %H:%M:%S') when 5 then strftime(ts, '%Y/%m/%d %H:%M:%S') when 6 then strftime(ts, '%Y-%m-%d %H:%M:%S.%f') when 7 then strftime(ts, '%d-%m-%Y %H:%M:%S') when 8 then strftime(ts, '%m/%d/%Y %H:%M:%S')
  when 9 then strftime(ts, '%Y-%m-%d') when 10 then strftime(ts, '%d/%m/%Y') else strftime(ts, 'no time at %H') end as given,
  case when k in (0) then date_trunc('millisecond', ts) when k in (1, 2, 4, 5, 7, 8) then s when k = 3 then s - interval 90 minute when k = 6 then ts when k in (9, 10) then date_trunc('day', ts) end as t from g)
select event_id, given, strftime(t, '%Y-%m-%dT%H:%M:%S.%gZ') as iso,
  case when k = 3 then null when k = 11 then null else given end as token,
  case when k in (0, 1, 2, 11) then given else strftime(t, '%Y-%m-%dT%H:%M:%S') || case when microsecond(t) % 1000000 > 0 then strftime(t, '.%f') else '' end || '+00:00' end as standard
from x
"""

ORACLES["fn_numbers"] = f"""
with {FACTS},
x as (select event_id, event_id % 7 as k, cents from f)
select event_id, case k when 1 then cents || ' kPa' when 2 then case when cents = 0 then '0' else '-' || cents end when 3 then cents || '%' when 4 then (1000000 + cents)::varchar when 5 then 'id-' || cents when 6 then cents || '5d' else cents::varchar end as coerced,
  case k when 1 then cents || ' kPa' when 2 then '-' || cents when 3 then cents || '%' when 4 then '1,' || lpad(cents::varchar, 6, '0') when 5 then 'id-' || cents when 6 then cents || '5d' else cents::varchar end as bare from x
"""

ORACLES["fn_levels"] = f"""
with {FACTS}
select event_id, case when event_id % 3 = 0 then 'WARN' when event_type = 'error' then 'ERROR' when event_id % 3 = 1 then 'FATAL' end as level,
  ['EMERGENCY', 'ALERT', 'CRITICAL', 'ERROR', 'WARN', 'NOTICE', 'INFO', 'DEBUG'][event_id % 8 + 1] as by_priority from f
"""

ORACLES["fn_clean_text"] = f"""
with {FACTS}
select event_id, message || ' ' || level as clean, level || ',' || message as commas, '.:' as marks from f
"""

ORACLES["fn_key_values"] = f"""
with {FACTS}
select event_id, 'last.' || cents as "user", message as msg, level, 3 as n, substr(sha256('level|msg|user'), 1, 16) as fingerprint from f
"""

ORACLES["fn_signatures"] = f"""
with {FACTS},
x as (select event_id, '<TIME> user <NUM> did ' || event_type || ' host=<IP> id=<HEX> took <NUM> <PATH> <TIME>' as masked from f)
select event_id, masked, substr(sha256(array_to_string(list_filter(regexp_split_to_array(masked, '[\\s,;|=:"''()\\[\\]{{}}]+'), lambda t: t <> ''), ' ')), 1, 16) as signature from x
"""

ORACLES["signature_counts"] = """
select substr(sha256('user <NUM> did ' || event_type), 1, 16) as signature, count(*) as n from events group by 1
"""

ORACLES["fn_units"] = f"""
with {FACTS},
x as (select event_id, event_id % 6 as k, ((cents % 2000) || '.21')::double as n, event_id // 6 as j from f),
y as (select *, case k when 0 then ['C', 'F', 'k', ''][j % 4 + 1] when 1 then ['Pa', 'mTorr', 'PSI', 'bar'][j % 4 + 1] when 2 then ['W', 'kW'][j % 2 + 1] when 3 then ['sccm', 'slm', 'x'][j % 3 + 1] when 4 then ['V', 'kV'][j % 2 + 1] else ['mA', 'uA'][j % 2 + 1] end as u from x),
z as (select *, case u when 'F' then (n - 32) * 5 / 9.0::double when 'k' then n - 273.15::double when 'mTorr' then n * 0.133322::double when 'PSI' then n * 6894.76::double when 'bar' then n * 100000 when 'kW' then n * 1000 when 'slm' then n * 1000 when 'kV' then n * 1000 when 'mA' then n / 1000.0 when 'uA' then n / 1000000.0 else n end::double as v from y),
r as (select *, case k when 0 then v between -200 and 1500 when 1 then v between 0 and 1e8 when 2 then v between 0 and 1e6 when 3 then v between 0 and 1e5 else v between -1e4 and 1e4 end as ok,
  ['temperature', 'pressure', 'rf_power', 'flow_rate', 'voltage', 'current'][k + 1] as name from z)
select event_id, case when k = 0 and ok then round(v, 6) end as temperature, case when k = 1 and ok then round(v, 6) end as pressure, case when k = 2 and ok then round(v, 6) end as rf_power, case when k = 3 and ok then round(v, 6) end as flow_rate,
  case when k = 4 and ok then round(v, 6) end as voltage, case when k = 5 and ok then round(v, 6) end as current,
  concat_ws(',', case when u = 'x' then 'unknown_unit:flow_rate:x' end, case when not ok then 'out_of_range:' || name || ':' || printf('%.4g', v) end) as flags
from r
"""

ORACLES["fn_transforms"] = f"""
with {FACTS}
select event_id, round((cents - 32.0::double) * 5.0 / 9.0, 6) as celsius, round(cents * 133.322::double, 3) as pa, cents / 1000.0::double as w, 'unit_' || case when event_id % 120 < 10 then '0' else '' end || (event_id % 120) as unit,
  case level when 'WARN' then 'warning' when 'ERROR' then 'critical' else 'info' end as severity, cents as whole, '2024-04-15T12:03:20+00:00' as utc from f
"""

ORACLES["dedup_keep_first"] = """
select l_orderkey, l_linenumber, l_partkey, l_shipdate, n - 1 as duplicates from (
  select *, row_number() over (partition by l_orderkey order by l_shipdate, l_linenumber, l_partkey) as r, count(*) over (partition by l_orderkey) as n from lineitem) where r = 1
"""

_STAGED = f"""
{FACTS},
a as (select 'f' || (event_id % (select n from files)) as source, row_number() over (partition by event_id % (select n from files) order by event_id) as line_number, level from f),
s as (select source, line_number, level, false as corrupted, '' as reason, case when line_number <= 5 then 1 else 0 end as duplicates from a
  union all select source, line_number, null, true, 'insufficient_kv_pairs (found 1, need 2)', 0 from a)
"""

ORACLES["stage_totals"] = f"""
with {_STAGED}
select (count(*) + sum(duplicates))::bigint as total_seen, count(*) filter (where not corrupted) as clean, count(*) filter (where corrupted) as corrupted, sum(duplicates)::bigint as duplicates, round(count(*) filter (where not corrupted) / count(*), 6) as success_rate from s
"""

ORACLES["stage_distribution"] = f"""
with {_STAGED}
select 'level' as kind, level as value, count(*) as n from s where not corrupted group by 2
union all select 'format', 'key_value', count(*) from s where not corrupted
union all select 'corruption_reason', reason, count(*) from s where corrupted group by 2
"""

ORACLES["stage_per_source"] = f"""
with {_STAGED}
select source, 'key_value' as format, count(*) as total, count(*) filter (where not corrupted) as clean, count(*) filter (where corrupted) as corrupted, round(100.0 * count(*) filter (where not corrupted) / count(*), 1) as success_pct from s group by 1
"""

_LOGFMT = f"""
{FACTS},
l as (select *, {_LINES["logfmt"]} as line, 'f' || (event_id % (select n from files)) as source, row_number() over (partition by event_id % (select n from files) order by event_id) as line_number from f),
r as (select *, substr(sha1(source || ':' || line_number || ':' || line), 1, 16) as record_id from l)
"""

ORACLES["stage_select"] = f"""
with {_LOGFMT}
select source, line_number::int as line_number, message from r where level = 'ERROR' and lower(message || ' ' || line || ' ' || source) like '%user 1%' and line_number % 2 = 0
"""

ORACLES["stage_page"] = f"""
with {_LOGFMT}
select message, record_id, (select count(*) from r)::int as total, ceil((select count(*) from r) / 25.0)::int as pages from r order by message desc, record_id limit 25 offset 50
"""

ORACLES["export_pivot"] = f"""
with {_LOGFMT}
select record_id, level, "user"::varchar as "user", cents::varchar as cents from r
"""

for _agg in ("count", "sum", "avg", "min", "max"):
    _value = "count(*)" if _agg == "count" else f"round({_agg}(o_totalprice), 4)" if _agg in ("sum", "avg") else f"{_agg}(o_totalprice)"
    ORACLES[f"chart_{_agg}"] = f"select o_orderpriority as label, {_value} as value from orders group by 1 order by 2 desc, 1 limit 25"

ORACLES["chart_top_customers"] = "select o_custkey as label, count(*) as value from orders group by 1 order by 2 desc, 1 limit 10"

ORACLES["profile_customer"] = " union all ".join(
    f"select '{c}' as \"column\", count(*) as rows, count({c}) as non_null, count(*) - count({c}) as nulls, count(distinct {c}) as \"distinct\", min({c})::varchar as min, max({c})::varchar as max, round(100.0 * count({c}) / count(*), 1) as fill_pct, round(100.0 * count(distinct {c}) / count({c}), 1) as distinct_pct from customer"
    for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
)

ORACLES["search_parts"] = """
select * from part where p_partkey::varchar ilike '%brand#1%' or p_name ilike '%brand#1%' or p_brand ilike '%brand#1%' or p_type ilike '%brand#1%' or p_size::varchar ilike '%brand#1%'
"""

ORACLES["blob_previews"] = f"""
with {FACTS}
select event_id, '0x' || substr(lower(hex(encode(repeat(message, event_id % 4)))), 1, 96) || case when len(repeat(message, event_id % 4)) > 48 then '...' else '' end as blob from f
"""

_REGISTRY = """
k as (select *, ['timestamp', 'tool_id', 'alarm_code', 'lot_id', 'note'][1:(p_partkey % 6)] as keys from part),
v as (select printf('sig%06d', p_partkey) as signature, case when p_partkey % 11 > 0 then p_type else 'unknown' end as format, keys, p_size * 2 / 100.0::double as confidence, p_partkey % 40 as hit_count,
  case when p_partkey % 3 = 0 then printf('2024-02-%02dT00:00:00', p_partkey % 28 + 1) else printf('2024-01-%02dT00:00:00', p_partkey % 28 + 1) end as updated_at from k)
"""

ORACLES["registry_totals"] = f"""
with {_REGISTRY}
select count(*) as row_count, round(avg(confidence), 6) as avg_confidence, sum(hit_count)::bigint as total_hits, count(*) filter (where confidence >= 0.9) as high, count(*) filter (where confidence >= 0.75 and confidence < 0.9) as medium, count(*) filter (where confidence < 0.75) as low from v
"""
ORACLES["registry_formats"] = f"with {_REGISTRY} select format as label, count(*) as count from v group by 1 order by 2 desc, 1 limit 8"
ORACLES["registry_signals"] = f"with {_REGISTRY} select signal, count(*) as count from (select unnest(keys) as signal from v) group by 1 order by 2 desc, 1 limit 12"
ORACLES["registry_coverage"] = f"""
with {_REGISTRY},
s as (select unnest(['timestamp', 'tool_id', 'alarm_code', 'event_code', 'lot_id', 'recipe', 'chamber', 'wafer_id']) as signal)
select signal, (select count(*) from v where list_contains(keys, signal)) as count, round(100.0 * (select count(*) from v where list_contains(keys, signal)) / (select count(*) from v), 1) as coverage_pct from s
"""
ORACLES["registry_recent"] = f"with {_REGISTRY} select signature, format, confidence, hit_count, updated_at from v order by updated_at desc, signature limit 8"
ORACLES["registry_watchlist"] = f"""
with {_REGISTRY},
w as (select *, list_filter([case when confidence < 0.75 then 'low-confidence mapping' end, case when hit_count >= 10 and confidence < 0.9 then 'high-volume signature needs tuning' end, case when len(keys) <= 1 then 'thin field extraction' end], lambda x: x is not null) as reasons from v)
select signature, format, confidence, hit_count, array_to_string(reasons[1:2], ', ') as reason from w where len(reasons) > 0 order by confidence, hit_count desc, signature limit 8
"""

ORACLES["lookup_synonyms"] = """
select vendor, canonical, count(*) as n from (select ['TEMP', ' ts ', 'wafer_id', 'alarm', 'custom', 'Level', 'p'][event_id % 7 + 1] as vendor, ['temperature', 'timestamp', 'wafer_id', 'alarm_code', null, 'alarm_severity', 'pressure'][event_id % 7 + 1] as canonical from events) group by 1, 2
"""

ORACLES["insert_new_rows"] = """
select o_orderkey, o_custkey, o_orderdate from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as r from orders) where r = 1 and o_custkey % 3 <> 0
"""

ORACLES["upsert_rows"] = """
with n as (select c_custkey + 60 as k from customer where c_custkey % 4 = 0)
select coalesce(c_custkey, k) as c_custkey, case when k is not null then 'NEW' else c_mktsegment end as c_mktsegment, coalesce(c_nationkey, -1)::int as c_nationkey from customer full join n on c_custkey = k
"""

ORACLES["count_hits"] = """
select c_custkey as signature, (5 + (select count(*) from orders where o_custkey = c_custkey))::bigint as hit_count from customer
"""

ORACLES["discover_templates"] = """
with l as (select event_id, upper(event_type) as head, user_id::varchar as u, event_type as t, event_id % 50 = 0 as long from events),
g as (select head, long, count(*) as n, count(distinct u) as users, min(u) as u, min(t) as t, count(distinct event_id) as ids, min(event_id)::varchar as i, min_by(u, event_id) as u1 from l group by 1, 2),
s as (select *, sum(n) over (partition by long) as total from g)
select head || ' user ' || case when n < 2 then u1 when users = 1 then u else '<*>' end || ' did ' || t || case when long then ' extra ' || case when n < 2 or ids = 1 then i else '<*>' end else '' end as template,
  (case when n >= 2 and users > 1 then 1 else 0 end + case when n >= 2 and long and ids > 1 then 1 else 0 end)::int as wildcards from s
"""

ORACLES["match_templates"] = """
select event_id as id, case event_type when 'click' then 't1' else 't2' end as signature, user_id::varchar as who, case when event_type <> 'click' then event_type end as what from events
"""

_TERMS = r"""
d as (select p_partkey as id, lower(p_name || ' ' || p_type || ' ' || p_brand || ' the 12') as line from part),
p as (select id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(line, '\b\d+(\.\d+)?\b', '', 'g'), '\s+'), lambda t: len(t) > 1 and t not in ('the', 'a', 'an', 'is', 'are', 'was', 'were', 'be', 'been', 'being', 'to', 'of', 'in', 'for', 'on', 'with', 'at', 'by', 'from', 'as')), ' ') as line from d),
w as (select id, unnest(regexp_extract_all(line, '[A-Za-z_]\w*')) as term from p),
t as (select id, term, count(*) as tf from w group by 1, 2),
i as (select term, ln((1 + n) / (1.0 + df)) + 1 as idf from (select term, count(*) as df from t group by 1), (select count(*)::double as n from part) where df <= 0.95 * n),
x as (select id, term, (1 + ln(tf)) * idf as x from t join i using (term)),
v as (select id, term, x / sqrt(sum(x * x) over (partition by id)) as w from x)
"""

ORACLES["tfidf_vectors"] = f"with {_TERMS} select id, term, round(w, 6) as w from v"
ORACLES["nearest_lines"] = f"""
with {_TERMS},
c as (select a.id as q, b.id as c, sum(a.w * b.w) as cosine from v a join v b using (term) where a.id % 100 = 0 group by 1, 2),
r as (select q, cosine, row_number() over (partition by q order by cosine desc, c) as rank from c)
select q as id, rank::int as rank, round(cosine, 6) as cosine from r where rank <= 3
"""

ORACLES["semantic_records"] = f"""
with {FACTS},
x as (select *, ((cents % 3000) - 32) * 5 / 9.0::double as t from f)
select event_id::varchar as record_id, 'T' || (event_id % 5) as tool_id, case when t <= 1500 then round(t, 6) end as temperature, case when event_id % 2 = 0 then event_type end as alarm_code, iso as timestamp, message as raw_line,
  case when event_id % 2 = 0 then 'alarm' when t <= 1500 or true then 'sensor' end as log_type, event_type as status, "user"::varchar as wafer_id, null::varchar as lot_id, 0.8::double as mapping_confidence,
  sha256('T' || (event_id % 5) || '|' || iso || '|' || message) as dedup_key, case when event_id % 2 = 1 then event_type end as note,
  'pattern_miss:lot_id' || case when t > 1500 then ',out_of_range:temperature:' || round(t)::bigint else '' end as flags from x
"""

ORACLES["semantic_registry"] = """
select distinct substr(sha256('user <NUM> did ' || event_type), 1, 16) as signature, 'json' as format_type, 3 as n_patterns, 0.8::double as confidence, 0::bigint as hit_count from events
"""

ORACLES["event_windows"] = "select date_trunc('hour', ts) as start, event_type as key, count(*) as n from events group by 1, 2"

#: What the votes are worth: the head of a long XML file has no closing tag, and single odd bytes don't make a file binary.
_DETECTED = {"json": "json", "yaml": "yaml", "binary": "plain_text", "syslog": "plain_text", "logfmt": "logfmt", "csv": "csv", "tsv": "tsv", "key_value": "logfmt", "delimiter": "yaml", "plain_text": "yaml"}
ORACLES["detect_formats"] = f"""
with {FACTS},
x as (select event_id % (select n from files) as file, 10 + sum(len({_LINES['xml']}) + 1) as size from f group by 1)
select unnest({list(_DETECTED)}) as rendered, unnest({list(_DETECTED.values())}) as detected, (select n from files)::bigint as n
union all select 'xml', case when size <= 16384 then 'xml' else 'key_value' end, count(*) from x group by 2
"""

#: By format: records a row, and whether its time and lot are read back. A delimiter row alone is a header; the syslog rows have no version, so they are faulty lines; XML attributes are no timestamp.
_READ_BACK = {"json": (1, 0, 1, 1), "xml": (1, 0, 0, 1), "yaml": (1, 0, 1, 1), "binary": (6, 0, 0, 0), "syslog": (1, 1, 1, 0), "logfmt": (1, 0, 1, 1), "csv": (1, 0, 1, 1), "tsv": (1, 0, 1, 1), "key_value": (1, 0, 1, 1), "delimiter": (0, 0, 0, 0), "plain_text": (1, 0, 1, 0)}
ORACLES["generated_logs"] = f"""
with k as (select unnest(range({len(_READ_BACK)})) as i, unnest({list(_READ_BACK)}) as format, unnest({[list(x) for x in _READ_BACK.values()]}) as t),
n as (select i, format, t, (select count(*) from range(5000) r(x) where x % {len(_READ_BACK)} = i) as files from k)
select format, files, files * t[1] as records, files * t[2] as corrupted, files * t[3] as timed, files * t[4] as lots from n
"""

#: Labels pass from line to line until the least has reached a whole cluster; the clusters of these lines are few steps wide.
ORACLES["cluster_lines"] = f"""
with recursive {_TERMS.strip()},
e as (select a.id as a, b.id as b from v a join v b using (term) group by 1, 2 having sum(a.w * b.w) >= 0.7 or a.id = b.id),
r as (select id, id as root, 0 as i from (select distinct id from v) union all select e.a, min(r.root), r.i + 1 from r join e on r.id = e.b where r.i < 12 group by e.a, r.i),
g as (select root, count(*) as n, min(id) as first from r where i = 12 group by root),
c as (select *, row_number() over (order by root) - 1 as label from g where n > 1)
select label::int as label, n, first from c
union all select -1, lone.n, lone.first from (select (select count(*) from part) - coalesce(sum(n), 0) as n, (select min(p_partkey) from part where p_partkey not in (select id from r join c using (root) where i = 12)) as first from c) lone where lone.n > 0
"""

ORACLES["vendor_documents"] = f"""
with {FACTS}
select event_id as id, ['xml', 'csv', 'tsv', 'yaml', 'keyvalue', 'plaintext'][event_id % 6 + 1] as format, case when event_id % 6 < 5 then "user"::varchar end as who, message as what from f
"""

ORACLES["stage_report"] = f"""
with {_STAGED},
t as (select (count(*) + sum(duplicates))::bigint as total_seen, count(*) filter (where not corrupted) as clean, count(*) filter (where corrupted) as corrupted, sum(duplicates)::bigint as duplicates from s)
select 'totals' as section, unnest(['total_seen', 'clean', 'corrupted', 'duplicates']) as name, unnest([total_seen, clean, corrupted, duplicates]) as n from t
union all select 'level', level, count(*) from s where not corrupted group by 2
union all select 'format', 'key_value', count(*) from s where not corrupted
union all select 'corruption_reason', reason, count(*) from s where corrupted group by 2
"""
ORACLES["stage_errors"] = f"with {FACTS} select 'bad-f' || unnest(range((select n from files))) as source, 'Error' as error"
ORACLES["stage_levels"] = f"""
with {FACTS}
select level, count(*) as n from f where level in ('ERROR', 'WARN') group by 1 union all select 'logfmt', count(*) from f
"""
ORACLES["registry_lookup"] = f"with {_REGISTRY} select signature, len(keys)::int as patterns, case when list_contains(keys, 'tool_id') then 'tool_id' end as tool_id from v where signature = 'sig000123'"
ORACLES["registry_signatures"] = f"with {_REGISTRY} select distinct signature from v"
ORACLES["listing_mappings"] = f"with {_REGISTRY} select signature, case when format <> 'unknown' then format end as format_type, confidence, hit_count from v"
ORACLES["listing_alarms"] = f"with {FACTS} select iso as timestamp, 'T' || (event_id % 5) as tool_id, event_type as alarm_code, null::varchar as alarm_severity, null::varchar as event_description from f where event_id % 2 = 0"
ORACLES["learned_names"] = "select lower(n_name) as vendor_field, case when n_nationkey % 5 = 0 then 'tool_id' else ['temperature', 'pressure', 'voltage'][n_nationkey % 3 + 1] end as canonical_field from nation"
ORACLES["provider_failures"] = "select distinct substr(sha256('user <NUM> did ' || event_type), 1, 16) as signature, 'events' as log_source, 'llm_failed' as error, 2 as attempts from events"
ORACLES["validated_rows"] = """
select event_id::varchar as record_id, concat_ws(',', 'unknown_top_level_field:cents', 'parse_flags_not_list', case when event_id % 7 = 0 then 'mapping_confidence_not_float:high' end, case when event_id % 2 = 1 then 'missing_required:raw_line' end,
  case when event_id % 3 = 0 then 'invalid_log_type:odd' end, case when event_id % 5 = 0 then 'invalid_alarm_severity:loud' end, case when event_id % 7 = 1 then 'mapping_confidence_out_of_range:1.5' end) as errors from events
"""
ORACLES["cluster_representatives"] = """
with l as (select p_partkey as id, (p_size % 7 - 1)::int as label, list_sort(list_distinct(regexp_extract_all(p_name || ' ' || p_type || ' ' || p_brand || ' the 12', '[=:_./\\[\\]{}@#]'))) as marks from part)
select min(id) as id, label from l where label >= 0 group by label, marks union all select id, label from l where label < 0
"""

ORACLES["fn_shown"] = r"""
select p_partkey, regexp_replace(format('{:,.2f}', p_retailprice * 1000), '\.?0+$', '') as number, case when p_size > 3 then regexp_replace(format('{:.1f}', p_size / 1000.0 * 100), '\.?0+$', '') || '%' else '--' end as percent,
  case when p_size % 5 = 0 then '(blank)' when len(repeat(p_brand, p_size % 5)) > 28 then substr(repeat(p_brand, p_size % 5), 1, 27) || '...' else repeat(p_brand, p_size % 5) end as label from part
"""
ORACLES["search_first"] = "select least(1000, count(*)) as shown, count(*) as found from part where p_brand ilike '%brand%' or p_name ilike '%brand%' or p_type ilike '%brand%'"

ORACLES["csv_in_splits"] = """
select event_id::varchar as number, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' as timestamp, case event_type when 'error' then 'ERROR' when 'signup' then 'WARN' when 'purchase' then 'NOTICE' else 'INFO' end as level,
  'user ' || user_id || ' did "' || event_type || '",' || chr(10) || 'then left' as message, floor(value * 100)::bigint::varchar as cents, false as corrupted, true as below_head from events
"""

ORACLES["registry_batches"] = """
select substr(sha256('user <NUM> did ' || event_type), 1, 16) as signature, 'json' as format_type, 3 as n_patterns, case when event_type in ('error', 'signup') then count(*) else 0 end as hit_count from events group by event_type
"""

_DEPTH = "case when {0} > 2 then 2 * (ln({0} - 1) + 0.5772156649015329) - 2 * ({0} - 1) / {0}::double when {0} = 2 then 1.0 else 0.0 end"
#: Trees are grown level by level in one recursion over the sampled rows, then every row walks every tree in another.
ORACLES["anomaly_scores"] = f"""
with recursive p as (select p_partkey::varchar as record_id, [p_size::double, p_retailprice::double, 0.0, 0.0] as x from part where p_size is not null or p_retailprice is not null),
pool as (select * from p order by md5(record_id), record_id limit 25600),
drawn as (select t.tree, x from pool, (select unnest(range(100)) as tree) t qualify row_number() over (partition by t.tree order by md5(t.tree || ':' || record_id), record_id) <= 256),
size as (select least(256, count(*)) as n, ceil(log2(greatest(least(256, count(*)), 2))) as deepest from p),
grown as (
  select tree, 1::bigint as node, 0 as depth, x from drawn
  union all
  select tree, 2 * node + (x[f] > low[f] + share * (high[f] - low[f]))::int, depth + 1, x from (
    select *, spread[1 + pick % len(spread)] as f from (
      select *, ('0x' || substr(h, 1, 8))::bigint as pick, ('0x' || substr(h, 9, 8))::bigint / 4294967296.0::double as share, list_filter([1, 2, 3, 4], lambda i: high[i] > low[i]) as spread from (
        select *, md5('42:' || tree || ':' || node) as h, [min(x[1]) over w, min(x[2]) over w, min(x[3]) over w, min(x[4]) over w] as low, [max(x[1]) over w, max(x[2]) over w, max(x[3]) over w, max(x[4]) over w] as high
        from grown window w as (partition by tree, node)
      )
    ) where len(spread) > 0 and depth < (select deepest from size)
  )
),
bounds as (select tree, node, depth, count(*) as n, md5('42:' || tree || ':' || node) as h, [min(x[1]), min(x[2]), min(x[3]), min(x[4])] as low, [max(x[1]), max(x[2]), max(x[3]), max(x[4])] as high from grown group by tree, node, depth),
nodes as (
  select tree, node, f, low[f] + share * (high[f] - low[f]) as at, depth + {_DEPTH.format('n')} as length from (
    select *, case when depth < (select deepest from size) and len(spread) > 0 then spread[1 + ('0x' || substr(h, 1, 8))::bigint % len(spread)] end as f, ('0x' || substr(h, 9, 8))::bigint / 4294967296.0::double as share
    from (select *, list_filter([1, 2, 3, 4], lambda i: high[i] > low[i]) as spread from bounds)
  )
),
walk as (
  select p.record_id, p.x, n.tree, n.node, n.f, n.at, n.length from p, nodes n where n.node = 1
  union all
  select w.record_id, w.x, n.tree, n.node, n.f, n.at, n.length from walk w join nodes n on n.tree = w.tree and n.node = 2 * w.node + (w.x[w.f] > w.at)::int where w.f is not null
),
scored as (select record_id, greatest(-1.0, -2 * power(2.0, -sum(length) / 100 / (select {_DEPTH.format('n')} from size))) as s from walk where f is null group by record_id)
select record_id, round(s, 6) as anomaly_score, (s < -0.5)::int as flags from scored
"""

ORACLES["page_far"] = """
with o as (select o_custkey, o_orderkey, o_orderpriority, row_number() over (order by o_custkey, o_orderkey) - 1 as place, count(*) over () as total from orders)
select o_custkey, o_orderkey, o_orderpriority, (place // 100)::int as page, total from o where place // 100 in (10, 11)
"""

_GIVEN = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES["catalogue_tables"] = f"""
with r as ({" union all ".join(f"select '{t}' as table_name, count(*) as n_rows from {t}" for t in _GIVEN)}),
c as ({" union all ".join(f"select '{t}' as table_name, count(*)::int as n_columns from (describe {t})" for t in _GIVEN)})
select table_name, 'parquet' as format, n_columns, n_rows from r join c using (table_name)
"""

ORACLES["catalogue_chart"] = "select o_orderpriority as label, round(sum(o_totalprice), 2) as value from orders group by o_orderpriority order by value desc, label limit 25"

# The text columns of the given tables.
_TEXTS = {
    "region": "r_name", "nation": "n_name", "customer": "c_name c_mktsegment", "supplier": "s_name", "part": "p_name p_brand p_type", "orders": "o_orderstatus o_orderpriority", "lineitem": "l_returnflag l_linestatus",
    "events": "event_type props", "documents": "text lang source", "pages": "url html", "benchmark": "text", "conversations": "role text",
}
ORACLES["catalogue_search"] = " union all ".join(f"select '{t}' as table_name, '{c}' as column_name, {c} as value from {t} where contains(lower({c}), 'the')" for t, cs in _TEXTS.items() for c in cs.split())
