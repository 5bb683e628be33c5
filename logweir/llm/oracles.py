"""DuckDB SQL for the queries that SQL can express."""

WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

OP1 = rf"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as k from documents where doc_id is not null and text <> ''),
w as (select *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n from l),
e as (select doc_id, line, k, coalesce(lead(k) over d - 1, 1000000000) as until, n, row_number() over d as e, sum(n) over d as upto from w where n > 0 window d as (partition by doc_id order by k)),
x as (select a.doc_id, a.e as a, min(b.e) as b from e a join e b on a.doc_id = b.doc_id and b.e between a.e and a.e + 49 and b.upto - a.upto + a.n >= 50 group by 1, 2
  union select b.doc_id, max(a.e), b.e from e a join e b on a.doc_id = b.doc_id and b.e between a.e and a.e + 49 and b.upto - a.upto + a.n >= 50 group by b.doc_id, b.e),
r as (select x.doc_id, x.a, x.b, min(e.k) as start, max(e.until) as stop, string_agg(e.line, chr(10) order by e.e) as body from x join e on e.doc_id = x.doc_id and e.e between x.a and x.b group by 1, 2, 3),
f as (select *, first_value(doc_id) over o as first_doc, first_value(stop) over o as first_stop from r window o as (partition by body order by doc_id, start)),
g as (select distinct w.doc_id, w.k from w join f on w.doc_id = f.doc_id and w.k between f.start and f.stop where f.doc_id > f.first_doc or f.start > f.first_stop),
t as (select w.doc_id, string_agg(w.line, chr(10) order by w.k) filter (where g.k is null) as text, count(g.k) as n_removed, string_agg(g.k::varchar, ',' order by g.k) as removed from w left join g on w.doc_id = g.doc_id and w.k = g.k group by 1)
select d.doc_id, case when d.text is null then 0 else len(string_split(d.text, chr(10))) end as n_lines, coalesce(n_removed, 0) as n_removed, coalesce(removed, '') as removed,
  sha256(case when n_removed > 0 then coalesce(t.text, '') else d.text end) as text_sha256
from documents d left join t on d.doc_id = t.doc_id
"""

OP5 = """
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and embedding is not null
  and list_sum(list_transform(embedding, lambda x: case when x is null or not isfinite(x) then 1 else 0 end)) = 0 and list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
p as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
r as (select vec_id as a, vec_id as b from embeddings union select r.a, p.b from r join p on r.b = p.a),
c as (select a as vec_id, min(b) as component_id from r group by 1),
n as (select a as vec_id, count(*) as n from p group by 1)
select e.vec_id, coalesce(n.n, 0) as n_links, c.component_id, e.vec_id = c.component_id as kept from embeddings e join c using (vec_id) left join n using (vec_id)
"""

_SECOND = "('ac.uk', 'co.uk', 'gov.uk', 'org.uk', 'com.au', 'org.au', 'co.jp', 'co.nz', 'com.br', 'co.in', 'co.za')"
_MEANS = "(a / (a + b))"


def _level(table: str) -> str:
    """a and b of each row's beta posterior, given n, k and the parent's mean m."""
    return f"""(select *, (1 / rho - 1) * m + k as a, (1 / rho - 1) * (1 - m) + n - k as b from {table}, (
  select case when coalesce(sum(n * m * (1 - m) * (n - 1)), 0) = 0 then 0.1
    else least(0.9, greatest(0.001, sum((k - n * m) ** 2 - n * m * (1 - m)) / sum(n * m * (1 - m) * (n - 1)))) end::double as rho from {table} where n > 0))"""


OP4 = f"""
with l as (select doc_id, count(*) as n, count(*) filter (where quality = 1 and coalesce(toxic, 0) = 0) as k from labels where quality is not null group by 1),
u as (select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path from pages),
h as (select host, coalesce(sum(n), 0)::bigint as n, coalesce(sum(k), 0)::bigint as k from (select distinct page_id, host from u) left join l on page_id = doc_id group by 1),
s as (select *, string_split(host, '.') as parts, case when regexp_matches(parts[-1], '^[0-9]*$') then '' when array_to_string(parts[-2:], '.') in {_SECOND} then array_to_string(parts[-2:], '.') else parts[-1] end as suffix from h),
d as (select host, n, k, suffix, case when suffix = '' then host else array_to_string(parts[-(len(string_split(suffix, '.')) + 1):], '.') end as domain from s),
g as (select (sum(k) + 0.5) / (sum(n) + 1) as m0 from d),
ls as (select suffix, sum(n) as n, sum(k) as k, any_value(m0) as m from d, g group by 1),
ls2 as {_level("ls")},
ld as (select domain, sum(d.n) as n, sum(d.k) as k, any_value({_MEANS}) as m from d join ls2 using (suffix) group by domain, suffix),
ld2 as {_level("ld")},
lh as (select host, d.n, d.k, {_MEANS} as m from d join ld2 using (domain)),
lh2 as {_level("lh")},
b as (select host, n, k, {_MEANS} - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) as bound from lh2),
r as (select page_id, u.host, path, n, k, bound,
  case when (u.host = 'example.org' or u.host like '%.example.org') and starts_with(path, '/en/1') then 'example.org/en/1'
    when (u.host = 'example.org' or u.host like '%.example.org') and starts_with(path, '/es/') then 'example.org/es/'
    when (u.host = 'com' or u.host like '%.com') and starts_with(path, '/fr/') then 'com/fr/'
    when (u.host = 'com' or u.host like '%.com') and starts_with(path, '/de/') then 'com/de/'
    when (u.host = 'org' or u.host like '%.org') and starts_with(path, '/') then 'org/' end as rule
  from u join b on u.host = b.host)
select page_id, host, path, rule, case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block' when bound >= 0.5 then 'allow' else 'block' end as verdict,
  n as labelled, k as good, round(bound, 6) as bound
from r
"""

OP7 = rf"""
with recursive d as (select doc_id, source, {WORDS}::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source is null, encode(source)) - 1 as k from d group by source),
t as (select source, source_size, [3, 1, 2][(k % 3 + 1)::int] as w, source_size * 2.0::double as most from s),
b as (select 1.5::double * sum(source_size) as budget from t),
-- at the level where the budget is spent, sources with the least most / w are at their cap
o as (select t.*, coalesce(sum(most) over (order by most / w, source rows between unbounded preceding and 1 preceding), 0) as below,
  sum(w) over (order by most / w, source rows between current row and unbounded following) as rest from t),
c as (select min_by(below, most / w) as spent, min_by(rest, most / w) as rest from (
  select o.*, b.budget from o, b where (b.budget - below) / rest < most / w)),
x as (select t.source, source_size, case when c.spent is null or ((b.budget - c.spent) / c.rest) * w >= most then most else (b.budget - c.spent) * w / c.rest end as target from t, b, c),
r as (select d.doc_id, d.size, x.source_size, x.target, case when x.source_size > 0 then least(x.target / x.source_size, 2.0) else 0 end as rate
  from d join x on d.source is not distinct from x.source)
select doc_id, size, source_size, target,
  (floor(rate)::bigint + case when ('0x' || substr(md5('7:' || doc_id), 1, 13))::bigint::double / 4503599627370496.0 < rate - floor(rate) then 1 else 0 end) * size as taken
from r
"""

OP10 = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""



def _op13(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Lloyd's rounds unrolled: c0, then a1 (nearest entry and distance in one number), c1, a2 and so on."""
    steps = [
        f"""with v as (select vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings
  where embedding is not null and list_sum(list_transform(embedding, lambda x: case when x is null or not isfinite(x) then 1 else 0 end)) = 0),
p as materialized (select vec_id, label, k, e[k * (len(e) // {parts}) + 1 : (k + 1) * (len(e) // {parts})] as x from v, range({parts}) t(k)),
c0 as materialized (select k, n - 1 as entry, x as c from (select *, row_number() over (partition by k order by vec_id) as n from p) where n <= {entries})"""
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} as materialized (select vec_id, label, p.k, any_value(x) as x, min((list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c))::bigint * {entries} + entry) as best
  from p join c{r} on p.k = c{r}.k group by 1, 2, 3)"""
        )
        if r < rounds:
            steps.append(
                f"""m{r} as (select k, best % {entries} as entry, count(*) as n, j, sum(x[j]::bigint)::bigint as s from a{r}, range(1, 1 + (select len(x) from p limit 1)) t(j) group by 1, 2, 4),
n{r} as (select k, entry, list(((s - ((s % n) + n) % n) // n)::double order by j) as c from m{r} group by 1, 2),
c{r + 1} as materialized (select k, entry, coalesce(n{r}.c, c{r}.c) as c from c{r} left join n{r} using (k, entry))"""
            )
    last = f"a{rounds}"
    return (
        ", ".join(steps)
        + f""",
w as (select vec_id, any_value(label) as label, string_agg(lpad(lower(to_hex(best % {entries})), 2, '0'), '' order by k) as code, sum(best // {entries})::bigint as error from {last} group by vec_id),
h as (select sha256(string_agg(list_aggregate(list_transform(c, lambda x: x::bigint), 'string_agg', ','), ',' order by k, entry)) as codebooks_sha256 from c{rounds})
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from w, h"""
    )


ORACLES = {"op1_line_dedup": OP1, "op4_url_filter": OP4, "op5_hnsw": OP5, "op7_mixing": OP7, "op10_exact_dedup": OP10, "op13_vector_codes": _op13()}
