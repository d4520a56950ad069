"""DuckDB SQL of the queries that SQL can express; each states the contract anew, not the operator's plan."""

from __future__ import annotations

from . import quality_rules as rules

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def quality_rules() -> str:
    k = len(rules.RULES)
    pattern = "0"
    for _, bad, good in rules.RULES:
        pattern = f"({pattern}) * 3 + (case when {bad} then 0 when {good} then 2 else 1 end)"
    share, bad, good = rules.START
    listed = f"range(0, {k})"
    term = "(case p.v[j + 1] when 0 then ln(good[j + 1] / bad[j + 1]) when 2 then ln((1 - good[j + 1]) / (1 - bad[j + 1])) else 0 end)"
    post = f"1 / (1 + exp(-(ln(share / (1 - share)) + list_sum(list_transform({listed}, lambda j: {term})))))"
    rate = lambda w: f"(coalesce(list_sum([{w} for p in ps if p.v[j + 1] = 0]), 0) + {rules.SMOOTH}) / (coalesce(list_sum([{w} for p in ps if p.v[j + 1] <> 1]), 0) + {2 * rules.SMOOTH})"
    return rf"""
with recursive w as materialized (select doc_id, coalesce(text, '') as text, {_WORDS} as ws from documents),
g as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as t from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, t) as n from g) where n > 1),
covered as (select doc_id, count(distinct i + d) as n from twice, (select unnest([0, 1, 2]) as d) group by doc_id),
lines as (select doc_id, count(*) as n, count(distinct x) as kinds from (select doc_id, unnest(string_split(text, chr(10))) as x from w) where regexp_matches(x, '[^\x20\x09-\x0D]') group by doc_id),
f as materialized (select w.doc_id, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
 (length(text) - length(translate(text, '{rules.SYMBOLS}', '')))::bigint as n_symbols, coalesce(lines.n - lines.kinds, 0)::bigint as n_dup_lines,
 coalesce(covered.n, 0)::bigint as n_repeat_words, coalesce(lines.n, 0)::bigint as n_lines, length(regexp_replace(text, '[^A-Z]+', '', 'g'))::bigint as n_upper,
 length(regexp_replace(text, '[\x00-\x60\x7B-\x7F]+', '', 'g'))::bigint as n_lower, length(regexp_replace(text, '[^!]+', '', 'g'))::bigint as n_exclaims,
 length(regexp_replace(text, '[^|]+', '', 'g'))::bigint as n_bars, length(regexp_replace(text, '[^.]+', '', 'g'))::bigint as n_stops
 from w left join lines using (doc_id) left join covered using (doc_id)),
voted as materialized (select *, case when n_words > 0 then {pattern} end as pattern from f),
ps as (select list({{'pattern': pattern, 'n': n, 'v': [pattern // (3 ** ({k - 1} - j))::bigint % 3 for j in {listed}]}} order by pattern) as ps
 from (select pattern, count(*)::double as n from voted where pattern is not null group by pattern)),
em as (select 0 as round, {share}::double as share, [{bad}::double for j in {listed}] as bad, [{good}::double for j in {listed}] as good
 union all
 select round + 1, (coalesce(list_sum([p.g for p in ps]), 0) + {rules.SMOOTH}) / (coalesce(list_sum([p.n for p in ps]), 0) + {2 * rules.SMOOTH}),
 [{rate('p.n - p.g')} for j in {listed}], [{rate('p.g')} for j in {listed}]
 from (select round, [{{'n': p.n, 'v': p.v, 'g': p.n * ({post})}} for p in x.ps] as ps from em, ps x where round < {rules.ROUNDS})),
known as (select p.pattern as pattern, {post} as p_quality from (select unnest(x.ps) as p, share, bad, good from em, ps x where round = {rules.ROUNDS}))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
 not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and coalesce(p_quality >= 0.5, false) as kept
from voted left join known using (pattern)"""


def source_mixing() -> str:
    return rf"""
with d as (select doc_id, source, len({_WORDS})::bigint as size, ('0x' || substr(md5(coalesce(doc_id::varchar, '') || '|' || coalesce(text, '')), 1, 10))::bigint as h from documents),
s as (select source, sum(size)::bigint as source_size, [3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1] as w from d group by source),
r as (select *, (select sum(source_size)::double * 150 / 100.0 from s) as budget,
 coalesce(sum(2 * source_size) over (order by 2 * source_size / w::double, source nulls last rows between unbounded preceding and 1 preceding), 0)::double as spent,
 (select sum(w) from s)::double - coalesce(sum(w) over (order by 2 * source_size / w::double, source nulls last rows between unbounded preceding and 1 preceding), 0)::double as rest from s),
l as (select max((budget - spent) / rest) as level from r where (budget - spent) / rest * w <= 2 * source_size),
t as (select source, source_size, least(coalesce(l.level * w, 2.0::double * source_size), 2.0::double * source_size) as target from r, l),
g as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole from t),
n as (select *, target - whole * source_size as need from g),
b as (select source, h, sum(size)::bigint as size, coalesce(sum(sum(size)) over (partition by source order by h rows between unbounded preceding and 1 preceding), 0)::bigint as under from d group by source, h),
m as (select b.source, max_by(struct_pack(h := h, under := under, size := b.size), h) as x from b join n on b.source is not distinct from n.source where under <= need group by b.source),
p as (select n.*, case when need > 0 then case when 2 * (need - x.under) >= x.size then x.h + 1 else x.h end else 0 end as lim from n left join m on n.source is not distinct from m.source)
select doc_id, d.size, source_size, target, size * (whole + (whole < 2 and h < lim)::bigint) as taken from d join p on d.source is not distinct from p.source"""


def url_filters(events) -> str:
    rows = ", ".join(f"('{k}', date '{d}', {str(x).lower()})" for k, d, x in events)
    return rf"""
with e as (select lower(split_part(key, '/', 1)) || substr(key, length(split_part(key, '/', 1)) + 1) as key, day, bool_and(listed) as listed from (values {rows}) t(key, day, listed) group by all),
c as (select *, coalesce(lag(listed) over (partition by key order by day), false) as before from e),
v as (select key, day as since, listed, lead(day) over (partition by key order by day) as until from c where listed <> before),
p as (select page_id, url, date '2024-01-01' + (page_id % 365)::int as fetched, lower(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '')) as host,
 regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1) as path from pages),
m as (select p.*, (select list(struct_pack(n := -length(v.key), key := v.key, since := v.since) order by -length(v.key), v.key) from v where listed and p.fetched >= v.since and (v.until is null or p.fetched < v.until)
 and (case when contains(v.key, '/') then starts_with(regexp_replace(p.host || path, '/+', '/', 'g') || '/', v.key || '/') else p.host = v.key or ends_with(p.host, '.' || v.key) end)) as found from p)
select page_id, url, fetched::varchar as fetched, host, coalesce(len(found), 0)::bigint as n_active, found is not null as blocked, found[1].key as entry, found[1].since::varchar as listed_on from m"""


def near_duplicates(percent: int = 85) -> str:
    return rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as materialized (select distinct doc_id, shingle from (select doc_id, array_to_string(ws[i : i + 4], ' ') as shingle from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from w)
 union all select doc_id, array_to_string(ws, ' ') from w where len(ws) between 1 and 4)),
n as (select w.doc_id, count(s.shingle)::bigint as n from w left join s using (doc_id) group by w.doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by all),
l as materialized (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= {percent} * (x.n + y.n - shared)),
r as (select a, b from l union select r.a, l.b from r join l on r.b = l.a)
select doc_id, n as n_shingles, least(doc_id, coalesce(least_b, doc_id)) as component_id, doc_id = least(doc_id, coalesce(least_b, doc_id)) as kept
from n left join (select a, min(b) as least_b from r group by a) m on m.a = n.doc_id"""


def source_divergence() -> str:
    return r"""
with d as (select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
w as (select i, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
k as materialized (select lang, term, count(*) as n from w group by all having count(distinct i) >= 10),
g as materialized (select distinct lang, source from d),
c as materialized (select lang, source, term, count(*) as n from w group by all),
t as materialized (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, k.n as lang_n from g join k on k.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
s as (select lang, source, sum(n) as total, sum(lang_n) as lang_total, count(*) as v from t group by all),
p as materialized (select lang, source, term, n, (1 + 1000000000::hugeint * (n + 2) // (total + 2 * v)::hugeint)::bigint as p, (1 + 1000000000::hugeint * (lang_n + 2) // (lang_total + 2 * v)::hugeint)::bigint as q from t join s using (lang, source)),
x as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::bigint as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(x.value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join x on x.lang = a.lang and x.source = a.source and x.item = b.source),
terms as (select lang, source, 'term' as part, term as item, (p - q) * (p - q) // (p + q) as value from p where n > 0 and p > q)
select *, row_number() over (partition by lang, source order by value desc, item)::int as rank from pairs
union all
select * from (select *, row_number() over (partition by lang, source order by value desc, item)::int as rank from terms) where rank <= 10"""


def prefix_trie() -> str:
    words = r"len(regexp_extract_all({}, '[^\x20\x09-\x0D]+'))"
    # eight steps a byte: the byte itself, then nothing
    crc = "xor(list_reduce(list_prepend(4294967295::ubigint, flatten([[ascii(x)::ubigint, 0, 0, 0, 0, 0, 0, 0] for x in string_split(conv_id::varchar, '')])), lambda a, x: xor(xor(a, x) >> 1, 3988292384::ubigint * (xor(a, x) & 1))), 4294967295::ubigint)"
    return f"""
with o as (select conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) order by turn nulls first, sha256(length(coalesce(role, '')) || ' ' || coalesce(role, '') || coalesce(text, ''))) as turns from conversations where conv_id is not null group by conv_id),
c as (select *, ({crc} % 4)::bigint as h from o),
r as materialized (select c.conv_id, coalesce(b.turns, [])[:c.h] || c.turns[c.h + 1:] as turns from c left join o b on b.conv_id = c.conv_id - c.conv_id % 20),
p as materialized (select conv_id, len(turns) as n, unnest(range(0, len(turns) + 1)) as depth, turns from r),
q as materialized (select conv_id, n, depth, turns[:depth] as path from p),
m as materialized (select path, any_value(depth)::bigint as depth, min(conv_id) as conv_id, count(*) as n_convs, coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where depth = n), '') as ends from q group by path),
k as (select path[:depth - 1] as path, count(*) as n_children from m where depth > 0 group by 1),
w as materialized (select m.*, coalesce(k.n_children, 0)::bigint as n_children, case when m.depth > 0 then (n_convs - 1) * {words.format("m.path[m.depth].text")} else 0 end as saved from m left join k on k.path = m.path),
u as (select path[:d] as path, saved, n_children from (select path, saved, n_children, unnest(range(0, depth + 1)) as d from w)),
t as (select path, sum(saved)::bigint as saved_tokens, count(*) filter (where n_children = 0) as n_leaves from u group by path)
select w.conv_id, w.depth, a.conv_id as parent_conv_id, w.n_convs, w.n_children, t.n_leaves, t.saved_tokens, sha256(w.ends) as ends_sha256
from w join t on t.path = w.path left join w a on w.depth > 0 and a.path = w.path[:w.depth - 1]"""
