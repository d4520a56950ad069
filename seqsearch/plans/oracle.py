"""DuckDB SQL of the catalogue's queries."""

from __future__ import annotations

from ..functions.matrix import blosum62
from ..functions.scoring import K as EK
from ..functions.scoring import LAMBDA, LN2
from .catalogue import INCLUDE, VOLUME, _PAIRS
from .catalogue import K as SEED

_CLEAN = "upper(regexp_replace(coalesce({}, ''), '[^A-Za-z]', '', 'g'))"
_Q = f"q as (select item_id as q_id, {_CLEAN.format('text')} as q_seq, length({_CLEAN.format('text')}) as q_len from benchmark)"
_S = f"s as (select doc_id as s_id, {_CLEAN.format('text')} as s_seq, length({_CLEAN.format('text')}) as s_len from documents)"


def _kmers(name: str, of: str, id_col: str, seq: str, k: int, keep: str = "", seeds: bool = True) -> str:
    keep = keep and f", {keep}"
    rule = f"where kmer <> repeat(kmer[1], {k})" if seeds else ""
    return f"{name} as (select * from (select {id_col}{keep}, pos, substring({seq}, pos + 1, {k}) as kmer from (select {id_col}{keep}, {seq}, cast(unnest(range(0, length({seq}) - {k} + 1)) as int) as pos from {of})) {rule})"


_HITS = f"{_Q}, {_S}, {_kmers('qk', 'q', 'q_id', 'q_seq', SEED, 'q_len')}, {_kmers('sk', 's', 's_id', 's_seq', SEED)}, h as (select q_id, q_len, s_id, (q_len::bigint + sk.pos - qk.pos) // 8 as bin from qk join sk using (kmer))"
_VOTES = f"{_HITS}, v as (select q_id, q_len, s_id, bin, count(*) as votes from h group by all)"


_CANDS = f"{_VOTES}, c as (select * from v where votes >= floor(log10(q_len::double) + 1.0::double + 5 - {SEED})::bigint + 1)"


#: Volumes one after the other: each row continues the one before it, or begins the next volume.
_LAID = f"""recursive {_S}, l as materialized (select s_id, s_len::bigint as s_len, coalesce(sum(s_len + 1) over (order by s_id rows between unbounded preceding and 1 preceding), 0)::bigint as s_offset, row_number() over (order by s_id) as i from s),
g as (select 0::bigint as i, 0::bigint as ptr, 0::bigint as volume union all
 select l.i, case when ptr + s_len >= {VOLUME} then 0 else ptr end + s_len + 1, volume + (ptr + s_len >= {VOLUME})::bigint from g join l on l.i = g.i + 1),
v as materialized (select s_id, s_len, s_offset, l.i, volume // 16 as part, volume % 16 as stream from l join g using (i)),
d as (select part, stream, count(*) as n_seqs, sum(s_len)::bigint as residues, sum(s_len + 1)::bigint as slots from v group by all)"""


#: Statistics of an alignment in one number: columns, mismatches, positives, gaps, gap openings; where each begins.
_FIELDS = {"align_length": (0, 13), "mismatch": (13, 13), "positive": (26, 13), "gaps": (39, 11), "gap_open": (50, 11)}


def _filled(band: int = 8, ways: bool = False, counts: bool = False, cands: str = "") -> str:
    """The recurrence as a recursive query over all candidates: a step for each query residue, columns for each offset of the
    band. ``using key`` holds the last step of each candidate only; with ``ways`` also all steps' ways back, two bits a cell,
    eight hexadecimal digits a step; with ``counts`` instead each cell's begin and statistics of its way, carried forward."""
    width = 2 * band
    cells = range(1, width + 1)
    matrix = "[" + ", ".join(f"{int(x)}::smallint" for x in blosum62().ravel()) + "]"
    each = lambda text: ", ".join(text.format(o=o, next=o + 1, last=o - 1) for o in cells)
    inside = lambda text: f"(case when w{{o}} >= 0 then greatest({text}, 0) else 0 end)::smallint"
    edge = lambda name, o, text: text.format(o=o, next=o + 1, last=o - 1) + f" as {name}{o}"
    m = each(inside("h{o} + mx.m[qc * 26 + w{o} + 1]") + " as nm{o}")
    x = ", ".join(edge("nx", o, inside("x{next} - 1, m{next} - 11") if o < width else "0::smallint") for o in cells)
    y = ", ".join(edge("ny", o, inside("ny{last} - 1, nm{last} - 11") if o > 1 else "0::smallint") for o in cells)
    window = ", ".join(f"s{o + 1} as w{o}" for o in range(1, width)) + f", (ascii(substring(piece, i + {width}, 1)) - 65)::smallint as w{width}"
    first = "case " + " ".join(f"when nh{o} = top then {o}" for o in cells) + " end"
    start = ", ".join(f"(case when {o} > 1 then ascii(substring(piece, {o} - 1, 1)) - 65 else -1 end)::smallint as s{o}" for o in cells)
    state = ", ".join(each(f"{c}{{o}}") for c in "smxh")
    way = " + ".join(f"((case when nh{o} = 0 then 0 when nh{o} = nm{o} then 3 when nh{o} = ny{o} then 2 else 1 end)::bigint << {2 * o - 2})" for o in cells)
    kept = (", ways", ", ''", f", ways || lpad(to_hex({way}), 8, '0')") if ways else ("", "", "")
    one = {name: 1 << at for name, (at, _) in _FIELDS.items()}
    gap = one["align_length"] + one["mismatch"] + one["gaps"]
    step = f"{one['align_length']}::bigint + (qc <> w{{o}})::bigint * {one['mismatch']} + p{{o}} * {one['positive']}"
    cell = "(case when nh{o} = 0 then 0 when nh{o} = nm{o} then 3 when nh{o} = ny{o} then 2 else 1 end)::tinyint as nd{o}, "
    cell += "(case nd{o} when 0 then 0 when 3 then case when h{o} > 0 then a{o} else i * 32 + {o} end when 2 then {left_a} else {top_a} end)::int as na{o}, "
    cell += f"(case nd{{o}} when 0 then 0 when 3 then case when h{{o}} > 0 then b{{o}} else 0 end + {step} when 2 then {{left_b}} else {{top_b}} end)::bigint as nb{{o}}"
    inner = lambda o: {"left_a": f"na{o - 1}" if o > 1 else "0", "left_b": f"nb{o - 1} + {gap} + (nd{o - 1} <> 2)::bigint * {one['gap_open']}" if o > 1 else "0"}
    outer = lambda o: {"top_a": f"a{o + 1}" if o < width else "0", "top_b": f"b{o + 1} + {gap} + (d{o + 1} <> 1)::bigint * {one['gap_open']}" if o < width else "0"}
    told = ", ".join(cell.format(o=o, **inner(o), **outer(o)) for o in cells)
    if counts:
        pick = lambda c: "case o " + " ".join(f"when {o} then n{c}{o}" for o in cells) + " end"
        state += f", best_a, best_b, {each('d{o}')}, {each('a{o}')}, {each('b{o}')}"
        nothing = ", ".join(each(f"0::{kind}") for kind in ("tinyint", "int", "bigint"))
        kept = ("", f", 0::int, 0::bigint, {nothing}", f", case when better then {pick('a')} else best_a end, case when better then {pick('b')} else best_b end, {each('nd{o}')}, {each('na{o}')}, {each('nb{o}')}")
    more = f", {told}" if counts else ""
    good = ", " + each("coalesce(mx.m[qc * 26 + w{o} + 1] > 0, false)::bigint as p{o}") if counts else ""
    begin = f"(8 * bin + 3 - q_len + 1 - {band})"
    return f"""
with recursive {cands or _CANDS},
t as materialized (select *, repeat('!', greatest(-first, 0)::int) || substring(s_seq, greatest(first, 0)::int + 1, greatest(q_len + {width} + least(first, 0), 0)::int) || repeat('!', (q_len + {width})::int) as piece
 from (select row_number() over () as k, c.q_id, c.s_id, bin, q_seq, q.q_len, s_seq, s_len, {begin.replace('q_len', 'q.q_len')} as first from c join q using (q_id) join s using (s_id))),
mx as (select {matrix} as m),
r(k, i, best, best_i, best_o, {state}{kept[0]}) using key (k) as (
 select k, 0, 0, 0, 0, {start}, {", ".join(each("0::smallint") for _ in range(3))}{kept[1]} from t
 union
 select k, i + 1, case when better then top::int else best end, case when better then i else best_i end, case when better then o else best_o end, {each("w{o}")}, {each("nm{o}")}, {each("nx{o}")}, {each("nh{o}")}{kept[2]}
 from (select *, top > best or (top = best and top > 0 and (2 * i + o < 2 * best_i + best_o or (2 * i + o = 2 * best_i + best_o and o > best_o))) as better
 from (select *, {first} as o from (select *, greatest({each("nh{o}")}) as top{more} from (select *, {each("greatest(nm{o}, nx{o}, ny{o}) as nh{o}")}
 from (select *, {y} from (select *, {x}, {m}{good}
 from (select r.*, {window}, ascii(substring(q_seq, i + 1, 1)) - 65 as qc from r join (select k, q_seq, q_len, piece from t) t using (k) where i < q_len) z, mx)))))))
"""


def _banded() -> str:
    return _filled() + "select q_id, s_id, bin, best::bigint as score, best_i::bigint as q_end, (first + best_i + best_o - 1)::bigint as s_end from r join t using (k) where best > 0"


def _ranked(where: str = "", cands: str = "", names: str = "select doc_id as s_id, 'doc' || doc_id || ' ' || source as s_name from documents", counts: bool = True) -> str:
    """``z``: all alignments that are reported, ranked, with statistics (if ``counts``) and without aligned strings, so that no
    way has to be traced back."""
    told = ", ".join(f"(best_b >> {at} & {(1 << bits) - 1})::int as {name}" for name, (at, bits) in _FIELDS.items())
    told = f", (best_a // 32)::int as q_begin, best_i::int as q_end, (first + best_a // 32 + best_a % 32 - 1)::int as s_begin, (first + best_i + best_o - 1)::int as s_end, {told}" if counts else ""
    extra = ", (1 - mismatch / align_length::double) * 100 as p_identity, align_length - mismatch as n_identity, substring(s_seq, s_begin + 1, s_end - s_begin + 1) as s_ori" if counts else ""
    return f"""{_filled(counts=counts, cands=cands)},
e as (select t.q_id, t.s_id, t.bin, c.votes, t.q_len, t.s_len, t.s_seq, best::int as score{told} from r join t using (k) join c on t.q_id = c.q_id and t.s_id = c.s_id and t.bin = c.bin where best > 0),
n as (select sum(s_len + 1)::double as n from s),
f as (select *{extra}, floor(({LAMBDA}::double * score - ln({EK}::double)) / {LN2}::double)::int as bitscore from e),
z as materialized (select *, row_number() over (partition by q_id order by evalue, score desc, s_id, bin)::int as rank, 'item' || q_id || ' benchmark' as q_name
 from (select f.*, n * q_len * pow(2.0::double, -bitscore) as evalue from f, n) join ({names}) using (s_id) where evalue <= 10{where})
"""


def _aligned(where: str = "") -> str:
    """Adds ``a``: the alignments of all candidates, traced back step by step, with strings, statistics, scores and names;
    ``z``: those of them that are reported, ranked."""
    q, s = "string_split(q_aln, '')", "string_split(s_aln, '')"
    good = "x.q between 'A' and 'Z' and x.s between 'A' and 'Z' and mx.m[(ascii(x.q) - 65) * 26 + ascii(x.s) - 64] > 0"
    opens = lambda text: f"len(regexp_extract_all({text}, '-+'))"
    return f"""{_filled(ways=True)},
b(k, a, o, q_begin, s_begin, q_aln, s_aln) using key (k) as (
 select k, best_i, best_o, best_i, 0::bigint, '', '' from r where best > 0
 union
 select k, case when way = 2 then a else a - 1 end, case way when 1 then o + 1 when 2 then o - 1 else o end, a, first + a + o - 1,
  case when way = 2 then '-' else substring(q_seq, a + 1, 1) end || q_aln, case when way = 1 then '-' else substring(piece, a + o, 1) end || s_aln
 from (select b.*, first, q_seq, piece, (('0x' || substring(ways, 8 * a + 1, 8))::bigint >> (2 * o - 2)) & 3 as way from b join (select k, first, q_seq, piece, ways from t join r using (k)) t using (k) where a >= 0 and o between 1 and 16) where way > 0),
e as (select t.q_id, t.s_id, t.bin, votes, t.q_len, t.s_len, best::int as score, length(q_aln)::int as align_length, q_begin::int as q_begin, best_i::int as q_end, s_begin::int as s_begin, (first + best_i + best_o - 1)::int as s_end,
  q_aln, s_aln, replace(s_aln, '-', '') as s_ori, list_zip({q}, {s}) as pairs from b join r using (k) join t using (k) join c on t.q_id = c.q_id and t.s_id = c.s_id and t.bin = c.bin),
f as (select e.* exclude (pairs), len([1 for x in pairs if x[1] <> x[2]])::int as mismatch, [struct_pack(q := x[1], s := x[2]) for x in pairs] as pairs from e),
a as (select f.* exclude (pairs), (1 - mismatch / align_length::double) * 100 as p_identity, align_length - mismatch as n_identity, len([1 for x in pairs if {good}])::int as positive,
  ({opens("q_aln")} + {opens("s_aln")})::int as gap_open, (len(regexp_extract_all(q_aln, '-')) + len(regexp_extract_all(s_aln, '-')))::int as gaps,
  array_to_string([case when x.q = x.s then x.q when {good} then '+' else ' ' end for x in pairs], '') as match, floor(({LAMBDA}::double * score - ln({EK}::double)) / {LN2}::double)::int as bitscore from f, mx),
n as (select sum(s_len + 1)::double as n from s),
z as (select *, row_number() over (partition by q_id order by evalue, score desc, s_id, bin)::int as rank, 'item' || q_id || ' benchmark' as q_name, 'doc' || s_id || ' ' || source as s_name
 from (select a.*, n * q_len * pow(2.0::double, -bitscore) as evalue from a, n) join (select doc_id as s_id, source from documents) using (s_id) where evalue <= 10{where})
"""


def _line(text: str) -> str:
    return f"{_aligned()} select q_id, rank, {text} as line from z"


def _plain_line(text: str, counts: bool = True) -> str:
    return f"{_ranked(counts=counts)} select q_id, rank, {text} as line from z"


def _tabbed(*columns: str) -> str:
    return " || ".join(f"({c})::varchar || chr(9)" for c in columns)


def _six(column: str) -> str:
    return f"format('{{:.6g}}', ({column})::double)"


_IDS = "split_part(q_name, ' ', 1)", "split_part(s_name, ' ', 1)"


def _two_stores() -> str:
    """Documents and turns of conversations as two databases, each in an order of ids of its own; three hits a query."""
    every = f"select doc_id * 2 as s_id, text from documents union all select (conv_id * 1000 + turn) * 2 + 1, text from conversations"
    both = _CANDS.replace(_S, f"s as (select s_id, {_CLEAN.format('text')} as s_seq, length({_CLEAN.format('text')}) as s_len from ({every}))")
    return f"{_ranked(cands=both, names='select s_id, 0 as s_name from s', counts=False)} select q_id, (s_id % 2)::int as db, s_id // 2 as s_id, bin, votes, score, evalue, rank from z where rank <= 3"


def oracle_sql() -> dict[str, str]:
    expression, times = INCLUDE[0]
    count = lambda text: f"len(regexp_extract_all({text}, '{expression}'))"
    window = "substring(s_seq, (greatest(8 * bin + 3 - 8 - q.q_len, 0))::int + 1, (greatest(least(8 * bin + 3 + 8, s_len) - greatest(8 * bin + 3 - 8 - q.q_len, 0), 0))::int)"
    window_of, ori = window.replace("q.q_len", "q_len"), "s_ori"
    parts = f"p as (select p_partkey as s_id, {_CLEAN.format('p_name')} as s_seq from part)"
    grid = ", ".join(f"floor(log10(q_len::double) + {p + 5 - k}::double)::bigint as k{k}_p{p}" for k in (3, 4, 5) for p in (0, 1, 2))
    pairs = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(_PAIRS))
    gaps = lambda e: f"(len(regexp_extract_all(q_aln, '{e}')) + len(regexp_extract_all(s_aln, '{e}')))::int"
    differ = "len([1 for i in range(1, length(q_aln) + 1) if q_aln[i] <> s_aln[i]])::int"
    return {
        "seq_normalize": f"with {_S} select s_id, s_seq, s_len::bigint as s_len from s",
        "fasta_records": """
with r as (select conv_id, turn, 'c' || conv_id || ' ' || role as name, string_split(translate(text, ' ', '-'), chr(10)) as lines from conversations),
e as (select *, list_position([x = '' or starts_with(x, '#') for x in lines], true) as n from r),
b as (select conv_id, turn, name, array_to_string(lines[:case when n > 0 then n - 1 else len(lines) end], '') as raw from e)
select conv_id, turn, name, upper(regexp_replace(replace(raw, '-', ''), '[^A-Za-z]', '*', 'g')) as seq from b where name <> '' and not contains(raw, ' ')""",
        "fasta_files": """
with r as (select 'doc' || doc_id || ' of the table' as name, string_split(regexp_replace(translate(text, ' ', '-'), '[\n>]+', chr(10), 'g'), chr(10)) as lines from documents where text is not null),
e as (select *, list_position([x = '' or starts_with(x, '#') for x in lines], true) as n from r),
b as (select name, array_to_string(lines[:case when n > 0 then n - 1 else len(lines) end], '') as raw from e),
s as (select name, upper(regexp_replace(replace(raw, '-', ''), '[^A-Za-z]', '*', 'g')) as seq from b where not contains(raw, ' '))
select name, md5(seq) as seq, length(seq)::bigint as s_len from s""",
        "kmer_explode": f"with {_Q}, {_kmers('k', 'q', 'q_id', 'q_seq', SEED, seeds=False)} select q_id, pos, kmer from k",
        "kmer_homopolymer_filter": f"with {_Q}, {_kmers('k', 'q', 'q_id', 'q_seq', 3)} select q_id, pos, kmer from k",
        "kmer_code": f"with {_Q}, {_kmers('k', 'q', 'q_id', 'q_seq', SEED, seeds=False)} select distinct kmer, ({' + '.join(f'(ascii(kmer[{i + 1}]) - 65)::bigint * {32**i}' for i in range(SEED))})::bigint as code from k",
        "kmer_index_stats": f"with {_Q}, {_kmers('k', 'q', 'q_id', 'q_seq', SEED)} select count(*) as distinct_kmers, max(n) as max_places from (select kmer, count(*) as n from k group by kmer)",
        "short_sequences": f"with {parts} select s_id, length(s_seq)::int as s_len, greatest(length(s_seq) - {SEED} + 1, 0)::bigint as n_kmers from p",
        "seed_join": f"with {_HITS} select q_id, count(*) as hits from h group by q_id",
        "diag_votes": f"with {_VOTES} select q_id, count(*) as bins, sum(votes)::bigint as votes, max(votes) as most, sum(bin * votes)::bigint as weighted from v group by q_id",
        "vote_filter": f"with {_CANDS} select q_id, s_id, bin, votes from c",
        "volume_layout": f"with {_LAID} select s_id, s_len, s_offset, part, stream from v",
        "db_stats": f"with {_LAID} select * from d",
        "search_space": f"with {_LAID} select sum(slots)::bigint as slots, sum(32 * (slots // 32 + 1))::bigint as padded from d",
        "position_to_subject": f"with {_LAID}, x as (select s_offset + unnest(list_distinct([0, s_len // 2, greatest(s_len - 1, 0), s_len])) as pos from l) select pos, s_id, pos - s_offset as s_pos from x asof join l on pos >= s_offset",
        "volume_rebalance": f"""with {_LAID}, z as (select max(part) as part from d), y as (select (sum(32 * (slots // 32 + 2))::bigint - 1) // 16 + 1 as share from d where part = (select part from z)),
x as materialized (select *, row_number() over (order by i) as k from v where part = (select part from z)),
e as (select 0::bigint as k, 0::bigint as ptr, 0::bigint as stream, 0::bigint as own union all
 select x.k, case when ptr + s_len + 1 >= share then 0 else ptr + s_len + 1 end, e.stream + (ptr + s_len + 1 >= share)::bigint, e.stream from e join x on x.k = e.k + 1, y)
select v.s_id, v.s_offset, v.part, coalesce(e.own, v.stream) as stream from v left join x using (i) left join e on e.k = x.k""",
        "store_roundtrip": f"with {_LAID} select s_id, 'doc' || s_id as name, md5(s_seq) as seq, v.s_len, s_offset, part, stream from v join s using (s_id)",
        "must_include_window": f"with {_CANDS} select c.q_id, c.s_id, bin, votes from c join q using (q_id) join s using (s_id) where {count(window)} >= {times}",
        "must_include_count": f"with {_S} select s_id, {count('s_seq')}::bigint as n, {count('s_seq')} >= {times} as enough from s",
        # a repeat of an anchored expression is its concatenation; no expression ends with what it looked ahead to
        "must_include_restart": f"with {_S} select s_id, (regexp_matches(s_seq, '^[A-Z]{{2}}[EHT]')::int + regexp_matches(s_seq, '^([A-Z]{{2}}[EHT]){{2}}')::int + regexp_matches(s_seq, '^([A-Z]{{2}}[EHT]){{3}}')::int)::bigint as anchored, 3::bigint as empty, least(len([1 for x in list_zip(a, a[2:], a[3:]) if x[1] = 'E' and coalesce(x[2] = 'R' or x[3] = 'R', false)]), 3)::bigint as ahead from (select *, string_split(s_seq, '') as a from s)",
        "bitscore_evalue": f"with g as (select unnest(range(0, 500)) as score), b as (select score, 100 as q_len, floor(({LAMBDA}::double * score - ln({EK}::double)) / {LN2}::double)::int as bitscore from g) select score, q_len, bitscore, 1000000::double * q_len * pow(2.0::double, -bitscore) as evalue from b",
        "threshold_grid": f"select q_len, {grid} from (select unnest(range(1, 2000)) as q_len)",
        "topn_per_query": f"with {_CANDS} select * from (select q_id, s_id, bin, votes, row_number() over (partition by q_id order by votes desc, s_id, bin)::int as rank from c) where rank <= 3",
        "multi_db_union": " union all ".join(f"select '{t}' as db, count(*) as n_seqs, sum(length({_CLEAN.format(c)}))::bigint as residues from {t}" for t, c in (("documents", "text"), ("conversations", "text"), ("pages", "html"))),
        "id_extract": "select doc_id as s_id, 'doc' || doc_id as name from documents",
        "banded_sw_score": _banded(),
        "gap_stats": f"{_aligned()} select count(*) as hits, sum(gaps)::bigint as gaps, sum(gap_open)::bigint as gap_opens, sum(mismatch)::bigint as mismatches, sum(positive)::bigint as positives from a",
        "search_hits": f"{_aligned(' and score >= 40')} select q_id, s_id, bin, votes, q_len, s_len, score, align_length, p_identity, n_identity, mismatch, positive, gap_open, gaps, q_begin, q_end, s_begin, s_end, q_aln, s_aln, s_ori, match, bitscore, evalue, rank, q_name, s_name from z",
        "search_m8": _plain_line(_tabbed(*_IDS, _six("p_identity"), "align_length", "mismatch", "gap_open", "q_begin", "q_end", "s_begin", "s_end", _six("evalue"), "score")),
        "search_extended": _plain_line(_tabbed(*_IDS[::-1], "q_name", _six("evalue"), "bitscore", "score", "align_length", _six("p_identity"), "n_identity", "mismatch", "positive", "gap_open", "gaps", _six("positive / align_length::double * 100"), _six("(s_end - s_begin) / s_len::double * 100"), "s_ori")),
        "search_reduced": _plain_line(_tabbed(*_IDS, _six("evalue"), "score", "bitscore"), counts=False),
        "search_must_include": f"{_ranked(f' and {count(window_of)} >= {times} and {count(ori)} >= {times}')} select q_id, s_id, bin, score, s_ori, rank from z",
        "search_two_stores": _two_stores(),
        "identity_stats": f"select id, {gaps('-')} as gaps, {gaps('-+')} as gap_open, {differ} as mismatch, (length(q_aln) - {differ})::int as identity from (values {pairs}) t(id, q_aln, s_aln)",
    }


def layout_sql() -> dict[str, str]:
    """The layouts that tests hold against SQL over the smallest tables only, as each has to align all candidates again."""
    rows = "list_zip(string_split(q_aln, ''), string_split(s_aln, ''))"
    a3m = f"'>' || s_name || chr(10) || repeat('-', q_begin) || array_to_string([case when x[1] <> '-' then x[2] when x[2] = '*' then 'J' else lower(x[2]) end for x in {rows}], '') || repeat('-', q_len - q_end - 1)"
    pair = f"chr(10) || 'Score = ' || score || chr(9) || 'E-value = ' || {_six('evalue')} || chr(10) || s_name || chr(10) || 'S: ' || s_begin || chr(9) || s_aln || chr(10) || '     ' || chr(9) || match || chr(10) || 'Q: ' || q_begin || chr(9) || q_aln"
    head = "'=========================' || chr(10) || chr(10) || 'Query ' || q_id || ': item' || q_id || ' benchmark #' || q_seq || '#'"
    return {
        "search_fasta": _line("'>' || s_name || chr(10) || s_ori"),
        "search_a3m": _line(a3m) + " union all select q_id, 0, '>item' || q_id || ' benchmark' || chr(10) || q_seq from q",
        "search_pairwise": _line(pair) + f" union all select q_id, 0, {head} from q",
    }
