"""SQL for the operators that SQL can express, over the same tables."""

from __future__ import annotations

from notegraph.llm.quality_rules import BOILERPLATE

_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


#: crc32 of a text, bit by bit: a byte is xored in, then eight shifts follow.
def _crc32(text: str) -> str:
    bits = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: list_concat([ascii({text}[i])::bigint], [-1, -1, -1, -1, -1, -1, -1, -1]::bigint[])))"
    return f"xor(list_reduce(list_concat([4294967295]::bigint[], {bits}), lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, 3988292384 * (a & 1)) end), 4294967295)"


def _count(chars: str) -> str:
    return f"len(regexp_extract_all(line, '{chars}'))"


#: Base counts from word positions and windows, verdicts from the lines.
LINE_RULES = rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, unnest({_WORDS.format("t")}) as word, generate_subscripts({_WORDS.format("t")}, 1) as p from d),
g as (select doc_id, p, word, lead(word) over v as b, lead(word, 2) over v as c, lead(word, 3) over v as e, lead(word, 4) over v as f from w window v as (partition by doc_id order by p)),
r as (select doc_id, p, count(*) over (partition by doc_id, word, b, c, e, f) as n from g where f is not null),
rep as (select doc_id, count(distinct p + i) as n_repeat_words from r, range(5) s(i) where n > 1 group by doc_id),
cnt as (select doc_id, count(*) as n_words, sum(length(word)) as word_chars from w group by doc_id),
l as (select doc_id, unnest(string_split(t, chr(10))) as line from d),
dup as (select doc_id, count(*) - count(distinct line) as n_dup_lines from l where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
j as (select doc_id, line, len(list_filter(string_split(line, ' '), lambda x: x <> '')) as n, len({_WORDS.format("line")}) as words from l),
fine as (select doc_id, sum(words) as n_clean_words from j where not (
  (not regexp_matches(line, '\p{{Ll}}') and regexp_matches(line, '\p{{Lu}}') and n >= 3)
  or (not regexp_matches(line, '[.!?…。！？]') and regexp_matches(line, '\S') and n >= 8)
  or ({_count("[#*$%&|<>]")} * 2 > n and regexp_matches(line, '[#*$%&|<>»›•!]'))
  or ({_count("[|»›•]")} >= 3 and {_count("[|»›•]")} * 5 > n)
  or (n >= 3 and {_count("!")} * 2 > n)
  or (n <= 20 and regexp_matches(line, '(?i)(?:{"|".join(BOILERPLATE)})'))) group by doc_id),
a as (select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0) as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols,
  coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_clean_words, 0) as n_clean_words
  from d left join cnt using (doc_id) left join dup using (doc_id) left join rep using (doc_id) left join fine using (doc_id))
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
  cast(n_repeat_words as bigint) as n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and 100 * (n_words - n_clean_words) <= 50 * n_words as kept, cast(n_clean_words as bigint) as n_clean_words from a
"""

#: Shingle sets, links of shared shingles, and reachability.
NEAR_DUPLICATES = rf"""
with recursive d as (select doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0) t),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select x.doc_id as a, y.doc_id as b, count(*) as hits from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * hits >= 85 * (x.n + y.n - hits)),
reach(id, r) as (select doc_id, doc_id from documents union select e.b, reach.r from reach join e on e.a = reach.id),
c as (select id, min(r) as component_id from reach group by id)
select d.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, component_id, d.doc_id = component_id as kept from d left join n using (doc_id) join c on d.doc_id = id
"""

#: Runs are islands of equal words q apart, for every period q that occurs
#: between equal words; of one stretch the smallest period counts.
WORD_RUNS = rf"""
with d as materialized (select row_number() over () as k, doc_id, {_WORDS.format("coalesce(text, '')")} as w, {_crc32("coalesce(cast(doc_id as varchar), '')")} as h from documents),
g as (select *, len(w) as n, h // 10 as g from d),
p as (select *, case when n > 0 then g % n end as a from g),
m as materialized (select k, doc_id, n, case when h % 10 = 0 and n > 0 then list_transform(range(0, n), lambda i: case when i < a then w[i + 1] else w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] end) else w end as w from p),
t as materialized (select k, n, unnest(w) as x, generate_subscripts(w, 1) - 1 as i from m),
pairs as (select s.k, s.n, s.i, o.i - s.i as q from t s join t o on s.k = o.k and s.x = o.x and o.i > s.i and o.i - s.i <= s.n // 4),
isl as (select k, q, i, i - row_number() over (partition by k, q order by i) as z from pairs),
runs0 as (select k, q, min(i) as s, count(*) + q as l from isl group by k, q, z having count(*) + q >= greatest(6, 4 * q)),
runs as materialized (select k, s, l, min(q) as q from runs0 group by k, s, l),
best as (select k, s, l, q from (select *, row_number() over (partition by k order by l::hugeint * 1000000000000 // q desc, s, q) as r from runs) where r = 1),
txt as (select k, count(*) as c, string_agg(s || ',' || l || ',' || q || chr(10), '' order by s, q) as u from runs group by k),
gone as (select distinct k, unnest(range(s + q, s + l)) as i from runs),
kept as (select t.k, string_agg(x, ' ' order by t.i) as u from t anti join gone using (k, i) group by t.k)
select doc_id, cast(coalesce(c, 0) as bigint) as n_runs, best.s as start, cast(best.l as bigint) as length, cast(best.q as bigint) as period, cast(1000 * best.l // best.q as bigint) as exponent_milli,
  sha256(coalesce(txt.u, '')) as runs_sha256, sha256(coalesce(kept.u, '')) as collapsed_sha256
from m left join txt using (k) left join best using (k) left join kept using (k)
"""

#: Prefixes as whole lists of turns; subtrees by the rows that pass a node.
PREFIX_TRIE = rf"""
with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos from conversations where conv_id is not null),
c as materialized (select conv_id, conv_id - conv_id % 100 as base, {_crc32("cast(conv_id as varchar)")} % 6 as h from (select distinct conv_id from t)),
b as (select c.conv_id, count(t.pos) as kept from c left join t on t.conv_id = c.base and t.pos <= c.h group by 1),
r as (select c.conv_id, t.pos as depth, role, text from c join t on t.conv_id = c.base and t.pos <= c.h
  union all select c.conv_id, t.pos - c.h + b.kept, role, text from c join b using (conv_id) join t on t.conv_id = c.conv_id and t.pos > c.h),
x as (select conv_id, depth, length(text) as size, list(struct_pack(r := role, t := text)) over (partition by conv_id order by depth) as prefix from r
  union all select conv_id, 0, 0, [] from c),
y as materialized (select conv_id, depth, size, min(conv_id) over (partition by prefix) as node, count(*) over (partition by prefix) as n_convs, max(depth) over (partition by conv_id) as last from x),
n as materialized (select conv_id, depth, size, n_convs from y where conv_id = node),
q as (select n.*, y.node as parent from n left join y on y.conv_id = n.conv_id and y.depth = n.depth - 1),
k as (select parent as conv_id, depth - 1 as depth, count(*) as n_children from q where depth > 0 group by 1, 2),
w as (select q.*, coalesce(n_children, 0) as n_children from q left join k using (conv_id, depth)),
s as (select y.node as conv_id, y.depth, sum(cast(w.n_children = 0 as int)) as n_leaves, sum((w.n_convs - 1) * w.size) as saved from w join y on y.conv_id = w.conv_id and y.depth <= w.depth group by 1, 2),
e as (select node as conv_id, depth, string_agg(conv_id, ',' order by conv_id) as ids from y where depth = last group by 1, 2)
select conv_id, depth, parent as parent_conv_id, n_convs, n_children, cast(n_leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
from w join s using (conv_id, depth) left join e using (conv_id, depth)
"""
