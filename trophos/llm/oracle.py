"""DuckDB twins of the queries that SQL can express, in formulations of their own."""

from trophos.llm.licenses import LINK, NAMES, NOTICES, RULES, SENTENCES, SHORTENED, SLOTS, SPDX, SUBJECTS, TAG, TAGGED, TRIGGER

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _values(rows) -> str:
    quoted = lambda v: str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return ", ".join(f"({', '.join(map(quoted, row))})" for row in rows)


def licences() -> str:
    names = _values((n, alias) for n, aliases in NAMES.items() for alias in aliases)
    return rf"""
with names(licence, alias) as (values {names}),
notices(notice) as (values {_values((n,) for n in NOTICES)}),
subjects(subject) as (values {_values((s,) for s in SUBJECTS)}),
known as (
  select subject || replace(notice, '{{}}', alias) as s, 'notice:' || licence as identifier
  from names, notices, subjects
  union all select * from (values {_values((t, n) for n, t in SENTENCES.items())})
  union all select * from (values {_values((TAGGED + " " + n.lower().replace("-", " "), "notice:" + n) for n in SPDX)})),
rules(licence, ids) as (values {_values((n, ' ' + ' '.join(ids) + ' ') for n, ids in RULES)}),
cut as (
  select doc_id, unnest(list_zip(s, range(len(s))), recursive := true)
  from (select doc_id, regexp_split_to_array(
          regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '{SHORTENED}', '\1\2', 'g'), '{TAG}', chr(1) || '{TAGGED} \1' || chr(1), 'g'), '([.!?;:])[\x20\x09-\x0D]+', '\1' || chr(1), 'g'),
          '\x01|\n[\x20\x09-\x0D]*\n') as s from documents)),
sentences(doc_id, sentence, i) as (select * from cut),
norm as (
  select doc_id, i, 0 as line, sentence, {_normal('sentence')} as s from sentences),
whole as (select doc_id, i, line, identifier from norm join known using (s)),
lines as (
  select doc_id, i, unnest(range(1, len(l) + 1)) as line, unnest(l) as sentence
  from (select doc_id, i, string_split(sentence, chr(10)) as l from norm
        where (doc_id, i) not in (select doc_id, i from whole))),
found as (
  select * from whole
  union all
  select doc_id, i, line, identifier from (select doc_id, i, line, {_normal('sentence')} as s from lines) join known using (s)),
parted as (
  select doc_id, i, line, identifier from found
  union all
  select doc_id, i, 0, '?' from norm n
  where regexp_matches(sentence, '{TRIGGER}') and not regexp_matches(sentence, '{LINK}')
    and not exists (select 1 from found f where f.doc_id = n.doc_id and f.i = n.i)),
chains as (
  select doc_id, count(*) filter (where identifier <> '?') as n_found, string_agg(identifier, ' ' order by i, line) as chain,
         string_agg(identifier, ' ' order by i, line) filter (where identifier <> '?') as identifiers
  from parted group by doc_id),
matching as (
  select doc_id, r.licence, r.ids from chains c join rules r on n_found > 0 and contains(' ' || c.chain || ' ', r.ids)),
own as (
  select distinct doc_id, licence from matching m where not exists (
    select 1 from matching o where o.doc_id = m.doc_id and len(o.ids) > len(m.ids) and contains(o.ids, m.ids))),
named as (select doc_id, string_agg(licence, ' ' order by licence) as licences from own group by doc_id)
select d.doc_id, coalesce(n_found, 0) as n_found, coalesce(identifiers, '') as identifiers, coalesce(licences, '') as licences
from documents d left join chains using (doc_id) left join named using (doc_id)"""


def _normal(column: str) -> str:
    plain = f"trim(regexp_replace({LOWER.format(column)}, '[^a-z0-9.+]+', ' ', 'g'), ' .')"
    for pattern, stands_for in SLOTS:
        plain = f"regexp_replace({plain}, '{pattern}', '{stands_for}')"
    return plain


LINE_QUALITY = rf"""
with w as (
  select doc_id, coalesce(text, '') as text, {WORDS.format("coalesce(text, '')")} as ws from documents),
windows as (
  select doc_id, unnest(list_transform(range(1, len(ws) - 1),
           lambda i: struct_pack(i := i, g := ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2])), recursive := true) from w),
twice as (select doc_id, i from windows qualify count(*) over (partition by doc_id, g) > 1),
covered as (
  select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from twice) group by doc_id),
line as (
  select doc_id, line, {WORDS.format("line")} as ws
  from (select doc_id, unnest(string_split(text, chr(10))) as line from w)),
judged as (
  select doc_id, line, len(ws) as n,
    len(list_filter(ws, lambda x: regexp_full_match(x, '[|>»›•·/\-]+'))) as menu,
    len(list_filter(ws, lambda x: regexp_matches(x, '([#*$%&|<>~^_=+]{{2,}}|!{{2,}})$'))) as marked,
    len(list_filter(ws, lambda x: regexp_matches(x, '[.!?:;,…。！？"''”’»)\]]$'))) as ended,
    regexp_matches(line, '(?i)\b(lorem ipsum|javascript|cookies?|all rights reserved|terms of (use|service)|privacy policy|sign (in|up)|log ?in|subscribe|click here|read more|share this|back to top)\b') as furniture
  from line where len(ws) > 0),
lines as (
  select doc_id, count(*) - count(distinct line) as n_dup_lines,
    sum(n) filter (where not ((menu >= 2 and menu * 5 >= n) or marked * 10 > n * 3
                              or (n <= 12 and furniture) or (n >= 8 and ended = 0))) as kept_words
  from judged group by doc_id),
counts as (
  select w.doc_id, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
    coalesce(c.n, 0)::bigint as n_repeat_words, coalesce(kept_words, 0)::bigint as kept_words
  from w left join lines using (doc_id) left join covered c using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, kept_words,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * kept_words >= 50 * n_words as kept
from counts"""

NEAR_DUPLICATES = rf"""
with recursive w as (
  select doc_id, {WORDS.format(LOWER.format("coalesce(text, '')"))} as ws from documents),
s as (
  select distinct doc_id, unnest(case when len(ws) > 1
    then list_transform(range(1, len(ws)), lambda i: ws[i] || chr(10) || ws[i + 1])
    when len(ws) = 1 then ws else []::varchar[] end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
sized as (select s.doc_id, g, n from s join n using (doc_id)),
common as (
  select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as k
  from sized a join sized b on a.g = b.g and a.doc_id < b.doc_id and least(a.n, b.n) * 100 >= 80 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id),
linked as (select a, b from common where 100 * k >= 80 * (na + nb - k)),
edges as (select a, b from linked union all select b, a from linked),
reach as (
  select doc_id, doc_id as other from n
  union
  select r.doc_id, e.b from reach r join edges e on e.a = r.other),
least_id as (select doc_id, min(other) as c from reach group by doc_id)
select d.doc_id, coalesce(n, 0) as n_shingles, coalesce(c, d.doc_id) as component_id, coalesce(c, d.doc_id) = d.doc_id as kept
from documents d left join n using (doc_id) left join least_id using (doc_id)"""

# The checksum is worked out bit by bit; prefixes are told apart by the list of their turns' hashes.
PREFIX_TRIE = """
with own as (
  select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as i,
         coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null),
heads as (
  select c, xor(list_reduce(
           list_concat([4294967295::ubigint], list_transform(range(1, length(c::varchar) + 1), lambda k: ascii(substr(c::varchar, k, 1))::ubigint)),
           lambda x, y: list_reduce(list_concat([xor(x, y)], range(8)::ubigint[]), lambda v, s: xor(v >> 1, 3988292384::ubigint * (v & 1)))),
         4294967295::ubigint) % 6 as h
  from (select distinct c from own)),
rebuilt as (
  select h.c, o.i as place, o.role, o.text from heads h join own o on o.c = h.c - h.c % 100 and o.i <= h.h
  union all
  select h.c, 1000000 + o.i, o.role, o.text from heads h join own o on o.c = h.c and o.i > h.h),
numbered as (
  select c, row_number() over (partition by c order by place) as d, text, sha256(role || chr(0) || text) as t from rebuilt),
lengths as (select h.c, count(n.d) as n from heads h left join numbered n using (c) group by h.c),
members as (
  select c, 0 as d, 'root' as node, null as above, 0 as chars from heads
  union all
  select n.c, n.d, sha256((select string_agg(m.t, ',' order by m.d) from numbered m where m.c = n.c and m.d <= n.d)),
         case when n.d = 1 then 'root'
              else sha256((select string_agg(m.t, ',' order by m.d) from numbered m where m.c = n.c and m.d < n.d)) end,
         length(n.text)
  from numbered n),
nodes as (
  select node, any_value(above) as above, min(m.c) as conv_id, min(m.d) as depth, count(*) as n_convs,
         (count(*) - 1) * min(chars) as own,
         sha256(coalesce(string_agg(m.c::varchar, ',' order by m.c) filter (where m.d = l.n), '')) as ends_sha256
  from members m join lengths l using (c) group by node),
children as (select above as node, count(*) as n from nodes where above is not null group by above),
-- each node's ancestors, itself among them, lie on its smallest member's way
below as (
  select a.node, n.node as lower, n.own, not exists (select 1 from children k where k.node = n.node) as leaf
  from nodes n join members a on a.c = n.conv_id and a.d <= n.depth),
sums as (select node, sum(own)::bigint as saved_tokens, count(*) filter (where leaf) as n_leaves from below group by node)
select n.conv_id, n.depth::bigint as depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(k.n, 0) as n_children,
       s.n_leaves, s.saved_tokens, n.ends_sha256
from nodes n join sums s using (node) left join nodes p on p.node = n.above left join children k on k.node = n.node"""

COLLOCATIONS = rf"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex({LOWER.format('text')}, '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
words as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') as ws from pieces),
grams as (
  select lang, unnest(list_concat(
    list_transform(range(1, len(ws) + 1), lambda i: ws[i : i]),
    list_transform(range(1, len(ws)), lambda i: ws[i : i + 1]),
    list_transform(range(1, len(ws) - 1), lambda i: ws[i : i + 2]))) as g
  from words),
f as (select lang, g, count(*) as n from grams group by lang, g),
totals as (select lang, sum(n)::bigint as n from f where len(g) = 1 group by lang),
candidates as (select lang, g, n as a from f where len(g) > 1 and n >= 10),
within as (
  select lang, part, max(a) as a from (
    select lang, unnest([g[1 : 2], g[2 : 3]]) as part, a from candidates where len(g) = 3) group by lang, part),
kept as (
  select c.* from candidates c left join within w on w.lang = c.lang and w.part = c.g
  where len(c.g) = 3 or w.a is null or 100 * w.a < 50 * c.a),
cuts as (
  select k.lang, k.g, k.a, cut, x.n as l, y.n as r,
         (1000000::hugeint * k.a * k.a) // (x.n::hugeint * y.n) as score
  from (select *, unnest(range(1, len(g))) as cut from kept) k
  join f x on x.lang = k.lang and x.g = k.g[1 : cut]
  join f y on y.lang = k.lang and y.g = k.g[cut + 1 : len(k.g)]),
lowest as (
  select lang, array_to_string(g, ' ') as phrase, a, l, r, score from cuts
  qualify row_number() over (partition by lang, g order by score, cut) = 1)
select o.lang, row_number() over (partition by o.lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, t.n,
       score::bigint as score
from lowest o join totals t on t.lang = o.lang
qualify row_number() over (partition by o.lang order by score desc, a desc, phrase) <= 2000"""

ORACLE_SQL = {
    "op2_licences": licences(),
    "op4_line_quality": LINE_QUALITY,
    "op5_near_duplicates": NEAR_DUPLICATES,
    "op12_prefix_trie": PREFIX_TRIE,
    "op13_collocations": COLLOCATIONS,
}
