"""SQL of the queries that SQL can express."""

from __future__ import annotations

from . import rules

LINES = r"""
with l as (select r, doc_id, unnest(range(1, len(lines) + 1)) i, unnest(lines) line
           from (select row_number() over () r, doc_id, string_split(coalesce(text, ''), chr(10)) lines from documents)),
k as (select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') key from l),
often as (select key from k where length(key) >= 1 group by key having count(distinct r) >= 10)
select any_value(doc_id) doc_id, count(*)::bigint n_lines, count(often.key)::bigint n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where often.key is null), '')) kept_sha256
from k left join often using (key) group by r
"""

TOPK = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
s as (select q.vec_id query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint score
      from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as "rank" from s)
select query_id, "rank"::int as "rank", vec_id, score from r where "rank" <= 20
"""

FILL_IN_MIDDLE = """
with d as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') u,
                  sha256('1:' || coalesce(doc_id::varchar, '')) h from documents),
e as (select *, len(u) n, ('0x' || h[1:8])::bigint h1, ('0x' || h[9:16])::bigint h2, ('0x' || h[17:24])::bigint h3, ('0x' || h[25:32])::bigint h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b,
             case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
                  when h4 % 100 < 20 then 'spm' else 'psm' end form from e),
p as (select *, array_to_string(u[1:a], '') x, array_to_string(u[a + 1:b], '') y, array_to_string(u[b + 1:], '') z from c)
select doc_id, n, form, case when form <> 'plain' then length(x) end prefix_chars, case when form <> 'plain' then length(y) end middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || x || '<S>' || z || '<M>' || y else '<S>' || z || '<P>' || x || '<M>' || y end) output_sha256,
       sha256(t) restored_sha256
from p
"""

PHRASES = r"""
with d as (select coalesce(lang, 'und') lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') w from (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) piece from d)),
g as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) phrase
      from w, (select unnest([1, 2, 3, 4]) k)),
f as (select lang, k m, phrase, count(*) f from g group by all having count(*) >= 30),
t as (select lang, sum(len(w)) n from w group by lang),
s as (select *, string_split(phrase, ' ') p from f where m > 1),
k as (select *, unnest(range(1, m)) k from s),
c as (select k.lang, k.phrase, k.f a, k.k, l.f l, r.f r, (2000000::hugeint * k.f) // (l.f + r.f) score
      from k join f l on l.lang = k.lang and l.phrase = array_to_string(p[1:k.k], ' ')
             join f r on r.lang = k.lang and r.phrase = array_to_string(p[k.k + 1:], ' ')),
b as (select * from c qualify row_number() over (partition by lang, phrase order by score, k) = 1),
i as (select lang, array_to_string(p[i:i + z - 1], ' ') phrase, max(f) longer
      from (select *, unnest(range(1, m - z + 2)) i from (select *, unnest(range(2, m)) z from s where m > 2)) group by all)
select b.lang, row_number() over (partition by b.lang order by score desc, a desc, b.phrase) as "rank", b.phrase, a, l, r, n::bigint n, score::bigint score
from b join t using (lang) left join i on i.lang = b.lang and i.phrase = b.phrase
where longer is null or 100 * longer < 80 * a
qualify "rank" <= 2000
"""

SQL = {
    "op3_host_rules": rules.SQL,
    "op9_line_dedup": LINES,
    "op10_exact_topk": TOPK,
    "op11_fill_in_middle": FILL_IN_MIDDLE,
    "op13_phrases": PHRASES,
}
