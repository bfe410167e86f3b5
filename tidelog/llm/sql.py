"""SQL for DuckDB of the operators that it can express, over whole tables."""

from __future__ import annotations

from tidelog.llm import licences

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5 = rf"""with recursive w as (select doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select doc_id, unnest(case when len(ws) >= 5 then list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
o as (select a.doc_id as a, b.doc_id as b, count(*) as o from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from o join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * o >= 80 * (na.n + nb.n - o)),
e as (select a, b from l union all select b, a from l),
r(doc_id, root) as (select doc_id, doc_id from documents union select e.b, r.root from r join e on e.a = r.doc_id where r.root < e.b)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.component_id from documents d left join n using (doc_id) join (select doc_id, min(root) as component_id from r group by doc_id) m using (doc_id)"""

OP1 = r"""with b as (select doc_id, encode(coalesce(text, '')) as b from documents),
h as (select doc_id, hex(b) as h, octet_length(b) as n from b),
w as (select doc_id, p, substr(h, 2 * p + 1, 100) as g from (select doc_id, h, unnest(range(0, n - 49)) as p from h where n >= 50)),
least as (select g, min(doc_id) as low from w group by g),
hit as (select w.doc_id, p from w join least using (g) where low < w.doc_id),
x as (select doc_id, p, coalesce(p - lag(p) over (partition by doc_id order by p) > 50, true) as fresh from hit),
y as (select doc_id, p, sum(fresh::int) over (partition by doc_id order by p) as run from x),
spans as (select doc_id, min(p) as a, max(p) + 50 as z from y group by doc_id, run),
gaps as (select doc_id, a, z, coalesce(lag(z) over (partition by doc_id order by a), 0) as before from spans),
kept as (select doc_id, count(*) as n_spans, sum(z - a) as n_removed, max(z) as last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) as head from gaps join h using (doc_id) group by doc_id)
select h.doc_id, n as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans,
sha256(unhex(case when kept.doc_id is null then h else head || substr(h, 2 * last + 1) end)) as kept_sha256 from h left join kept using (doc_id)"""


def op7() -> str:
    rows = []
    for name, wording in licences.TEMPLATES.items():
        words, span = licences._words(wording), licences.span_of(wording)
        shingles = ", ".join("'" + " ".join(s) + "'" for s in licences._shingles(words))
        rows.append(f"('{name}', {span}, [{shingles}])")
    return rf"""with t(license, span, wanted) as (values {", ".join(rows)}),
w as (select doc_id, regexp_extract_all({_LOWER}, '[0-9a-z]+') as ws from documents where text is not null),
c as (select doc_id, span, pos, ws[pos + 1:pos + 2 * span] as ws from (select doc_id, ws, span, unnest(range(0, greatest(len(ws), 1), span)) as pos from w, (select distinct span from t))),
s as (select doc_id, span, pos, case when len(ws) = 0 then [] else list_distinct(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' '))) end as shingles from c),
m as (select doc_id, license, pos, cast(len(list_intersect(shingles, wanted)) as double) / len(wanted) as containment from s join t using (span) where list_has_any(shingles, wanted))
select doc_id, license, max(containment) as containment, min(pos) as first_word, count(distinct pos) as windows from m where containment >= {licences.CONTAINMENT} group by 1, 2"""


OP7 = op7()
