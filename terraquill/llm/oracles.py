"""SQL for DuckDB of the corpus queries that SQL can express, over whole tables."""

from __future__ import annotations

from terraquill.llm.url_filter import BLOCK_AT, DAMPING, ROUNDS, RULES

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SOURCE_AUDIT = f"""
with d as materialized (
  select row_number() over () as rid, {_LOWER.format("coalesce(text, '')")} as text, coalesce(lang, '') as lang, coalesce(source, '') as source
  from documents),
t as (select rid, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
c as materialized (select lang, source, term, count(*) as n, count(distinct rid) as docs from t group by all),
k as materialized (select lang, term, sum(n) as n from c group by all having sum(docs) >= 30),
v as (select lang, count(*) as v, sum(n) as total from k group by lang),
g as (select distinct lang, source from d),
h as materialized (select c.lang, c.source, c.term, c.n from c join k using (lang, term)),
gt as (select g.lang, g.source, coalesce(sum(h.n), 0) as total from g left join h using (lang, source) group by all),
p as materialized (
  select gt.lang, gt.source, k.term, coalesce(h.n, 0) as n,
    1 + (1000000000::hugeint * (coalesce(h.n, 0) + 5)) // (gt.total + 5 * v.v)::hugeint as p,
    1 + (1000000000::hugeint * (k.n + 5)) // (v.total + 5 * v.v)::hugeint as q
  from gt join k on gt.lang = k.lang join v on v.lang = gt.lang left join h on h.lang = gt.lang and h.source = gt.source and h.term = k.term),
pairs as (
  select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
alls as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source
  union all
  select lang, source, 'term', term, (p - q)::bigint from p where n > 0 and p > q)
select * from (
  select lang, source, part, item, value, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from alls)
where part = 'pair' or rank <= 50
"""


_WORDS = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x20\\x09-\\x0D]+')"

DECONTAMINATION = f"""
with i as (select item_id, {_WORDS} as w from benchmark),
ig as materialized (
  select item_id, k, n, unnest(list_distinct(list_transform(range(len(w) - k + 1), lambda j: array_to_string(w[j + 1 : j + k], ' ')))) as g
  from (select row_number() over () as n, item_id, w, least(5, len(w)) as k from i where len(w) > 0)),
d as (select row_number() over () as m, doc_id, {_WORDS} as w from documents),
dg as materialized (
  select m, doc_id, k, unnest(list_distinct(list_transform(range(greatest(0, len(w) - k + 1)), lambda j: array_to_string(w[j + 1 : j + k], ' ')))) as g
  from d cross join (select distinct k from ig)),
s as (select n, count(*) as n_item from ig group by n),
c as (select m, doc_id, n, item_id, count(*) as n_shared from dg join ig using (k, g) group by all)
select doc_id, item_id, n_shared, n_item, n_shared / n_item as containment from c join s using (n) where n_shared >= 0.75 * n_item
"""

NEAR_DUPLICATES = f"""
with recursive d as (select doc_id, {_WORDS} as w from documents),
g as materialized (
  select doc_id, list_distinct(list_transform(range(greatest(1, len(w) - 4)), lambda j: array_to_string(w[j + 1 : j + 5], ' '))) as s from d where len(w) > 0),
u as materialized (select doc_id, len(s) as n, unnest(s) as x from g),
c as (select a.doc_id as a, b.doc_id as b, a.n as an, b.n as bn, count(*) as met from u a join u b on a.x = b.x and a.doc_id < b.doc_id
  and 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) group by all),
e as materialized (select a, b from c where 100 * met >= 75 * (an + bn - met)),
l as materialized (select a, b from e union all select b, a from e),
r as (select a, b from l union select r.a, l.b from r join l on r.b = l.a),
m as (select a as doc_id, min(b) as low from r group by a)
select d.doc_id, coalesce(len(g.s), 0) as n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) as component_id,
  d.doc_id = least(d.doc_id, coalesce(low, d.doc_id)) as kept
from d left join g using (doc_id) left join m using (doc_id)
"""


def url_filter() -> str:
    """The rules, and the rounds of the link graph one after the other."""
    rules = ", ".join(f"('{v}', '{r}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}')" for v, r in RULES)
    named = r"""(?:://|["''=\x09-\x0D\x20]//|@)([^/?#"''<>@&;,()\x09-\x0D\x20]+)"""
    rounds = ", ".join(
        f"""s{k} as materialized (
  select n.host, {1 - DAMPING} * n.allowed + {DAMPING} * coalesce(f.t, 0) as t, {1 - DAMPING} + {DAMPING} * coalesce(f.r, 0) as r,
    case when n.links then {1 - DAMPING} * n.blocked + {DAMPING} * coalesce(b.d, 0) else n.blocked end as d
  from nodes n
  left join (select dst, sum(w * t) as t, sum(w * r) as r from walk join s{k - 1} on src = host group by dst) f on f.dst = n.host
  left join (select src, sum(w * d) as d from walk join s{k - 1} on dst = host group by src) b on b.src = n.host)"""
        for k in range(1, ROUNDS + 1)
    )
    return f"""
with rules (r_verdict, rule, r_host, r_path) as (values {rules}),
u as (select page_id, html, url, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest0 from pages),
u2 as (select *, split_part(split_part(rest0, '#', 1), '?', 1) as rest from u),
u3 as materialized (
  select row_number() over () as rid, page_id, html, coalesce({_LOWER.format("split_part(rest, '/', 1)")}, '') as host,
    coalesce(substr(rest, length(split_part(rest, '/', 1)) + 1), '') as path from u2),
fits as (
  select rid, rule, r_verdict, row_number() over (partition by rid order by length(rule) desc, r_verdict <> 'block', rule) as k
  from u3 join rules on (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path)),
judged as materialized (select u3.*, rule, r_verdict from u3 left join fits on u3.rid = fits.rid and k = 1),
seeds as (
  select host, avg(case when r_verdict = 'allow' then 1.0::double else 0.0 end) as allowed, avg(case when r_verdict = 'block' then 1.0::double else 0.0 end) as blocked
  from judged where host <> '' group by host),
links as (
  select host as src, unnest(list_distinct(list_transform(regexp_extract_all(html, '{named}', 1), lambda h: rtrim({_LOWER.format("h")}, '.')))) as dst from u3),
edges as (select src, dst, count(*) as n from links where src <> '' and dst like '%.%' and src <> dst group by all),
walk as materialized (select src, dst, n / sum(n) over (partition by src) as w from edges),
named as (select host, bool_or(links) as links from (select src as host, true as links from walk union all select dst, false from walk) group by host),
nodes as materialized (
  select coalesce(named.host, seeds.host) as host, coalesce(links, false) as links, coalesce(allowed, 0) as allowed, coalesce(blocked, 0) as blocked
  from named full join seeds on named.host = seeds.host),
s0 as (select host, allowed as t, 1.0::double as r, blocked as d from nodes),
{rounds}
select page_id, judged.host, path, rule,
  coalesce(r_verdict, case when round(d, 6) >= {BLOCK_AT} and round(d, 6) > round(t / r, 6) then 'block' else 'allow' end) as verdict
from judged left join s{ROUNDS} s on s.host = judged.host
"""
