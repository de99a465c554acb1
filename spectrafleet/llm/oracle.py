"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_UP = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
_LOW = "'abcdefghijklmnopqrstuvwxyz'"

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {_UP}, {_LOW}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = rf"""
with d as (select doc_id, {_WORDS} as w from documents),
i as (select item_id, {_WORDS} as w from benchmark),
win as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') as g
        from i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as u(k) where len(w) > 0),
grams as (select doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') as g
          from d, (select distinct n from win) as l, unnest(range(1, len(w) - n + 2)) as u(k)),
hit as (select doc_id, k, grams.n, item_id from grams join win using (n, g)),
pos as (select doc_id, count(distinct k + x) as n_hit from hit, unnest(range(0, n)) as u(x) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as items
        from (select distinct doc_id, item_id from hit) group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join pos using (doc_id) left join its using (doc_id)
"""

OP4 = rf"""
with p as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {_UP}, {_LOW}) as host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
r(action, rhost, rpath) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m as (select page_id, rhost || rpath as rule, action, row_number() over (partition by page_id order by length(rhost || rpath) desc) as k
      from p join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
select page_id, host, path, rule, coalesce(action, 'allow') as verdict from p left join (select * from m where k = 1) using (page_id)
"""

OP6 = r"""
with t as (
  select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (
  select *, length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g')) as n_escaped,
         role is not distinct from lag(role) over w as joins, role is not distinct from lead(role) over w as goes_on
  from t window w as (partition by conv_id order by turn, role, text))
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(n_escaped + case when joins then 0 else 6 + length(role) end + case when goes_on then 9 else 8 end)::bigint as formatted_chars
from e group by conv_id
"""

OP13 = rf"""
with t as (
  select lang, source, doc_id, unnest(w) as term
  from (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as doc_id,
               regexp_extract_all(translate(coalesce(text, ''), {_UP}, {_LOW}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents)),
k as (select lang, term from (select distinct lang, term, doc_id from t) group by lang, term having count(*) >= 30),
c as (select lang, source, term, count(*) as c from t join k using (lang, term) group by all),
g as (select distinct coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
v as (select lang, count(*) as v from k group by lang),
n as (select lang, source, sum(c) as n from c group by all),
s as (select g.lang, g.source, coalesce(n, 0) as n, v from g join v using (lang) left join n on g.lang = n.lang and g.source = n.source),
p as (select s.lang, s.source, k.term, coalesce(c, 0) as c, 1 + (1000000000 * (coalesce(c, 0) + 5)) // (s.n + 5 * s.v) as p
      from s join k using (lang) left join c on c.lang = s.lang and c.source = s.source and c.term = k.term),
q as (select lang, term, 1 + (1000000000 * (sum(c) + 5)) // ((select sum(n) from s where s.lang = p.lang) + 5 * (select v from v where v.lang = p.lang)) as q
      from p group by lang, term),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f, 0) as value
  from g as a join g as b on a.lang = b.lang and a.source <> b.source
  left join (select a.lang, a.source as one, b.source as two, sum(abs(a.p - b.p)) as f from p as a join p as b using (lang, term) where a.source <> b.source group by all) as d
    on d.lang = a.lang and d.one = a.source and d.two = b.source),
terms as (select lang, source, 'term' as part, term as item, p - q as value from p join q using (lang, term) where c > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (from pairs union all from terms))
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= 50
"""

ORACLE_SQL: dict[str, str] = {"op1_winnowing": OP1, "op4_redirect_rules": OP4, "op6_chat_format": OP6, "op13_joint_histograms": OP13}
