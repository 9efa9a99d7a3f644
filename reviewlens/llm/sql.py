"""DuckDB SQL for the queries that SQL can express."""

OP3 = r"""
with p as (
  select page_id, url, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages
), h as (
  select page_id, url, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path,
         list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_[^=]*|ref)(=|$)'))) as params
  from p
), c as (
  select *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') || case when len(params) > 0 then '?' || array_to_string(params, '&') else '' end as canonical from h
), listed as (select canonical from c where url is not null and canonical <> '' group by canonical having count(*) > 1),
rules(action, rhost, rpath) as (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
best as (
  select page_id, url, arg_max(rhost || rpath, length(rhost || rpath)) as rule, arg_max(action, length(rhost || rpath)) as action
  from (select distinct page_id, url, host, path from c) d join rules on (host = rhost or host like '%.' || rhost) and starts_with(path, rpath)
  group by page_id, url
)
select c.page_id, c.host, c.path, b.rule, coalesce(b.action, case when l.canonical is not null then 'block' else 'allow' end) as verdict
from c left join best b on c.page_id = b.page_id and c.url = b.url left join listed l on c.canonical = l.canonical
"""

OP9 = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
win as (
  select doc_id, p, array_to_string(w[p:p + 19], ' ') as t
  from (select doc_id, w, unnest(range(1, len(w) - 18)) as p from d)
),
late as (
  select doc_id, p from (
    select doc_id, p, row_number() over (partition by md5(t) order by doc_id, p) as k from win
  ) where k > 1
),
word as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as i from d),
gone as (select distinct doc_id, i from (select doc_id, unnest(range(p, p + 20)) as i from late)),
kept as (
  select word.doc_id, count(*) filter (gone.i is not null) as n_removed, string_agg(x, ' ' order by word.i) filter (gone.i is null) as kept
  from word left join gone on word.doc_id = gone.doc_id and word.i = gone.i group by word.doc_id
)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(k.n_removed, 0)::bigint as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from d left join kept k on d.doc_id = k.doc_id
"""

# Pages of these tables hold one article each, whose only inline element is <b>; what is cut off inside a tag is no text.
OP2 = r"""
with a as (select page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1), '<[^>]*$', '') as t from pages),
b as (select page_id, url, regexp_replace(regexp_replace(t, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') as t from a),
c as (select page_id, url, regexp_replace(replace(replace(replace(t, '&quot;', '"'), '&middot;', chr(183)), '&copy;', chr(169)), '&amp;?', '&', 'g') as t from b)
select page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) as text, length(trim(regexp_replace(t, '\s+', ' ', 'g')))::bigint as n_chars from c
"""

OP5 = r"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, md5(case when len(w) < 4 then array_to_string(w, ' ') else array_to_string(w[p:p + 3], ' ') end) as h
      from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) as p from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.h = b.h and a.doc_id <> b.doc_id group by 1, 2),
links as materialized (select x, y from pairs join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 85 * (nx.n + ny.n - c)),
reach as (select doc_id, doc_id as other from d union select reach.doc_id, links.y from reach join links on links.x = reach.other)
select d.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(reach.other) as component_id from d join reach using (doc_id) left join n using (doc_id) group by d.doc_id
"""

ORACLE_SQL = {"op2_html_text": OP2, "op3_url_filter": OP3, "op5_ngram_join": OP5, "op9_substrings": OP9}
