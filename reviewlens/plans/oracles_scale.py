"""DuckDB SQL of the queries of ``catalog_scale``."""

from __future__ import annotations

from reviewlens.plans.adapters import V_EDGES, V_FILES, V_LINES
from reviewlens.plans.oracles import SQL as CORE
from reviewlens.plans.oracles import TARGET

SQL: dict[str, str] = {}

# Pieces of hunks over running sums: each cut is the last line, or else one line, that still has room.
SQL["hunk_split"] = f"""with recursive {V_LINES},
f as (select file_path, 'diff --git a/' || file_path || ' b/' || file_path || chr(10) || '--- a/' || file_path || chr(10) || '+++ b/' || file_path || chr(10) as head from v_files),
n as (select file_path, count(*) as lines from v_lines group by 1),
l as (select v.file_path, v.p // 10 as h, v.p % 10 as i, v.p % 4 as k, case v.p % 4 when 0 then ' ' when 3 then '-' else '+' end || v.x || case when v.p + 1 < n.lines then chr(10) else '' end as t from v_lines v join n using (file_path)),
h as (select file_path, h, '@@ -' || (10 * h + 1) || ',10 +' || (10 * h + 1) || ',10 @@' || chr(10) as top, string_agg(t, '' order by i) as body, list(length(t) order by i) as sizes from l group by 1, 2),
w as (select f.file_path, f.head, f.head || string_agg(top || body, '' order by h) as content from f join h using (file_path) group by f.file_path, f.head),
big as materialized (select file_path, head, 2000 - length(head) as room from w where length(content) > 2000),
s as materialized (select h.*, big.room, list_transform(range(0, len(sizes) + 1), lambda j: coalesce(list_sum(sizes[1:j]), 0)) as sums from h join big using (file_path)),
c as (select file_path, h, 0 as piece, 0 as a, greatest(1, len(list_filter(sums, lambda x: x <= room - length(top))) - 1) as b from s where length(top) + length(body) > room
 union all select s.file_path, s.h, c.piece + 1, c.b, greatest(c.b + 1, len(list_filter(s.sums, lambda x: x - s.sums[c.b + 1] <= s.room - length(s.top))) - 1) from c join s on s.file_path = c.file_path and s.h = c.h where c.b < len(s.sizes)),
cut as (select c.file_path, c.h, c.piece, c.a, c.b, count(*) filter (l.i < c.a and l.k in (0, 3)) as old0, count(*) filter (l.i < c.a and l.k < 3) as new0, count(*) filter (l.i >= c.a and l.i < c.b and l.k in (0, 3)) as old1, count(*) filter (l.i >= c.a and l.i < c.b and l.k < 3) as new1,
  string_agg(l.t, '' order by l.i) filter (l.i >= c.a and l.i < c.b) as body from c join l on l.file_path = c.file_path and l.h = c.h group by 1, 2, 3, 4, 5),
p as (select file_path, h, piece, '@@ -' || (10 * h + 1 + old0) || ',' || old1 || ' +' || (10 * h + 1 + new0) || ',' || new1 || ' @@' || chr(10) || body as t from cut
 union all select file_path, h, 0, top || body from s where length(top) + length(body) <= room),
q as materialized (select file_path, list(t order by h, piece) as texts, list(length(t) order by h, piece) as sizes from p group by 1),
r as materialized (select q.*, big.head, big.room, list_transform(range(0, len(sizes) + 1), lambda j: coalesce(list_sum(sizes[1:j]), 0)) as sums from q join big using (file_path)),
g as (select file_path, 0 as part, 0 as a, greatest(1, len(list_filter(sums, lambda x: x <= room)) - 1) as b from r
 union all select r.file_path, g.part + 1, g.b, greatest(g.b + 1, len(list_filter(r.sums, lambda x: x - r.sums[g.b + 1] <= r.room)) - 1) from g join r on r.file_path = g.file_path where g.b < len(r.sizes)),
o as (select g.file_path, g.part, r.head || array_to_string(r.texts[g.a + 1:g.b], '') as content from g join r on r.file_path = g.file_path)
select file_path, part::int as part, content, greatest(1, length(content) // 4)::int as token_count from o union all select file_path, 0, content, 0 from w where length(content) <= 2000"""

_EDGES = V_EDGES.replace("v_edges as", "v_edges as materialized", 1)

SQL["graph_impact_of_many"] = f"""with recursive {_EDGES}, e as materialized (select distinct src, dst from v_edges), seeds as (select distinct dst as seed from v_edges order by 1 limit 64),
r as (select seed, seed as id, 0 as depth from seeds union select seed, src, depth + 1 from r join e on dst = r.id where depth < 2)
select seed, id, min(depth)::int as depth from r group by 1, 2 having min(depth) > 0"""

# Distances from both ends; of the nodes on shortest paths the first one a step.
SQL["graph_path"] = f"""with recursive {_EDGES}, {TARGET}, e as materialized (select distinct src, dst from v_edges), s as (select min(src) as id from v_edges),
f as (select id, 0 as d from s union select dst, d + 1 from f join e on src = f.id where d < 5), fd as materialized (select id, min(d) as d from f group by 1),
b as (select id, 0 as d from v_target union select src, d + 1 from b join e on dst = b.id where d < 5), bd as materialized (select id, min(d) as d from b group by 1),
best as (select min(fd.d + bd.d) as n from fd join bd using (id)),
node as materialized (select fd.id, fd.d from fd join bd using (id), best where fd.d + bd.d = best.n),
way as (select 0 as step, s.id as src, (select min(e.dst) from e join node on node.id = e.dst and node.d = 1 where e.src = s.id) as dst from s, best where best.n > 0
 union all select step + 1, dst, (select min(e.dst) from e join node on node.id = e.dst where e.src = way.dst and node.d = way.step + 2) from way, best where step + 1 < best.n)
select step::int as step, src, dst, 'CALLS' as type from way"""

SQL["indexed_search_topk"] = CORE["semantic_search_topk"]

SQL["vectors_topk_of_many"] = """with s as (select q.vec_id as query, v.vec_id, list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda z: z[1]::double * z[2]::double)) as score from embeddings q, embeddings v where q.vec_id % 20 = 0),
n as (select *, row_number() over (partition by query order by round(score, 9) desc, vec_id) as nth from s)
select query, nth::int as nth, vec_id, round(score, 4) as score from n where nth <= 5"""

SQL["stream_dead_letters"] = """select event_id, event_type as queue, (epoch_us(ts) // 1000000)::bigint + 600 as died_at from events where event_type <> 'purchase' and ts + interval 10 minute <= (select max(ts) from events)"""

SQL["stream_conflicts"] = CORE["task_idempotent"]
