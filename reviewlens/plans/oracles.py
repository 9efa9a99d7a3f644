"""DuckDB SQL of the catalogue, worded apart from the Spark code."""

from __future__ import annotations

from reviewlens.plans.adapters import V_EDGES, V_FILES, V_ISSUES, V_LINES

#: Which exclusion holds for a message and an ending; only reasons that the messages can meet.
REASON = """v_marked as (select *, case
 when file like '%.md' then 'Finding in documentation file'
 when file like '%Test.java' then 'Finding in test file'
 when plain like 'Potential denial of service%' then 'Generic DOS/resource exhaustion finding'
 when plain like 'Consider adding rate limit%' and event_noise <> 1 then 'Generic rate limiting suggestion'
 when plain like 'Consider adding rate limit%' then 'Generic rate limiting suggestion'
 when plain like 'Consider using caching%' then 'Generic performance suggestion without specifics'
 when plain like 'Buffer overflow%' and file not like '%.cpp' then 'Memory safety finding in non-C/C++ code'
 when plain like 'Open redirect%' and event_noise <> 1 then 'Open redirect vulnerability (low impact)'
 when plain like 'Regex injection%' then 'Regex injection finding'
 when plain like 'Please follow best practices%' then 'Overly generic suggestion without actionable specifics'
 end as reason from (select *, ord % 3 as event_noise from v_issues))"""

SECRET = r"""(?i)(password|passwd|secret|api_key|apikey|token|private_key)\s*[:=]\s*["''][^"'']{8,}["'']"""
CODE = "regexp_replace(regexp_replace(regexp_replace(t, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[_{}()\\[\\];,.<>!=+*/&|?:@#~\"''-]', ' ', 'g')"
TERMS = f"""v_tokens as (select doc_id, source, list_filter(regexp_extract_all(lower({CODE}), '[a-z_][a-z0-9_]*|[0-9]+'), lambda x: length(x) > 1) as ts from (select doc_id, source, coalesce(text, '') as t from documents)),
v_tf as (select doc_id, term, count(*) as tf, any_value(n) as len from (select doc_id, len(ts) as n, unnest(ts) as term from v_tokens) group by doc_id, term),
v_vocab as (select term, count(*)::bigint as df, sum(tf)::bigint as cf from v_tf group by term having sum(tf) >= 2 order by cf desc, term limit 512),
v_raw as (select doc_id, term, tf / len * (ln(((select count(*) from documents) + 1) / (df + 1)) + 1) as w from v_tf join v_vocab using (term)),
v_weight as (select doc_id, term, w / sqrt(sum(w * w) over (partition by doc_id)) as weight from v_raw),
v_query as (select term, weight as q from v_weight where doc_id = (select min(doc_id) from documents)),
v_score as (select doc_id, sum(weight * q) as score from v_weight join v_query using (term) group by doc_id)"""
TARGET = "v_target as (select dst as id from v_edges group by dst order by count(*) desc, dst limit 1)"
KEYED = V_FILES + """, v_keyed as (select *, sha256(file_path || content || sha256('m|rules=a,b|lang=en|pipeline=false|prompt=')) as key from v_files)"""
# a line of the adapter's diff: its marker, its hunk and its place among the diff's lines
DIFF = V_LINES + """, v_diff as (select review_id, file_path, p, x, p % 4 as m, p // 10 as b, 3 + p + p // 10 + 1 + 1 as diff_line from v_lines)"""
RULE_CODE = r"""case when s like '-%' or s like '+++%' or s like '@@%' or s like 'diff %' or s like 'index %' or s like '\ %' then null when s like '+%' then s[2:] else s end"""

SQL: dict[str, str] = {
    "rule_scan_documents": f"""with {V_LINES}, c as (select *, {RULE_CODE} as code, case when x like '+%' and x not like '+++%' then x[2:] end as added from (select *, regexp_replace(x, '^\\s+|\\s+$', '', 'g') as s from v_lines)),
h as (select *, unnest(list_filter([
 case when regexp_matches(code, '{SECRET}') or regexp_matches(code, 'AKIA[0-9A-Z]{{16}}') or regexp_matches(code, 'gh[ps]_[A-Za-z0-9_]{{36,}}') then {{'rule': 'R2', 'type': 'hardcoded_secret', 'severity': 'WARNING'}} end,
 case when (file_path like '%.java' or file_path like '%.py') and regexp_matches(code, '(?i)("\\s*\\+\\s*\\w+.*(?:SELECT|INSERT|UPDATE|DELETE|FROM|WHERE))|((?:SELECT|INSERT|UPDATE|DELETE|FROM|WHERE).*\\+\\s*")') then {{'rule': 'R1', 'type': 'sql_injection', 'severity': 'WARNING'}} end,
 case when (file_path like '%.java' or file_path like '%.py') and contains(code, 'exec(') then {{'rule': 'R3a', 'type': 'command_injection', 'severity': 'WARNING'}} end,
 case when (file_path like '%.java' or file_path like '%.py') and contains(code, 'ObjectInputStream') and not contains(code, 'ValidatingObjectInputStream') then {{'rule': 'R3b', 'type': 'insecure_deserialization', 'severity': 'WARNING'}} end,
 case when regexp_matches(added, '(?i)(password\\s*=\\s*"[^"]+"|api_?key\\s*=\\s*"[^"]+"|secret\\s*=\\s*"[^"]+"|token\\s*=\\s*"[^"]{{16,}}")') then {{'rule': 'R6', 'type': 'hardcoded_secret', 'severity': 'CRITICAL'}} end
 ], lambda z: z is not null)) as r from c)
select review_id, file_path as file, (p + 1)::int as line, r.rule, r.type, r.severity from h""",
    "rule_indent_max": f"""with {V_LINES}, i as (select file_path, p, repeat(' ', (p % 40)::int) || x as y from v_lines where file_path like '%.java'),
k as (select file_path, p, length(y) - length(ltrim(y, ' ')) as plain, y from i where not (y like '-%' or y like '+%' or y like '@@%' or y like 'diff %' or y like 'index %' or y like '\\ %') or (y like '+%' and y not like '+++%')),
n as (select file_path, p, coalesce(length(regexp_extract(case when y like '+%' then y[2:] else y end, '^[ \\t]*')), 0) + 3 * len(regexp_extract_all(regexp_extract(case when y like '+%' then y[2:] else y end, '^[ \\t]*'), '\\t')) as indent from k)
select file_path as file, max(indent)::int as indent, (arg_min(p, (-indent, p)) + 1)::int as line from n group by file_path having max(indent) > 24""",
    "rule_current_file": f"""with {V_LINES} select current_file, sum(n)::bigint as lines from (
 select null as current_file, 2 * count(*) as n from v_files union all
 select file_path, max(p) + 1 + (max(p) // 10 + 1) + 1 from v_lines group by file_path) group by current_file""",
    "severity_normalise": """select case event_type when 'error' then 'CRITICAL' when 'purchase' then 'high' when 'signup' then 'Medium' when 'view' then 'odd' else 'INFO' end as raw_severity,
 case event_type when 'error' then 'CRITICAL' when 'purchase' then 'CRITICAL' when 'signup' then 'WARNING' else 'INFO' end as severity, count(*) as n from events group by 1, 2""",
    "severity_report": f"""with {V_ISSUES} select review_id, count(*) as total, count(*) filter (severity = 'CRITICAL') as critical, count(*) filter (severity = 'WARNING') as warning, count(*) filter (severity = 'INFO') as info, count(*) filter (severity = 'CRITICAL') > 0 as has_critical from v_issues group by 1""",
    "severity_report_enum": f"""with {V_ISSUES} select s.ord::int as ord, s.severity, count(v.ord) as n, count(distinct v.file) as files from (values (0, 'CRITICAL'), (1, 'WARNING'), (2, 'INFO')) s(ord, severity) left join v_issues v using (severity) group by 1, 2""",
    "issue_dedup": f"""with {V_ISSUES}, k as (select *, file || chr(1) || lower(type) || chr(1) || case when line is not null then line::varchar else 'none' || chr(1) || lower(suggestion) end || chr(1) || lower(left(trim(regexp_replace(message, '\\s+', ' ', 'g')), 240)) as key,
 case severity when 'CRITICAL' then 3 when 'WARNING' then 2 else 1 end as r from v_issues),
o as (select *, row_number() over (partition by key order by r desc, ord) as nth, min(ord) over (partition by key) as first from k)
select first as ord, severity, file, line, type, message from o where nth = 1""",
    "fp_first_match": f"""with {V_ISSUES}, {REASON} select ord, reason, case when reason is null then 1.0 else 0.0 end::double as confidence from v_marked""",
    "fp_reason_histogram": f"""with {V_ISSUES}, {REASON} select reason, count(*) as n from v_marked where reason is not null group by 1""",
    "fp_stats": f"""with {V_ISSUES}, {REASON} select count(*) as input, count(reason) as excluded, count(reason) as adjusted, count(*) - count(reason) as passed from v_marked""",
    "fp_confidence_threshold": f"""with {V_ISSUES}, {REASON} select case when reason is not null then 'hard_rule' when ord % 10 < 5 then 'confidence' end as stage, count(*) as n from v_marked group by 1""",
    "reviewer_guess": f"""with {V_ISSUES} select case when regexp_matches(lower(type || chr(10) || message), 'sql|xss|csrf|injection|auth|secret|hardcoded') then 'security' when regexp_matches(lower(type || chr(10) || message), 'null|race|resource|leak|overflow|concurrency|logic') then 'logic' else 'quality' end as reviewer, count(*) as n from v_issues group by 1""",
    "reviewer_top50_top15": f"""with {V_ISSUES}, g as (select *, case when regexp_matches(lower(type || chr(10) || message), 'sql|xss|csrf|injection|auth|secret|hardcoded') then 'security' when regexp_matches(lower(type || chr(10) || message), 'null|race|resource|leak|overflow|concurrency|logic') then 'logic' else 'quality' end as reviewer,
 case severity when 'CRITICAL' then 3 when 'WARNING' then 2 else 1 end as w from v_issues), t as (select * from g order by w desc, ord limit 50)
select reviewer, count(*)::int as nth, t.ord, t.severity from t join (select reviewer, w, ord from t) u using (reviewer) where u.w > t.w or (u.w = t.w and u.ord <= t.ord) group by reviewer, t.ord, t.severity having count(*) <= 15""",
    "file_routing": f"""with {V_FILES} select review_id, reviewer, count(*) as files from (
 select review_id, 'security' as reviewer from v_files where file_path like '%.java' union all select review_id, 'quality' from v_files where file_path like '%.py'
 union all select review_id, unnest(['security', 'logic', 'quality']) from v_files where file_path not like '%.java' and file_path not like '%.py') group by 1, 2""",
    "issue_comments": f"""with {V_ISSUES}, {REASON} select ord, file as path, case when line is null or line = 0 then 1 else line end::int as line, 'RIGHT' as side, '**[' || severity || '] ' || type || '**: ' || message || case when suggestion <> '' then chr(10) || chr(10) || '> **Suggestion**: ' || suggestion else '' end as body
 from v_marked where reason is null and (file like '%.java' or file like '%.py') and file in (select file from v_marked where file like '%.java' or file like '%.py')""",
    "comment_summary": f"""with {V_ISSUES}, {REASON}, c as (select count(*) as n, count(*) filter (severity = 'CRITICAL') as a, count(*) filter (severity = 'WARNING') as b, count(*) filter (severity = 'INFO') as i from v_marked where reason is null)
select case when n = 0 then 'No actionable findings, safe to merge.' else 'Found **' || n || '** findings:' || case when a > 0 then ' ' || a || ' Critical' else '' end || case when b > 0 then ' ' || b || ' Warning' else '' end || case when i > 0 then ' ' || i || ' Info' else '' end end as summary from c""",
    "markdown_report": f"""with {V_ISSUES}, r as (select review_id, '| Severity | File | Line | Type | Message |' || chr(10) || '|----------|------|------|------|--------|' || chr(10) || string_agg('| ' || severity || ' | `' || file || '` | ' || coalesce(line, 0) || ' | ' || type || ' | ' || replace(message, '|', '\\|') || ' |', chr(10) order by ord) as t from v_issues group by 1)
select review_id, sha256(t) as report_sha, length(t)::int as n from r""",
    "grouped_report": f"""with {V_ISSUES} select review_id, sha256(string_agg('[' || severity || '] ' || file || ':' || coalesce(line, 0) || ' ' || message, chr(10) order by case severity when 'CRITICAL' then 1 when 'WARNING' then 2 else 3 end, ord)) as report_sha, case when max(severity = 'CRITICAL') then 'BLOCKED' else 'PASSED' end as verdict from v_issues group by 1""",
    "json_result": f"""with {V_ISSUES}, {REASON} select review_id, count(*)::int as issues, max(severity = 'CRITICAL') as has_critical from v_marked where reason is null group by 1""",
    "ext_cube_severity_type": f"""with {V_ISSUES} select severity, type, count(*) as n, grouping(severity, type)::int as level from v_issues group by cube (severity, type)""",
    "chunk_outcomes": f"""with {V_ISSUES}, c as (select file, max(review_id) as review_id, min(ord) as ord, max(severity = 'CRITICAL') as crit, 's' || count(*) as s from v_issues group by file),
g as (select review_id, count(*)::int as chunks, (count(*) filter (ord % 3 = 0))::int as failed, max(crit) as has_critical, list(s order by ord) filter (ord % 3 <> 0) as parts from c group by 1)
select review_id, chunks, failed, has_critical, case when failed = chunks or failed > 0.5 * chunks then 'FAILED' when failed > 0 then 'PARTIAL' else 'COMPLETED' end as status,
 case when failed > 0 then '[partial ' || (chunks - failed) || '/' || chunks || '] ' else '' end || case when parts is null then 'Reviewed changes across ' || chunks || ' batches.' when len(parts) = 1 then parts[1] else '[' || chunks || '-batch review] ' || array_to_string(parts, ' | ') end as summary from g""",
    "entry_totals": f"""with {V_FILES} select review_id, count(*) as files, sum(case when content = '' then 0 else length(content) - length(replace(content, chr(10), '')) + 1 end)::bigint as lines, sum(token_count)::bigint as tokens from v_files group by 1""",
    "usage_tokens": """select 'run' || user_id as run_id, sum(event_id % 100)::bigint as prompt_tokens, sum(case when event_id % 3 = 0 then 5 else 7 end)::bigint as completion_tokens,
 sum(case when event_id % 3 = 0 then event_id % 100 + 5 else event_id % 100 + 9 end)::bigint as total_tokens, count(*) as calls from events group by 1""",
    "diff_split": f"""with {V_FILES} select review_id as diff_id, (row_number() over (partition by review_id order by ord) - 1)::int as ord, file_path from v_files""",
    "diff_line_map": f"""with {DIFF} select file_path, diff_line::int as diff_line, (b * 10 + 1 + p - b * 10 - ((p + 1) // 4 - (b * 10 + 1) // 4))::int as file_line from v_diff where m in (1, 2)""",
    "diff_changed_lines": f"""with {DIFF}, y as (select file_path, b * 10 + 1 + p - b * 10 - ((p + 1) // 4 - (b * 10 + 1) // 4) as f from v_diff where m in (1, 2))
select file_path as diff_id, count(distinct f) as n, sum(distinct f)::bigint as total, max(f)::int as last from y group by 1""",
    "nearest_hunk": f"""with {V_LINES}, s as (select file_path, max(p) + 1 as n, 3 + max(p) + 1 + max(p) // 10 + 1 as total from v_lines group by 1),
l as (select file_path, total, unnest(range(1, total + 1)) as diff_line from s)
select file_path, diff_line::int as diff_line, case when diff_line <= 4 then 1 else (least(greatest((diff_line - 4) // 11 + case when (diff_line - 4) % 11 > 5 and ((diff_line - 4) // 11 + 1) * 11 + 4 <= total then 1 else 0 end, 0), 1000000000) * 10 + 1) end::int as hunk_start from l""",
    "glob_filter": f"""with {V_FILES} select review_id, count(*) as n from v_files where file_path like '%.java' or regexp_full_match(file_path, 'src1[^/]*/[^/]+\\.py') group by 1""",
    "excluded_dirs": f"""with {V_FILES} select review_id, count(*) as n from v_files where review_id not in ('src1', 'src2') group by 1""",
    "token_cap_limit": f"""with {V_FILES} select review_id, ord, file_path from (select *, row_number() over (partition by review_id order by ord) as k from v_files where content <> '' and file_path not like '%.md' and token_count <= 400) where k <= 20""",
    "token_cap_limit_working_copy": f"""with {V_FILES} select review_id, ord, file_path from (select *, row_number() over (partition by review_id order by ord) as k from v_files where content <> '' and file_path not like '%.md') where k <= 20 and token_count <= 400""",
    "file_diff_concat": f"""with {V_FILES} select review_id, regexp_extract(file_path, '(\\.\\w+)$', 1) as file_path, sha256(string_agg(content, chr(10) order by ord)) as content_sha from v_files group by 1, 2""",
    "relevant_diff": f"""with {V_FILES} select file_path, case when length(content) > 200 and length(content) - 200 < 0.85 * length(content) then length(content) - 200 else length(content) end::int as n from v_files""",
    "comment_budget": """with o as (select conv_id, turn, least(length(text), 200) as n from conversations where contains(text, 'e'))
select a.conv_id as review_id, a.turn as ord, a.n::int as n from o a join o b on a.conv_id = b.conv_id and b.turn <= a.turn group by a.conv_id, a.turn, a.n having sum(b.n) <= 600""",
    "chunk_next_fit": f"""with recursive {V_FILES.replace("v_files as", "v_files as materialized", 1)}, o as (select review_id, ord, token_count as t, row_number() over (partition by review_id order by ord) as k from v_files),
w as (select review_id, k, ord, t as used, 0::bigint as bin from o where k = 1 union all
 select o.review_id, o.k, o.ord, case when w.used > 0 and w.used + o.t > 6000 then o.t else w.used + o.t end, w.bin + case when w.used > 0 and w.used + o.t > 6000 then 1 else 0 end from w join o on o.review_id = w.review_id and o.k = w.k + 1)
select review_id, ord, bin from w""",
    "code_token_counts": f"""with {TERMS.split(", v_tf", 1)[0].split(",\nv_tf", 1)[0]} select doc_id, len(ts)::int as tokens from v_tokens""",
    "vocab_top512": f"""with {TERMS} select term, df, cf from v_vocab""",
    "tfidf_weights": f"""with {TERMS} select doc_id, term, round(weight, 6) as weight from v_weight""",
    "semantic_search_topk": f"""with {TERMS} select doc_id, round(score, 6) as score from v_score order by round(score, 9) desc, doc_id limit 10""",
    "related_code": f"""with {TERMS}, h as (select doc_id, score from v_score order by round(score, 9) desc, doc_id limit 20)
select doc_id, round(score, 6) as score from h join documents using (doc_id) where source <> (select source from documents where doc_id = (select min(doc_id) from documents)) order by round(score, 9) desc, doc_id limit 10""",
    "vector_topk": """with q as (select embedding as e from embeddings order by vec_id limit 1) select vec_id, round(list_sum(list_transform(list_zip(embedding, e), lambda z: z[1]::double * z[2]::double)), 4) as score from embeddings, q order by round(list_sum(list_transform(list_zip(embedding, e), lambda z: z[1]::double * z[2]::double)), 9) desc, vec_id limit 10""",
    "graph_in_degree": f"""with {V_EDGES} select dst, count(*) as calls, count(distinct src) as callers from v_edges group by 1""",
    "graph_callers": f"""with {V_EDGES}, {TARGET} select distinct src as id from v_edges, v_target where dst = id and src in (select src from v_edges)""",
    "graph_callees": f"""with {V_EDGES}, {TARGET} select distinct dst as id from v_edges, v_target where src = id""",
    "graph_dependents": f"""with {V_EDGES}, {TARGET} select distinct src as id from v_edges, v_target where dst = id""",
    "graph_impact_depth3": f"""with recursive {V_EDGES.replace("v_edges as", "v_edges as materialized", 1)}, {TARGET}, r as (select id, 0 as depth from v_target union select src, depth + 1 from r join v_edges on dst = r.id where depth < 3)
select id, min(depth)::int as depth from r group by id having min(depth) > 0""",
    "graph_shortest_path": f"""with recursive {V_EDGES.replace("v_edges as", "v_edges as materialized", 1)}, {TARGET}, e as (select distinct src, dst from v_edges), r as (select (select min(src) from v_edges) as id, 0 as depth union select dst, depth + 1 from r join e on src = r.id where depth < 6)
select min(depth)::bigint as steps from r where id = (select id from v_target)""",
    "graph_stats": """select kind, type, n::bigint as n from (values
 ('node', 'FILE', (select count(*) from region)), ('node', 'CLASS', (select count(*) from nation)), ('node', 'METHOD', (select count(*) from supplier)), ('node', 'INTERFACE', 0), ('node', '*', (select count(*) from region) + (select count(*) from nation) + (select count(*) from supplier)),
 ('edge', 'CALLS', 0), ('edge', 'IMPLEMENTS', 0), ('edge', 'EXTENDS', 0), ('edge', 'IMPORTS', 0), ('edge', 'CONTAINS', (select count(*) from nation) + (select count(*) from supplier)), ('edge', '*', (select count(*) from nation) + (select count(*) from supplier))) v(kind, type, n)""",
    "graph_mermaid": """select 0 as part, 'graph TD' as line union all select 1, '  r' || r_regionkey || '([' || r_name || '])' from region union all select 1, '  n' || n_nationkey || '[' || n_name || ']' from nation union all select 1, '  s' || s_suppkey || '(' || s_name || ')' from supplier""",
    "cache_key": f"""with {KEYED} select file_path, key from v_keyed""",
    "cache_hits": f"""with {KEYED} select file_path, key from v_keyed where key in (select key from v_keyed where length(content) % 2 = 0)""",
    "cache_misses": f"""with {KEYED} select file_path, key from v_keyed where key not in (select key from v_keyed where length(content) % 2 = 0)""",
    "cache_evict": f"""with {KEYED}, c as (select key, 1704067200 + ord * 60 as written from v_keyed where length(content) % 2 = 0) select key, written::bigint as written from c where key not in (select key from c order by written desc, key limit 500)""",
    "breaker_state": """with c as (select 'u' || user_id as caller, event_id, ts, (event_type = 'error')::int as f, row_number() over (partition by user_id order by ts, event_id) as k from events)
select a.caller, a.event_id as call_id, count(*)::int as calls, round(avg(b.f), 6) as failure_rate, count(*) >= 5 and avg(b.f) >= 0.5 as open from c a join c b on a.caller = b.caller and b.k between a.k - 9 and a.k group by 1, 2""",
    "rate_limited": """with c as (select 'u' || user_id as caller, event_id, date_trunc('hour', ts) as h from events)
select a.caller, a.event_id as call_id, count(*)::int as nth from c a join c b on a.caller = b.caller and a.h = b.h and b.event_id <= a.event_id group by 1, 2 having count(*) <= 2""",
    "error_classes": """select case event_id % 6 when 0 then 'rate_limit' when 1 then 'timeout' when 2 then 'server' else 'client' end as kind, case event_id % 6 when 0 then 429 when 2 then 503 else -1 end::int as status, event_id % 6 = 3 as quota, event_id % 6 = 4 as too_long, count(*) as n from events group by 1, 2, 3, 4""",
    "task_latest_state": """select 't' || user_id as task_id, arg_max(case when event_type = 'signup' then 'PENDING' when event_type in ('click', 'view') then 'RUNNING' when event_type = 'purchase' then 'COMPLETED' else 'FAILED' end, (ts, event_id)) as status, count(*) as transitions, max(ts) as updated_at from events group by 1""",
    "task_idempotent": """with f as (select user_id, first(event_type order by event_id) as h, min(event_id) as i from events group by 1)
select 'k' || e.user_id as key, case when e.event_id = f.i then 'created' when e.event_type = f.h then 'duplicate' else 'conflict' end as outcome, count(*) as n from events e join f using (user_id) group by 1, 2""",
    "task_routing": """select case event_type when 'error' then 'agent' when 'view' then 'pipeline' when 'click' then 'simple' end as queue, case when value > 100 then 9 else 5 end::int as priority, count(*) as n from events group by 1, 2""",
    "task_results": """select case when event_id % 11 = 0 then 'dead_letter' when user_id in (select c_custkey * 2 from customer) then 'applied' else 'ignored' end as route, count(*) as n from events group by 1""",
    "task_dead_letters": """select case when ts < timestamp '2024-01-14 23:50:00' then 'dead' else 'live' end as what, case when value > 100 then 9 else 5 end::int as priority, count(*) as n from events group by 1, 2""",
    "stream_tumbling": """select epoch(date_trunc('hour', ts))::bigint as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2""",
    "stream_sliding": """select epoch(date_trunc('hour', ts) - to_hours(k))::bigint as start, event_type, count(*) as n from events, (values (0), (1)) v(k) group by 1, 2""",
    "stream_session": """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hours then 0 else 1 end as fresh from events),
s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, floor(epoch(min(ts)))::bigint as start, count(*) as n from s group by user_id, k""",
    "stream_first_seen": "select event_type, count(distinct event_id) as n from events group by 1",
    "text_functions": """select doc_id, md5(replace(replace(coalesce(text, ''), '|', '\\|'), chr(10), ' ')) as cell, case when length(coalesce(text, '')) <= 40 then coalesce(text, '') else '...' || right(text, 37) end as short, sha256(coalesce(text, '') || sha256('m|rules=|lang=en|pipeline=true|prompt=')) as h from documents""",
}

SQL["review_severity_report"] = (
    "with scan as (" + SQL["rule_scan_documents"] + """), kept as (select distinct file, rule, line, severity from scan where file not like '%.md')
select s.severity, count(k.file) as n, count(distinct k.file) as files from (values ('CRITICAL'), ('WARNING'), ('INFO')) s(severity) left join kept k using (severity) group by 1"""
)
SQL["llm_parse"] = """select * from (values ('object', 1, true, false), ('no_flag', 1, false, false), ('no_issues', 0, true, false), ('fenced', 1, false, false), ('prose', 1, false, false), ('several', 2, false, false), ('empty_array', 0, null, false), ('array', 1, null, false),
 ('plain', 0, null, true), ('broken', 0, null, true), ('null', 0, false, false), ('blank', 0, false, false), ('braces', 1, false, false), ('think', 1, false, false)) v(reply_id, issues, has_critical, is_raw)"""
SQL["cache_write_back"] = (
    "with scan as (" + SQL["rule_scan_documents"] + "), " + KEYED + """ select key, coalesce(n, 0)::int as issues from v_keyed left join (select file, count(*) as n from scan group by 1) s on s.file = v_keyed.file_path"""
)
SQL["rule_scan_added_lines"] = f"""with {DIFF}, t as (select file_path, diff_line, x as added, case when x = '' then '' else x end as c, m from v_diff where m in (0, 1, 2)),
code as (select *, regexp_replace(regexp_replace(case when m = 0 then ' ' || c else '+' || c end, '^\\s+|\\s+$', '', 'g'), '^\\+', '') as code from t),
h as (select file_path, diff_line, unnest(list_filter([case when regexp_matches(code, '{SECRET}') or regexp_matches(code, 'AKIA[0-9A-Z]{{16}}') or regexp_matches(code, 'gh[ps]_[A-Za-z0-9_]{{36,}}') then 'R2' end,
 case when m in (1, 2) and regexp_matches(added, '(?i)(password\\s*=\\s*"[^"]+"|api_?key\\s*=\\s*"[^"]+"|secret\\s*=\\s*"[^"]+"|token\\s*=\\s*"[^"]{{16,}}")') then 'R6' end], lambda z: z is not null)) as rule from code)
select file_path as file, rule, count(*) as n, min(diff_line)::int as first_line from h group by 1, 2"""
SQL["diff_context_summary"] = f"""with {V_FILES} select review_id, md5(string_agg('- ' || file_path || ' (' || token_count || ' tokens)', chr(10) order by ord)) as text from v_files group by 1"""
SQL["wrapped_errors"] = """select * from (values ('business', 'business error (500): no quota'), ('message', 'business error (unknown): down'), ('error', 'error: bad key'), ('plain_error', 'error: bad'), ('with_content', null), ('fine', null), ('text', null), ('broken', null), ('null', null)) v(reply_id, error)"""
SQL["retry_delays"] = """select event_id % 5 as attempt, case user_id % 3 when 0 then 'timeout' when 1 then 'server' else 'client' end as kind,
 case when event_id % 5 >= 3 or user_id % 3 = 0 then null when user_id % 3 = 1 then least(30.0, 2.0 * 2 ** (event_id % 5)) else 2.0 end::double as seconds, count(*) as n from events group by 1, 2, 3"""

# Expected rows of the literal project, worked out by hand from its sources.
SQL["import_edges"] = """select * from (values ('file:src/shop/OrderController.java', 'file:src/shop/service/OrderService.java'), ('file:src/shop/service/OrderService.java', 'file:src/shop/dao/OrderDao.java')) v(src, dst)"""
SQL["call_resolution"] = """select * from (values ('src/shop/OrderController.java', 'handle', 'orderService', 'process', 'src/shop/service/OrderService.java'),
 ('src/shop/service/OrderService.java', 'process', 'orderDao', 'save', 'src/shop/dao/OrderDao.java')) v(file_path, caller, scope, callee, target_path)"""
SQL["most_specific_class"] = """select 'src/shop/' || f as file_path, name, type_name from (values ('OrderController.java', 'handle', 'OrderController'), ('service/OrderService.java', 'process', 'OrderService'), ('service/OrderService.java', 'validate', 'OrderService'),
 ('service/BaseService.java', 'help', 'Helper'), ('dao/OrderDao.java', 'save', 'OrderDao'), ('dao/SqlOrderDao.java', 'save', 'SqlOrderDao'), ('dao/SqlOrderDao.java', 'write', 'SqlOrderDao')) v(f, name, type_name)"""
SQL["method_complexity"] = """select 'method:' || m as chunk_id, c::int as complexity from (values ('OrderController.handle(String)', 3), ('OrderService.process(String)', 2), ('OrderService.validate(String)', 3), ('Helper.help()', 1),
 ('OrderDao.save(String)', 1), ('SqlOrderDao.save(String)', 2), ('SqlOrderDao.write(String)', 1)) v(m, c)"""
SQL["graph_query_impact"] = """select * from (values ('method:src/shop/OrderController.java:OrderController.handle(String)', 'METHOD'), ('method:src/shop/service/OrderService.java:OrderService.process(String)', 'METHOD')) v(id, type)"""
SQL["graph_related"] = """select * from (values ('contains', 'method:src/shop/service/OrderService.java:OrderService.process(String)'), ('contains', 'method:src/shop/service/OrderService.java:OrderService.validate(String)'),
 ('parent', 'class:src/shop/service/BaseService.java:BaseService'), ('dependency', 'class:src/shop/service/BaseService.java:BaseService')) v(relation, id)"""
SQL["llm_parse_loose"] = """select * from (values ('object', 1, true, false), ('no_flag', 1, false, false), ('no_issues', 0, true, false), ('fenced', 1, false, false), ('prose', 1, false, false), ('several', 2, false, false), ('empty_array', 0, null, false), ('array', 1, null, false),
 ('plain', 0, null, true), ('broken', 0, null, true), ('null', 0, false, false), ('blank', 0, false, false), ('braces', 1, false, false), ('think', 1, false, false)) v(reply_id, issues, has_critical, is_raw)"""
