"""DuckDB SQL of the rest of the catalogue; what the literal inputs give is worked out by hand."""

from __future__ import annotations

from reviewlens.plans import fixtures
from reviewlens.plans.adapters import V_FILES, V_ISSUES, V_LINES
from reviewlens.plans.oracles import DIFF, REASON, SQL, TERMS

MORE: dict[str, str] = {}


def _text(value: str | None) -> str:
    return "null" if value is None else "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _values(rows: list[tuple], names: str) -> str:
    cells = lambda r: ", ".join(str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int | float) else _text(x) for x in r)
    return "(values " + ", ".join(f"({cells(r)})" for r in rows) + f") v({names})"


#: Which rules each of the literal lines hits.
HITS = [(0, "R1"), (3, "R3a"), (5, "R3b"), (7, "R5"), (9, "R2"), (9, "R6"), (10, "R6"), (11, "R7"), (13, "R8"), (15, "R2"), (16, "R2"), (17, "R5"), (18, "R8"), (19, "R3a"), (19, "R7")]
KINDS = [
    ("R1", "sql_injection", "WARNING"),
    ("R2", "hardcoded_secret", "WARNING"),
    ("R3a", "command_injection", "WARNING"),
    ("R3b", "insecure_deserialization", "WARNING"),
    ("R5", "sql_injection", "WARNING"),
    ("R6", "hardcoded_secret", "CRITICAL"),
    ("R7", "dangerous_function", "WARNING"),
    ("R8", "complexity", "INFO"),
]
MORE["rule_hits"] = f"""select event_id, h.rule, k.type, k.severity from events join (select * from {_values(HITS, "c, rule")}) h on event_id % {len(fixtures.RULE_LINES)} = h.c join (select * from {_values(KINDS, "rule, type, severity")}) k on k.rule = h.rule"""
MORE["fp_patterns"] = f"""with m as (select * from {_values([(k, r) for k, (_, r) in enumerate(fixtures.EXCLUDED)], "c, r")}), e as (select event_id, event_id % {len(fixtures.EXCLUDED)} as c, (event_id // {len(fixtures.EXCLUDED)}) % 3 as x from events)
select event_id as ord, 'src/a' || case x when 0 then '.java' when 1 then '.cpp' else '.ts' end as file, case when x = 1 and r like 'Memory%' then null else r end as reason from e join m using (c)"""
MORE["fp_test_files"] = f"""select event_id as ord, r as reason from events join (select * from {_values([(k, r) for k, (_, r) in enumerate(fixtures.PATHS)], "c, r")}) m on event_id % {len(fixtures.PATHS)} = c"""
MORE["loaded_rules"] = (
    f"with {V_ISSUES}, "
    + REASON.replace(" when file like '%.md' then 'Finding in documentation file'", " when file like '%.md' or file like '%.ts' then 'Finding in documentation file' when regexp_matches(file, 'u1[0-9]*[.]java$') then 'Generated'").replace(
        " when plain like 'Potential denial", " when plain like '%says little%' then 'Team rule' when plain like 'Potential denial"
    )
    + " select ord, reason from v_marked"
)
MORE["staged_report"] = (
    "with scan as (" + SQL["rule_scan_documents"] + """), kept as (select distinct file, rule, line, severity from scan)
select s.severity, count(k.file) as n, count(distinct k.file) as files from (values ('CRITICAL'), ('WARNING'), ('INFO')) s(severity) left join kept k using (severity) group by 1"""
)
MORE["settings_overlay"] = "select given, max_files::int as max_files, language, model, retries::int as retries from " + _values([("none", 20, "en", "base", 3), ("home", 9, "en", "h", 3), ("project", 20, "fr", "base", 1), ("empty", 20, "en", "base", 3)], "given, max_files, language, model, retries")
MORE["pull_specs"] = f"""with {V_FILES} select ord, case when ord % 3 = 0 then review_id end as owner, case when ord % 3 = 0 then 'repo.x' end as repo, case when ord % 3 = 0 then ord end::int as number,
 md5('diff --git a/' || file_path || ' b/' || file_path || chr(10) || '--- a/' || file_path || chr(10) || '+++ b/' || file_path || chr(10) || content) as patch from v_files"""
MORE["pull_files"] = """with p as (select p_partkey as n, * from part) select (n // 100 + 1)::int as page, n as ord, p_name as file_path, p_brand as status, p_type as patch from p where n < 540"""
MORE["project_scan"] = f"""with {V_FILES}, f as (select ord, case ord % 6 when 0 then 'target/' when 1 then 'app/build/' when 2 then 'app/../' when 3 then '/' else 'app/' end || file_path as file_path, strlen(content) + case when ord % 6 = 4 then 11 else 0 end as n from v_files)
select 'source' as what, file_path from f where file_path like '%.java' and ord % 6 in (2, 3, 5) union all select 'guarded', file_path from f where ord % 6 in (1, 5) and n <= 2000"""
MORE["vector_store"] = """with v as (select vec_id, case when vec_id % 3 = 1 then list_transform(embedding, lambda x: -x) else embedding end as e from embeddings where vec_id % 7 <> 2), q as (select embedding as q from embeddings order by vec_id limit 1),
s as (select 'v' || vec_id as chunk_id, list_sum(list_transform(list_zip(e, q), lambda z: z[1]::double * z[2]::double)) as s from v, q)
select chunk_id, round(s, 4) as score, (select count(*) from v) as "left" from s order by round(s, 9) desc, chunk_id limit 10"""
MORE["embedded"] = """select doc_id::varchar as chunk_id, case when length(coalesce(text, '')) % 5 <> 0 then length(coalesce(text, '')) end::double as x, case when length(coalesce(text, '')) % 5 = 0 then 'no' end as error from documents"""
MORE["agent_replies"] = f"""with {V_FILES}, r as (select *, unnest(['security', 'logic', 'quality']) as reviewer from v_files) select review_id, ord::int as chunk, reviewer,
 case when reviewer <> 'logic' or length(content) % 2 = 0 then reviewer || ':' || length(content) end as reply, case when reviewer = 'logic' and length(content) % 2 = 1 then 'server' end as kind from r"""
MORE["posted_comments"] = f"""with {V_ISSUES}, {REASON} select case when (case when line is null or line = 0 then 1 else line end) % 7 = 0 then 'skipped' else 'single' end as outcome, count(*) as n from v_marked where reason is null group by 1"""
MORE["metered_issues"] = f"""with {V_ISSUES} select count(*) as total, count(*) filter (severity = 'CRITICAL') as critical, count(*) filter (severity = 'WARNING') as warning, count(*) filter (severity = 'INFO') as info, true as timed from v_issues"""
MORE["queue_round_trip"] = """select 't' || event_id as task_id, case when event_id % 2 = 0 then 'r' else 't' end || event_id as request_id, case event_type when 'error' then 'agent' when 'view' then 'pipeline' else 'simple' end as queue, case when value > 100 then 9 else 5 end::int as priority from events"""
MORE["stream_breaker"] = SQL["breaker_state"]
MORE["live_resources"] = """select user_id as session_id, event_id from events where user_id in (select user_id from events group by 1 having min(ts) <= timestamp '2024-01-01 06:00:00' and min(ts) > timestamp '2024-01-01 04:00:00')"""
MORE["diff_without_excluded"] = f"""with {V_LINES}, t as (select file_path, any_value(review_id) as review_id, string_agg(case when p % 10 = 0 then '@@ -' || (p + 1) || ',10 +' || (p + 1) || ',10 @@' || chr(10) else '' end || case p % 4 when 0 then ' ' when 3 then '-' else '+' end || x, chr(10) order by p) as body from v_lines group by 1)
select review_id as diff_id, file_path, md5(rtrim('diff --git a/' || file_path || ' b/' || file_path || chr(10) || '--- a/' || file_path || chr(10) || '+++ b/' || file_path || chr(10) || body, chr(10))) as content from t where not regexp_matches(file_path, '^src[0-9]*/[0-9]*[05][.]')"""
MORE["overlapping_ranges"] = f"""with {DIFF}, y as (select file_path, b * 10 + 1 + p - b * 10 - ((p + 1) // 4 - (b * 10 + 1) // 4) as f from v_diff where m in (1, 2)), r as (select file_path, ord % 9 + 1 as s, ord % 9 + 1 + ord % 2 as e from v_files)
select file_path as diff_id, s::int as start_line, e::int as end_line from r where file_path not in (select file_path from y) or exists (select 1 from y where y.file_path = r.file_path and f between s and e)"""
MORE["allowed_files"] = f"""with {V_FILES} select ord, case when ord % 3 = 0 then file_path else 'all|of them' end as paths from v_files"""
MORE["batch_merge"] = f"""with {V_ISSUES}, p as (select review_id, ord % 4 as k, count(distinct file) as files, max(severity = 'CRITICAL') as crit, string_agg(ord::varchar, ',' order by ord) as i from v_issues group by 1, 2)
select review_id, sum(files)::bigint as files, max(crit) as has_critical, string_agg('batch ' || k, chr(10) || chr(10) order by k) filter (k <> 2) as raw, md5(string_agg(i, ',' order by k)) as issues from p group by 1"""
MORE["parse_errors"] = f"""with {V_ISSUES}, e as (select file, ord, row_number() over (partition by file order by ord) as k from v_issues where ord % 2 = 0) select file as file_path, string_agg('e' || ord, '; ' order by ord) as parse_error from e where k <= 3 group by 1"""
MORE["preview_text"] = f"""with {V_FILES}, t as (select ord, replace(content, '. ', '.' || chr(10)) as c from v_files), l as (select ord, c, string_split(c, chr(10)) as x from t)
select ord, md5(case when len(x) > 5 then array_to_string(x[1:5], chr(10)) || chr(10) || '... (' || (len(x) - 5) || ' more)' else c end) as preview from l"""
MORE["merged_issues"] = f"""with {V_ISSUES}, k as (select *, file || chr(1) || lower(type) || chr(1) || case when line is not null then line::varchar else 'none' || chr(1) || lower(suggestion) end || chr(1) || lower(left(trim(regexp_replace(message, '\\s+', ' ', 'g')), 240)) as key, case severity when 'CRITICAL' then 3 when 'WARNING' then 2 else 1 end as r from v_issues),
o as (select *, row_number() over (partition by review_id, key order by r desc, ord) as nth from k) select review_id, severity, count(*) as n, count(*) filter (ord % 2 = 0) as static from o where nth = 1 group by 1, 2"""
MORE["safe_prompt"] = f"""with {V_FILES}, t as (select ord, review_id, regexp_replace(content || (list_value('</diff_input>', '</diff>', '</user_input>', '</other>', '<diff>'))[ord % 5 + 1] || ' end', '</(diff_input|diff|user_input)', '<\\\\/\\1', 'g') as c from v_files)
select ord, md5('<diff_input>' || c || '</diff_input> by ' || review_id || ', ' || review_id) as prompt from t"""
MORE["durations"] = """select event_id, case when event_id * 37 % 250 * 20 < 1000 then (event_id * 37 % 250 * 20) || 'ms' else printf('%.1fs', (event_id * 37 % 250 * 20) / 1000.0::double) end as took, ceil(event_id * 1.15::double)::bigint as claude, event_id as other from events"""
MORE["severity_maps"] = f"""with {V_ISSUES}, c as (select review_id, severity, count(*) as n from v_issues where ord % 3 = 0 or severity <> 'INFO' group by 1, 2)
select review_id, string_agg(severity || '=' || n, ',' order by severity) as counts, coalesce(string_agg(severity, ',' order by severity) filter (n % 2 = 0), '') as even from c group by 1"""
MORE["chunk_cases"] = "select review_id, chunk::int as chunk, entries from " + _values([("fits", 0, "0,1,2"), ("files", 0, "0,1,2"), ("files", 1, "3"), ("chars", 0, "0,2"), ("chars", 1, "1,3"), ("tokens", 0, "0,3"), ("tokens", 1, "1,2"), ("nothing", 0, "")], "review_id, chunk, entries")
MORE["hunk_cases"] = "select file_path, part::int as part, content from " + _values(
    [
        ("small.py", 0, "@@ -1 +1 @@\n-a\n+b\n"),
        ("two.py", 0, "--- a\n+++ b\n@@ -1,2 +1,2 @@\n a\n-b\n+c\n"),
        ("two.py", 1, "--- a\n+++ b\n@@ -9,2 +9,3 @@\n x\n+y\n z\n"),
        ("one.py", 0, "@@ -5,2 +5,2 @@ def f\n aaaaaaaaa\n-bbbbbbbbb\n+ccccccccc\n"),
        ("one.py", 1, "@@ -7,1 +7,2 @@ def f\n+ddddddddd\n eeeeeeeee\n"),
        ("none.txt", 0, "y" * 70),
    ],
    "file_path, part, content",
)
COMPACT = "md5('[DIFF_OMITTED_DUE_TO_SIZE]' || chr(10) || 'The diff of this chunk is over the model''s limit.' || chr(10) || 'Changed files:' || chr(10) || string_agg('- ' || file_path, chr(10) order by ord)) as text"
MORE["compact_cases"] = f"""with {V_FILES} select review_id, (ord % 3)::int as chunk, {COMPACT} from v_files group by 1, 2"""
# bins as a list that grows while the entries pass, heaviest first
PACKED = f"""{V_FILES.replace("v_files as", "v_files as materialized", 1)}, v_sized as materialized (select review_id, ord, file_path, length(content) as chars, case when token_count > 0 then token_count else greatest(1, length(content) // 4) end as tokens from v_files),
v_whole as materialized (select review_id from v_sized group by 1 having count(*) <= 10 and sum(chars) <= 60000 and sum(tokens) <= 12000),
v_queue as materialized (select *, row_number() over (partition by review_id order by greatest(chars, tokens * 4) desc, ord) as k from v_sized where review_id not in (select review_id from v_whole)),
v_steps as (
 select review_id, 0::bigint as k, null::bigint as ord, 0::bigint as chunk, []::struct(t bigint, c bigint, n bigint, i bigint)[] as bins from (select distinct review_id from v_queue)
 union all
 select review_id, k, ord, pick, case when pick > len(bins) then list_append(bins, {{'t': tokens, 'c': chars, 'n': 1, 'i': pick}}) else list_transform(bins, lambda b: case when b.i = pick then {{'t': b.t + tokens, 'c': b.c + chars, 'n': b.n + 1, 'i': b.i}} else b end) end
 from (select s.review_id, q.k, q.ord, q.tokens::bigint as tokens, q.chars::bigint as chars, s.bins,
  coalesce(list_sort(list_transform(list_filter(s.bins, lambda b: b.n < 10 and b.c + q.chars <= 60000 and b.t + q.tokens <= 12000), lambda b: {{'t': b.t, 'i': b.i}}))[1].i, len(s.bins) + 1) as pick
  from v_steps s join v_queue q on q.review_id = s.review_id and q.k = s.k + 1)),
v_chunks as (select v_sized.*, 0 as chunk from v_sized join v_whole using (review_id) union all select v_sized.*, s.chunk - 1 from v_sized join v_steps s on s.review_id = v_sized.review_id and s.ord = v_sized.ord)"""
MORE["chunk_ffd"] = f"""with recursive {PACKED} select review_id, ord, file_path, chars::bigint as chars, tokens::bigint as tokens, chunk::int as chunk from v_chunks"""
MORE["chunk_compact"] = f"""with recursive {PACKED} select review_id, chunk::int as chunk, {COMPACT} from v_chunks group by 1, 2"""
MORE["relevant_diff"] = f"""with {V_FILES} select file_path, md5(case when length(content) > 200 and length(content) - 200 < 0.85 * length(content) then left(content, length(content) - 200) else content end) as text from v_files"""
MORE["reviewer_section_text"] = (
    "with top as (" + SQL["reviewer_top50_top15"].replace("select reviewer, count(*)::int as nth, t.ord, t.severity from t", "select reviewer, count(*)::int as nth, t.ord, t.severity, any_value(t.file) as file, any_value(t.line) as line, any_value(t.type) as type, any_value(t.message) as message from t")
    + """), r as (select * from (values ('security', 0), ('logic', 1), ('quality', 2)) v(reviewer, k)),
i as (select r.k, r.reviewer, count(top.ord) as n, coalesce(string_agg('{"severity":"' || severity || '","file":"' || file || '"' || case when line is not null then ',"line":' || line else '' end || ',"type":"' || type || '","message":"' || message || '"}', ',' order by nth), '') as x from r left join top using (reviewer) group by 1, 2),
w as (select string_agg(chr(10) || '[' || reviewer || ']{"summary":"' || reviewer || ' done","issue_count":' || n || ',"issues":[' || x || ']}' || chr(10), '' order by k) as t from i)
select md5(s) as section, length(s)::int as n from (select case when length(t) > 8000 then left(t, 8000) || chr(10) || '...(truncated)' else t end as s from w)"""
)
MORE["class_index"] = "select * from " + _values(
    [
        *[("path", c, f"src/shop/{p}.java") for c, p in (("OrderController", "OrderController"), ("OrderService", "service/OrderService"), ("BaseService", "service/BaseService"), ("Helper", "service/BaseService"), ("OrderDao", "dao/OrderDao"), ("SqlOrderDao", "dao/SqlOrderDao"))],
        ("implementations", "OrderDao", "SqlOrderDao"),
        ("parent", "OrderService", "BaseService"),
        *[("methods", c, m) for c, m in (("OrderController", "handle"), ("OrderService", "process,validate"), ("Helper", "help"), ("OrderDao", "save"), ("SqlOrderDao", "save,write"))],
    ],
    "kind, name, value",
)
MORE["callee_lists"] = "select * from " + _values(
    [("OrderController", "handle", "isEmpty, process"), ("OrderService", "process", "split, validate, save"), ("OrderService", "validate", "length, substring"), ("Helper", "help", "log"), ("SqlOrderDao", "save", "write")], "owner, caller, callees"
)
MORE["graph_relations"] = "select * from " + _values(
    [
        ("implementations", "OrderDao.java:OrderDao", "SqlOrderDao"),
        ("parent", "OrderService.java:OrderService", "BaseService"),
        ("subclasses", "BaseService.java:BaseService", "OrderService"),
        ("members", "SqlOrderDao.java:SqlOrderDao", "save"),
        ("members", "SqlOrderDao.java:SqlOrderDao", "write"),
        ("members", "BaseService.java", "BaseService"),
        ("members", "BaseService.java", "Helper"),
        ("callers", "OrderDao.java:OrderDao.save(String)", "process"),
        ("callees", "OrderController.java:OrderController.handle(String)", "process"),
    ],
    "relation, node, name",
)
MORE["graph_hierarchy"] = "select * from " + _values([("OrderService", "BaseService")], "class_name, parent")
MORE["graph_query_verbs"] = "select * from " + _values([("callers", "process"), ("callees", "save"), ("callees", "validate")], "verb, name")
MORE["other_language"] = """select kind, name, count(*) as n from (
 select 'method' as kind, case k when 0 then 'a' || user_id else 'b' end as name from events, (values (0), (1)) v(k) where event_id % 2 = 0 union all
 select case k when 0 then 'type' when 1 then 'method' else 'modifiers' end, case k when 0 then 'C' || user_id else 'm' end from events, (values (0), (1), (2)) v(k) where event_id % 2 = 1) group by 1, 2"""
MORE["index_project"] = f"""with {TERMS}, p as (select doc_id, source || '/' || doc_id || case lang when 'en' then '.java' when 'fr' then '.py' when 'de' then '.ts' else '.md' end || '.java' as file_path from documents)
select file_path, count(*) as terms, round(sum(weight * weight), 6) as norm from v_weight join p using (doc_id) group by 1"""
MORE["tool_calls"] = "select tool, argument, n::bigint as n, ok from " + _values(
    [
        ("get_file_content", "src/shop/dao/OrderDao.java", 1, True),
        ("get_file_content", "src/shop/Broken.java", 0, True),
        ("get_diff_context", "src/shop/Broken.java", 1, True),
        ("get_method_definition", "SqlOrderDao.save", 1, True),
        ("get_method_definition", "save", 2, True),
        ("get_call_graph", "impact OrderDao.save", 2, True),
        ("get_call_graph", "who knows", 1, False),
        ("get_related_files", "OrderService", 4, True),
        ("semantic_search", "order dao save", 5, True),
        ("nothing", "x", 1, False),
    ],
    "tool, argument, n, ok",
)
MORE["polled"] = "select need::int as need, looks::int as looks, outcome from " + _values([(3, 3, "done"), (99, 4, "timeout")], "need, looks, outcome")

# --- the literal project: facts, graph, slices --------------------------------------

P = {"C": "src/shop/OrderController.java", "S": "src/shop/service/OrderService.java", "B": "src/shop/service/BaseService.java", "D": "src/shop/dao/OrderDao.java", "Q": "src/shop/dao/SqlOrderDao.java"}
#: Types (file, name, owner, kind, parent, first line, last line), methods (file, owner, name, returns, view, lines) and calls (file, owner, callee, caller, scope, line).
TYPES = [("C", "OrderController", "", "class", "", 3, 11), ("S", "OrderService", "", "class", "BaseService", 3, 19), ("B", "BaseService", "", "class", "", 2, 7), ("B", "Helper", "BaseService", "class", "", 4, 6), ("D", "OrderDao", "", "interface", "", 2, 4), ("Q", "SqlOrderDao", "", "class", "", 2, 8)]
METHODS = [
    ("C", "OrderController", "handle", "String", "public", 5, 10),
    ("S", "OrderService", "process", "String", "public", 5, 13),
    ("S", "OrderService", "validate", "void", "private", 14, 18),
    ("B", "Helper", "help", "void", "package", 5, 5),
    ("D", "OrderDao", "save", "String", "package", 3, 3),
    ("Q", "SqlOrderDao", "save", "String", "public", 4, 6),
    ("Q", "SqlOrderDao", "write", "String", "package", 7, 7),
]
CALLS = [("C", "OrderController", "isEmpty", "handle", "id", 6), ("C", "OrderController", "process", "handle", "orderService", 9), ("S", "OrderService", "split", "process", "id", 6), ("S", "OrderService", "validate", "process", "", 7), ("S", "OrderService", "save", "process", "orderDao", 12),
         ("S", "OrderService", "length", "validate", "id", 15), ("S", "OrderService", "substring", "validate", "id", 16), ("B", "Helper", "log", "help", "", 5), ("Q", "SqlOrderDao", "write", "save", "", 5)]
MORE["code_facts"] = "select file_path, kind, owner, name, type, detail, start_line::int as start_line, end_line::int as end_line from " + _values(
    [
        *[(P[f], "type", owner, name, kind, up, s, e) for f, name, owner, kind, up, s, e in TYPES],
        *[(P[f], "method", owner, name, returns, view, s, e) for f, owner, name, returns, view, s, e in METHODS],
        *[(P[f], "call", owner, callee, caller, scope, n, n) for f, owner, callee, caller, scope, n in CALLS],
    ],
    "file_path, kind, owner, name, type, detail, start_line, end_line",
)


def _method(f: str, owner: str, name: str) -> str:
    return f"method:{P[f]}:{owner}.{name}({'' if name == 'help' else 'String'})"


MORE["code_graph_build"] = "select * from " + _values(
    [
        *[(f"file:{P[f]}", f"class:{P[f]}:{name}", "CONTAINS") for f, name, *_ in TYPES],
        *[(f"class:{P[f]}:{owner}", _method(f, owner, name), "CONTAINS") for f, owner, name, *_ in METHODS],
        (f"class:{P['S']}:OrderService", f"class:{P['B']}:BaseService", "EXTENDS"),
        (f"class:{P['Q']}:SqlOrderDao", f"class:{P['D']}:OrderDao", "IMPLEMENTS"),
        (_method("C", "OrderController", "handle"), _method("S", "OrderService", "process"), "CALLS"),
        (_method("S", "OrderService", "process"), _method("S", "OrderService", "validate"), "CALLS"),
        (_method("S", "OrderService", "process"), _method("D", "OrderDao", "save"), "CALLS"),
        (_method("Q", "SqlOrderDao", "save"), _method("Q", "SqlOrderDao", "write"), "CALLS"),
        (f"file:{P['C']}", f"file:{P['S']}", "IMPORTS"),
        (f"file:{P['S']}", f"file:{P['D']}", "IMPORTS"),
    ],
    "src, dst, type",
)
_SOURCE = "f as (select *, string_split(content, chr(10)) as x from " + _values(list(fixtures.PROJECT), "file_path, content") + ")"
MORE["method_slices"] = (
    f"with {_SOURCE}, s as (select * from "
    + _values(
        [*[(f"method:{o}.{n}({'' if n == 'help' else 'String'})", "METHOD", P[f], s, e) for f, o, n, _, _, s, e in METHODS], *[(f"{kind}:{name}", "CLASS", P[f], s, e) for f, name, _, kind, _, s, e in TYPES]],
        "chunk_id, granularity, file_path, s, e",
    )
    + """) select chunk_id, granularity, file_path, s::int as start_line, e::int as end_line, md5(array_to_string(x[s:e], chr(10))) as content from s join f using (file_path)
union all select 'file:' || file_path, 'FILE', file_path, 1, len(x)::int, md5(content) from f"""
)
#: The longest context within a fifth of 900 tokens: here the full one of every file that has facts.
CONTEXTS = [
    ("src/shop/Broken.java", ""),
    (P["C"], "class OrderController\n  public String handle(String) lines 5-10 calls isEmpty, process"),
    (P["S"], "class OrderService\n  public String process(String) lines 5-13 calls split, validate, save\n  private void validate(String) lines 14-18 calls length, substring"),
    (P["B"], "class BaseService\nclass Helper\n  package void help() lines 5-5 calls log"),
    (P["D"], "interface OrderDao\n  package String save(String) lines 3-3"),
    (P["Q"], "class SqlOrderDao\n  public String save(String) lines 4-6 calls write\n  package String write(String) lines 7-7"),
]
MORE["context_enrichment"] = f"""with {_SOURCE}, c as (select * from {_values(CONTEXTS, "file_path, context")})
select file_path, context, case when context = '' then 900 else (length(context) + 2 + length(content)) // 4 end::int as token_count from f join c using (file_path)"""

SQL.update(MORE)
