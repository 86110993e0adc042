"""SQL of the core's queries, for DuckDB."""

from __future__ import annotations

from knotwork.plans.relations import graph_sql

# a path in one form: white space, separators, doubled separators and '.' by replacement; 'x/..' is taken back up to
# eight times, which is more than any path here nests
_CLEAN = r"regexp_replace(regexp_replace(replace(regexp_replace(anchor_file, '^\s+|\s+$', '', 'g'), '\', '/'), '(^|/)(\./)+', '\1', 'g'), '/{2,}', '/', 'g')"


def _path() -> str:
    p = f"regexp_replace({_CLEAN}, '(^|/)(\\./)+', '\\1', 'g')"
    for _ in range(8):
        p = f"regexp_replace({p}, '(^|/)(?:[^/.][^/]*|\\.[^/.][^/]*)/\\.\\./', '\\1')"
    return p


_ORPHANS = f"""with a as (select anchor_id, min(decision_id) as decision_id, min(anchor_kind) as anchor_kind, min({_path()}) as file, min(coalesce(anchor_name, '')) as name
 from decision_anchors where anchor_kind in ('function', 'file') group by anchor_id),
d as (select id, min(cast(created_at as timestamp)) as t from decisions group by id),
f as (select file, name, min(indexed_at) as first_at, bool_or(removed_at is null) as present from nodes where name <> '' group by file, name),
g as (select file, min(indexed_at) as first_at, bool_or(removed_at is null) as present from nodes group by file),
r as (select anchor_id, anchor_kind, t, case when anchor_kind = 'file' then g.first_at else f.first_at end as first_at, case when anchor_kind = 'file' then g.present else f.present end as present
 from a left join d on d.id = decision_id left join f on a.anchor_kind = 'function' and f.file = a.file and f.name = a.name left join g on a.anchor_kind = 'file' and g.file = a.file),
o as (select anchor_id, anchor_kind, t, case when present is null then 'missing' when not present then 'deleted' when first_at > t then 'late' end as orphan_kind from r)"""

ORACLES: dict[str, str] = {
    "p5_found": f"{_ORPHANS} select anchor_id, orphan_kind from o where orphan_kind is not null",
    "p5_report": f"{_ORPHANS} select anchor_kind, strftime(t, '%Y-%m') as month, orphan_kind, count(*) as n_anchors from o where orphan_kind is not null group by 1, 2, 3",
}

_TRIMMED = "select file, arg_max(functions, indexed_at) as functions, arg_max(imports, indexed_at) as imports, arg_max(had_parse_errors, indexed_at) as bad, arg_max(duplicate_function_names, indexed_at) as dup from parsed_files where file is not null group by file"
_PROBES = [e for e in (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")]
_PROBES = [*_PROBES, *("/index" + e for e in _PROBES), ""]
_PARSED = f"""p as ({_TRIMMED}),
f as (select file, unnest(functions, recursive := false) as x, generate_subscripts(functions, 1) - 1 as ord from p),
fn as (select file, ord, x.name as name, x.start_line as start_line, x.end_line as end_line, x.calls as calls from f),
c as (select file, name as caller, unnest(calls) as callee from fn),
i0 as (select file, unnest(imports) as x, generate_subscripts(imports, 1) - 1 as ord from p),
i1 as (select file, ord, x.local_name as local_name, x.imported_name as imported_name, x.module_specifier as module_specifier, x.is_default as is_default, x.is_namespace as is_namespace from i0),
b as (select *, case when module_specifier[1:1] in ('.', '/') then array_to_string(list_concat(list_slice(string_split(file, '/'), 1, len(string_split(file, '/')) - 1 - (length(module_specifier) - length(replace(module_specifier, '../', ''))) // 3), [regexp_replace(module_specifier, '^(\\.\\.?/)*', '')]), '/') end as base from i1),
pr as (select b.file, b.ord, q.pos, b.base || q.tail as path from b, (select unnest(range(13)) as pos, unnest([{", ".join("'" + e + "'" for e in _PROBES)}]) as tail) q),
im as (select b.* exclude (base), (select arg_min(pr.path, pr.pos) from pr where pr.file = b.file and pr.ord = b.ord and pr.path in (select file from p)) as resolved_file from b),"""


def _resolved(nodes: str, first: str) -> str:
    return f"""i as (select * from (select *, row_number() over (partition by file, local_name order by ord) as rn from {first}) where rn = 1),
k as (select c.*, i.local_name is not null as has, i.resolved_file, case when contains(c.callee, '.') then 'member_chain' when i.local_name is not null and i.resolved_file is null then 'external' when i.is_namespace then 'namespace_import' when i.is_default then 'default_import' end as early,
 case when i.local_name is not null then i.resolved_file else c.file end as kf, case when i.local_name is not null then i.imported_name else c.callee end as kn from c left join i on i.file = c.file and i.local_name = c.callee),
n as (select distinct file, name from {nodes}),
r as (select k.*, case when early is null then n.file end as target_file, case when early is null then n.name end as target_name, coalesce(early, case when n.file is null then case when has then 'barrel_miss' else 'unknown_bare' end end) as reason from k left join n on early is null and n.file = kf and n.name = kn)"""


_NATIVE = f"with {_PARSED} {_resolved('fn', 'im')}"
_EDGES = "select file as source_file, caller as source_name, target_file, target_name, count(*) as count, 'calls' as kind from r where reason is null group by 1, 2, 3, 4"
_OUTCOMES = "select x.reason, coalesce(n, 0) as n from (select unnest(['member_chain', 'external', 'default_import', 'namespace_import', 'barrel_miss', 'unknown_bare']) as reason) x left join (select reason, count(*) as n from r group by 1) y on x.reason = y.reason"

_G = f"""with g as ({graph_sql('g_node_inputs')}), gn as (select file, name, kind, start_line, end_line from (select *, row_number() over (partition by file, name order by ord) as rn from g) where rn = 1),
im as ({graph_sql('g_imports')}), c as ({graph_sql('g_calls')}), {_resolved('gn', 'im')}"""
_PRESENT = "n as (select file, name, min(id) as id, max(struct_pack(t := indexed_at, s := start_line, e := end_line)) as x from nodes where removed_at is null and file is not null and name is not null group by file, name), nn as (select id, file, name, 'function' as kind, x.s as start_line, x.e as end_line from n)"
_STORE = """d as (select id, x.decision as decision, x.session_id as session_id, x.created_at as created_at from (select id, min(struct_pack(decision := decision, session_id := session_id, created_at := created_at)) as x from decisions where id is not null group by id)),
a as (select distinct decision_id, anchor_kind, anchor_file, coalesce(anchor_name, '') as anchor_name from decision_anchors),
kw as (select distinct decision_id, keyword from decision_keywords where keyword is not null)"""
_LIVE = f"with {_PRESENT}, {_STORE}, l as (select a.*, case when anchor_kind = 'function' then exists (select 1 from nn where nn.file = a.anchor_file and nn.name = a.anchor_name) else exists (select 1 from nn where nn.file = a.anchor_file) end as live from a)"
def _sessions(events: str) -> str:
    """x: every decision that a read meets, rn 1 where it is new; pr and s before it."""
    return f"""e as ({events}), pr as ({graph_sql('s_pairs')}),
s as (select seq, coalesce(session_id, '_default') as session_id, op, file, sum(case when op in ('clear', 'end') then 1 else 0 end) over (partition by coalesce(session_id, '_default') order by seq rows unbounded preceding) as ep_s, sum(case when op = 'reset_all' then 1 else 0 end) over (order by seq rows unbounded preceding) as ep_g from e),
x as (select s.seq, s.session_id, s.file, pr.decision_id, row_number() over (partition by s.session_id, ep_s, ep_g, pr.decision_id order by s.seq) as rn from s join pr on pr.file = s.file where s.op = 'read')"""


_SESSIONS = f"with {_sessions(graph_sql('s_events'))}"
_STATE = f"""{_SESSIONS}, lr as (select coalesce(max(seq), -1) as al from e where op = 'reset_all'), lo as (select session_id, max(seq) as own from s where op in ('clear', 'end') group by 1),
st as (select distinct s.session_id, pr.decision_id from s join pr on pr.file = s.file left join lo on lo.session_id = s.session_id cross join lr where s.op = 'read' and s.seq > coalesce(own, -1) and s.seq > al)"""
# a state lives from the first write after the last end; a reset of all writes it again
_STATES = f"""{_STATE}, ev as (select s.*, (select any_value(e.ts) from e where e.seq = s.seq) as ts from s where op in ('clear', 'end') or op = 'read' and file in (select file from pr)),
en as (select session_id, coalesce(max(case when op = 'end' then seq end), -1) as ended from ev group by 1),
lv as (select ev.session_id, min(seq) as born, max(seq) as last, arg_max(ts, seq) as last_ts from ev join en on en.session_id = ev.session_id where seq > ended group by 1),
ra as (select max(seq) as al, arg_max(ts, seq) as al_ts from e where op = 'reset_all'),
sts as (select lv.session_id, case when al > last and al > born then al_ts else last_ts end as modified_at, (select count(*) from st where st.session_id = lv.session_id) as n_shown, coalesce((select string_agg(cast(decision_id as varchar), ',' order by decision_id) from st where st.session_id = lv.session_id), '') as shown from lv cross join ra)"""


def _texts(events: str) -> str:
    """r: the text of every read, its lines cut at the budget."""
    return f"""with {_sessions(events)}, {_STORE},
rd as (select seq, session_id, file, count(*) as total, count(*) filter (rn = 1) as fresh from x group by 1, 2, 3),
pl as (select decision_id, anchor_file as file, bool_or(anchor_kind = 'file') as whole from a where anchor_file is not null group by 1, 2),
fn as (select distinct decision_id, anchor_file as file, anchor_name as name from a where anchor_kind = 'function'),
kl as (select decision_id, string_agg(keyword, ', ' order by keyword) as k from kw group by 1),
pc as (select x.seq, x.decision_id, '' as place from x join pl using (decision_id, file) where rn = 1 and whole union all select x.seq, x.decision_id, fn.name from x join pl using (decision_id, file) join fn using (decision_id, file) where rn = 1 and not whole),
td as (select seq, place, 1 as rank, created_at, d.id, '  [' || coalesce(k, '') || '] ' || coalesce(decision, '') as line from pc join d on d.id = pc.decision_id left join kl on kl.decision_id = d.id),
tt as (select distinct seq, place, 0 as rank, null as created_at, null as id, case when place = '' then 'file-level:' else 'fn ' || place || '():' end as line from td),
ft as (select seq, total - fresh as seen from rd where total > fresh and fresh > 0),
fl as (select seq, 1 as n, '' as line from ft union all select seq, 2, '(' || seen || ' decision' || case when seen > 1 then 's' else '' end || ' on this file already shown earlier this session.' from ft union all select seq, 3, 'If your context was compacted, reset the decision cache.)' from ft),
ln as (select seq, 0 as part, row_number() over (partition by seq order by place, rank, created_at desc nulls last, id) as n, line from (select * from td union all select * from tt) union all select seq, 1, n, line from fl),
hd as (select *, '[decisions] ' || total || ' decisions on ' || file || ' (' || fresh || ' new' || case when total > fresh then ', ' || (total - fresh) || ' shown earlier' else '' end || ')' || chr(10) || chr(10) || 'NEW:' as head from rd),
lm as (select ln.*, length(head) + sum(length(line) + 1) over (partition by ln.seq order by part, n rows unbounded preceding) as until from ln join hd on hd.seq = ln.seq),
lt as (select seq, max(until) as whole, count(*) as n_lines, count(*) filter (until <= 7800) as fits, string_agg(line, chr(10) order by part, n) as every, string_agg(line, chr(10) order by part, n) filter (until <= 7800) as first_lines from lm group by 1),
r as (select hd.seq, session_id, file, case when fresh = 0 then '[decisions] ' || total || ' decisions on ' || file || ' shown earlier this session.' || chr(10) || '(reset the decision cache if context was compacted)'
 when coalesce(whole, length(head)) <= 8000 then head || coalesce(chr(10) || every, '')
 else head || coalesce(chr(10) || first_lines, '') || chr(10) || chr(10) || '(' || (n_lines - fits) || ' additional lines truncated; ' || total || ' decisions total on this file; list them by keyword)' end as text from hd left join lt on lt.seq = hd.seq)"""


_REPLY = "cast(to_json({'hookSpecificOutput': {'hookEventName': 'PreToolUse', 'permissionDecision': 'allow', 'additionalContext': text}}) as varchar)"
_HOOKED = f"""select seq, session_id, op, case when op <> 'read' then null when q like '/work/%' then substr(q, 7) when q like '/%' or q like '../%' then null else q end as file
 from (select *, case when seq % 11 = 0 then '/other/' || file when seq % 2 = 0 then '/work/' || file else file end as q from ({graph_sql('s_events')})) where op <> 'read' or (seq % 13 <> 0 and coalesce(q, '') <> '')"""
_ENTRY = "'#' || d.id || ' [' || coalesce((select string_agg(keyword, ', ' order by keyword) from kw where kw.decision_id = d.id), '') || '] ' || coalesce(decision, '') || coalesce(chr(10) || '  anchors:' || chr(10) || (select string_agg('    ' || case when anchor_kind = 'function' then 'function ' || anchor_file || '::' || anchor_name else 'file ' || anchor_file end || case when live then ' (live)' else ' (dead)' end, chr(10) order by anchor_kind, anchor_file, anchor_name) from l where l.decision_id = d.id), '') || chr(10)"


def _listing(keyword: str) -> str:
    return f"""(select case when n = 0 then '0 decisions tagged "{keyword}"' else regexp_replace(n || ' decision' || case when n = 1 then '' else 's' end || ' tagged "{keyword}":' || chr(10) || chr(10) || body || case when n > 50 then chr(10) || '(50 of ' || n || ' shown; refine the keyword)' else '' end, '\\s+$', '') end
 from (select count(*) as n, string_agg(entry, chr(10) order by k) filter (k <= 50) as body from (select row_number() over (order by created_at desc, id) as k, {_ENTRY} as entry from d where id in (select decision_id from kw where keyword = '{keyword}'))))"""


_FAULTS = f"""with {_STORE}, an as (select decision_id, anchor_kind as kind, anchor_file as file, case when anchor_kind = 'function' then anchor_name end as name from a),
ai as (select *, row_number() over (partition by decision_id order by kind nulls first, file nulls first, name nulls first) - 1 as i from an), ki as (select *, row_number() over (partition by decision_id order by keyword) - 1 as i from kw),
z as (select id as decision_id, 0 as g, 0 as i, 0 as h, 'decisions[0].decision must be a non-empty string' as error from d where coalesce(decision, '') = ''
 union all select id, 1, 0, 0, 'decisions[0].anchors must be an array' from d where id not in (select decision_id from an where decision_id is not null)
 union all select decision_id, 1, i, 1, 'decisions[0].anchors[' || i || replace('].kind must be `function` or `file`', '`', chr(39)) from ai where kind is null or kind not in ('function', 'file')
 union all select decision_id, 1, i, 2, 'decisions[0].anchors[' || i || '].file must be a non-empty string' from ai where coalesce(file, '') = ''
 union all select decision_id, 1, i, 3, 'decisions[0].anchors[' || i || replace('].name required when kind=`function`', '`', chr(39)) from ai where kind = 'function' and coalesce(name, '') = ''
 union all select id, 2, 0, 0, 'decisions[0].keywords must be an array' from d where id not in (select decision_id from kw where decision_id is not null)
 union all select decision_id, 2, i, 1, 'decisions[0].keywords[' || i || '] "' || keyword || '" must match ^[a-z][a-z0-9-]{{0,38}}[a-z0-9]$' from ki where not regexp_full_match(keyword, '[a-z][a-z0-9-]{{0,38}}[a-z0-9]')),
y as (select decision_id, cast(row_number() over (partition by decision_id order by g, i, h) - 1 as int) as ord, error from z where decision_id in (select id from d))"""
_G_IDS = f"{_G}, ids as (select *, row_number() over (order by file, name) as id from (select distinct file, name from g)), ed as (select s.id as source_id, t.id as target_id, 'calls' as kind, count(*) as count from r join ids s on s.file = r.file and s.name = r.caller join ids t on t.file = r.target_file and t.name = r.target_name where reason is null group by 1, 2)"

ORACLES |= {
    "resolved_edges": f"{_NATIVE} {_EDGES}",
    "call_outcomes": f"{_NATIVE} {_OUTCOMES}",
    "index_totals": f"{_NATIVE} select (select count(*) from p) as files, (select count(*) from fn) as functions, count(*) as calls, count(*) filter (reason is null) as resolved, count(reason) as unresolved, (select count(*) filter (bad) from p) as files_with_parse_errors from r",
    "import_resolution": f"with {_PARSED[:-1]} select file, ord, local_name, module_specifier, resolved_file from im",
    "function_registry": f"with {_PARSED[:-1]} select file, name, start_line, end_line from (select *, row_number() over (partition by file, name order by ord) as rn from fn) where rn = 1",
    "duplicate_functions": f"with p as ({_TRIMMED}) select file, name, count(*) as n_dropped from (select file, unnest(dup) as name from p) group by 1, 2",
    "scanned_files": r"""select distinct file, case when lower(regexp_extract(file, '\.([^./]+)$', 1)) = 'ts' then 'typescript' when lower(regexp_extract(file, '\.([^./]+)$', 1)) = 'tsx' then 'tsx' else 'javascript' end as language from parsed_files
 where regexp_matches(file, '\.(ts|tsx|js|jsx|mjs|cjs)$') and not regexp_matches(file, '(^|/)(node_modules|dist|build|out|\.git|\.ctx|__tests__|\.next|\.turbo|\.vercel|\.cache|coverage)/') and not regexp_matches(file, '(\.test\.(ts|tsx|js)|\.spec\.(ts|js)|\.config\.(ts|tsx|js|mjs|cjs)|\.d\.ts|\.min\.js|\.bundle\.js)$') and not regexp_matches(file, '(^|/)\.[^/]')""",
    "g_first_definitions": f"{_G} select * from gn",
    "g_duplicate_definitions": f"{_G} select file, name, count(*) - 1 as n_dropped from g group by 1, 2 having count(*) > 1",
    "g_call_outcomes": f"{_G} {_OUTCOMES}",
    "g_resolved_edges": f"{_G} {_EDGES}",
    "g_upserted_nodes": f"{_G} select file, name, arg_max(start_line, ord) as start_line, arg_max(end_line, ord) as end_line, count(*) as n_inputs from g group by 1, 2",
    "g_inserted_edges": f"{_G} select file as source_file, caller as source_name, target_file, target_name, 2 * count(*) as count from r where reason is null group by 1, 2, 3, 4",
    "g_innermost": f"{_G}, e as ({graph_sql('g_events')}), q as (select seq, file, cast(seq % 450 + 1 as int) as line from e) select q.seq, q.file, q.line, x.s as start_line, x.e as end_line, x.n as name from (select q.seq, min(struct_pack(w := end_line - start_line, n := gn.name, s := start_line, e := end_line)) as x from q join gn on gn.file = q.file and q.line between start_line and end_line group by q.seq) z join q on q.seq = z.seq",
    "node_by_id": f"with {_PRESENT} select * from nn where id = 2",
    "nodes_by_name": f"with {_PRESENT} select id, file, name, start_line, end_line from nn where name = (select min(name) from nn)",
    "nodes_by_file": f"with {_PRESENT} select id, file, name, start_line, end_line from nn where file = (select min(file) from nn)",
    "edges_from_node": f"{_G_IDS} select * from ed where source_id = 3",
    "edges_to_node": f"{_G_IDS} select * from ed where target_id = 11",
    "edge_degrees": f"{_G_IDS} select ids.id, file, name, n_targets, cast(n_calls as bigint) as n_calls, n_sources from ids left join (select source_id, count(*) as n_targets, sum(count) as n_calls from ed group by 1) o on o.source_id = ids.id left join (select target_id, count(*) as n_sources from ed group by 1) i on i.target_id = ids.id",
    "table_counts": f"{_NATIVE}, ed as ({_EDGES}) select (select count(*) from (select distinct file, name from nodes where removed_at is null and file is not null and name is not null)) as n_nodes, (select count(*) from ed) as n_edges",
    "decisions_for_function": f"with {_PRESENT}, {_STORE} select distinct nn.file, nn.name, d.id as decision_id from nn join a on a.anchor_file = nn.file and (a.anchor_kind = 'file' or a.anchor_name = nn.name) join d on d.id = a.decision_id",
    "decisions_for_file": f"with {_STORE}, w as (select distinct file from parsed_files where file is not null) select distinct w.file, d.id as decision_id, d.created_at, d.session_id from w join a on a.anchor_file = w.file join d on d.id = a.decision_id",
    "decisions_by_keyword": f"with {_STORE} select id, decision, session_id, created_at from d where id in (select decision_id from kw where keyword = 'ordering')",
    "anchor_liveness": f"{_LIVE} select decision_id, anchor_kind, anchor_file, anchor_name, live from l",
    "live_anchor_count": f"{_LIVE} select count(*) as total, coalesce(cast(sum(cast(live as bigint)) as bigint), 0) as live from l",
    "keywords_of_decisions": f"with {_STORE} select decision_id, string_agg(keyword, '|' order by keyword) as keywords from kw group by 1",
    "anchors_of_decisions": f"{_LIVE} select decision_id, string_agg(case when anchor_kind = 'function' then 'function ' || anchor_file || '::' || anchor_name else 'file ' || anchor_file end || case when live then ' (live)' else ' (dead)' end, '|' order by anchor_kind, anchor_file, anchor_name) as anchors from l group by 1",
    "vocabulary_top": f"with {_STORE} select keyword, count(*) as n from kw group by 1 order by n desc, keyword limit 100",
    "kept_children": f"with {_STORE}, s as (select id from d where session_id is not null) select (select count(*) from a where decision_id in (select id from s)) as n_anchors, (select count(*) from kw where decision_id in (select id from s)) as n_keywords",
    "keywords_of_listed": f"with {_STORE} select decision_id, string_agg(keyword, '|' order by keyword) as keywords from kw where decision_id % 20 = 0 group by 1",
    "anchors_of_listed": f"{_LIVE} select decision_id, cast(count(*) as int) as n_anchors from l where decision_id % 20 = 0 group by 1",
    "live_of_listed": f"{_LIVE} select count(*) as total, coalesce(cast(sum(cast(live as bigint)) as bigint), 0) as live from l where decision_id % 20 = 0",
    "session_reads": f"{_SESSIONS} select seq, session_id, count(*) as total, cast(sum(case when rn = 1 then 1 else 0 end) as bigint) as new_cnt from x group by 1, 2",
    "session_new_decisions": f"{_SESSIONS} select seq, session_id, decision_id from x where rn = 1",
    "session_read_decisions": f"{_SESSIONS} select seq, session_id, decision_id, rn = 1 as is_new from x",
    "session_state": f"{_STATE} select * from st",
    "session_states": f"{_STATES} select session_id, modified_at, shown from sts",
    "session_shown": f"{_STATE} select decision_id from st where session_id = '_default'",
    "session_written": f"{_STATES} select session_id, modified_at, cast(n_shown as int) as n_shown from sts where session_id <> 's1' and session_id <> 'new' union all select 's1', timestamp '2030-01-01', 0 union all select 'new', timestamp '2030-01-01', 2",
    "session_wiped": f"{_STATES} select session_id, 0 as n_shown from sts",
    "session_kept": f"{_STATES} select session_id from sts where session_id <> 's2' and modified_at >= (select max(modified_at) from sts) + interval 12 hour - interval 1 day",
    "reset_message": f"{_STATES} select 'decision cache reset (' || count(*) || ' session file' || case when count(*) = 1 then '' else 's' end || ' wiped)' as text from sts",
    "read_texts": f"{_texts(graph_sql('s_events'))} select * from r",
    "hook_replies": f"{_texts(graph_sql('s_events'))} select seq, {_REPLY} as reply from r",
    "injected": f"{_texts(_HOOKED)} select seq, session_id, file, {_REPLY} as reply from r",
    "keyword_listing": f"{_LIVE} select {_listing('ordering')} as text",
    "keyword_replies": f"""{_LIVE} select unnest([0, 1, 2, 3, 4, 5, 6]) as call, unnest([false, false, false, false, false, true, true]) as ok,
 unnest(['arguments must be an object', 'arguments must be an object', 'keyword must be a non-empty string', 'keyword must be a non-empty string', 'keyword must be a non-empty string', {_listing('no such keyword')}, {_listing('retry')}]) as text""",
    "keyword_help": f"with {_STORE}, v as (select keyword, count(*) as n from kw group by 1), t as (select * from v order by n desc, keyword limit 100) select 'Record decisions that a search of the code can''t find.' || case when (select count(*) from v) > 0 then chr(10) || chr(10) || 'EXISTING KEYWORDS (frequency desc' || case when (select count(*) from v) > 100 then ', top 100 of ' || (select count(*) from v) else '' end || '):' || chr(10) || (select string_agg(keyword, ', ' order by n desc, keyword) from t) else '' end as text",
    "record_faults": f"{_FAULTS} select * from y",
    "record_messages": f"{_FAULTS} select decision_id, string_agg(error, chr(10) order by ord) filter (ord < 50) || case when count(*) > 50 then chr(10) || '... and ' || (count(*) - 50) || ' more' else '' end as message from y group by 1",
    "index_summary": f"""{_NATIVE}, t as (select (select count(*) from p) as files, (select count(*) from fn) as functions, count(*) as calls, count(*) filter (reason is null) as ok, count(reason) as un, (select count(*) filter (bad) from p) as broken from r), o as ({_OUTCOMES}),
pf as (select distinct x.file as file from (select unnest(parse_failures) as x from pipeline_results)), du as (select file || '::' || name as label, file, name from (select file, unnest(dup) as name from p))
select 'Indexed ' || files || ' files in 0.0s' || chr(10) || '  ' || functions || ' functions' || chr(10) || case when calls > 0 then '  ' || calls || ' calls → ' || ok || ' resolved (' || cast(floor(ok * 100 / calls + 0.5) as bigint) || '%), ' || un || ' unresolved:' || chr(10)
 || (select string_agg('    ' || rpad(reason, 18, ' ') || ' ' || n, chr(10) order by list_position(['member_chain', 'external', 'default_import', 'namespace_import', 'barrel_miss', 'unknown_bare'], reason)) from o) else '  0 calls' end
 || case when (select count(*) from pf) > 0 then chr(10) || '  ' || (select count(*) from pf) || ' parse failures: ' || (select string_agg(file, ', ' order by file) from (select file from pf order by file limit 3)) else '' end
 || case when broken > 0 then chr(10) || '  ' || broken || ' files had parse errors (partial results used)' else '' end
 || case when (select count(*) from du) > 0 then chr(10) || '  ' || (select count(*) from du) || ' duplicate function names dropped: ' || (select string_agg(label, ', ' order by file, name) from (select * from du order by file, name limit 3)) else '' end as text from t""",
}
