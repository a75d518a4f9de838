"""Queries of the general operators on records, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import nested, references, schema_drift

_KEY = "nullif(lower(trim({0}, chr(32) || chr(9) || chr(10) || chr(13) || chr(160))), '')"


def _orphans(child: str, cid: str, ref: str, parent: str, key: str) -> str:
    return f"""
    select '{child}' as child_table, c.child_id,
           case when min(p.k) is null then 'missing'
                when min(p.loaded_at) > any_value(c.at) then 'late' else 'deleted' end as reason,
           strftime(any_value(c.at), '%Y-%m') as period
    from (select {cid} as child_id, min(loaded_at) as at,
                 arg_min({_KEY.format(f"coalesce({ref}, '')")}, loaded_at) as k
          from (select *, row_number() over (partition by {cid} order by loaded_at, {_KEY.format(ref)} nulls first) as rn
                from {child} where {cid} is not null and loaded_at is not null) where rn = 1 group by 1) c
    left join (select {_KEY.format(key)} as k, loaded_at, deleted_at from {parent} where {key} is not null) p on p.k = c.k
    where c.k is not null
    group by c.child_id
    having count(*) filter (where p.loaded_at <= c.at and (p.deleted_at is null or p.deleted_at > c.at)) = 0"""


P4 = " union all ".join(_orphans(*r) for r in references.RELATIONS)

_CURRENT = " union all ".join(
    f"""select '{child}' as child_table, c.k as key, count(*) as refs
    from (select {_KEY.format(ref)} as k from
          (select *, row_number() over (partition by {cid} order by loaded_at, {_KEY.format(ref)} nulls first) as rn
           from {child} where {cid} is not null and loaded_at is not null) where rn = 1) c
    where c.k is not null and c.k not in
      (select {_KEY.format(key)} from {parent} where {key} is not null and deleted_at is null)
    group by 2"""
    for child, cid, ref, parent, key in references.RELATIONS
)

_ID = ", ".join(f"nullif({{0}}.{k}, '')" for k in ("backend_node_id", "node_id"))
_ATTR = ", ".join(f"nullif({{0}}.attributes['{k}'], '')" for k in nested.ATTRIBUTE_ID_KEYS)
_JSON_ID = ", ".join(
    f"nullif(t->>'$.{k}', '')" for k in [*nested.ID_KEYS, *[f"attributes.{k}" for k in nested.ATTRIBUTE_ID_KEYS]]
)
P5 = f"""
with s as (select task_id, s.i - 1 as pos, steps[s.i] as st from tasks, unnest(range(1, len(steps) + 1)) as s(i)
           where task_id is not null),
e as (select task_id, coalesce(st.step_index, pos) as step_index, unnest(st.pos_candidates) as c from s),
j as (select task_id, try_cast(trajectory as json) as j from episode_traces where task_id is not null),
u as (select task_id, case when json_type(j) = 'VARCHAR' then try_cast(j->>'$' as json) else j end as j from j),
h as (select task_id, case when json_type(j) = 'OBJECT' then
        coalesce({", ".join(f"j->'$.{k}'" for k in nested.CONTAINERS)}, j) else j end as j from u),
l as (select task_id, s.i as pos, j->s.i as st from
        (select * from h where json_type(j) = 'ARRAY'), unnest(range(0, json_array_length(j)::bigint)) as s(i)
      union all
      select task_id, k.k::bigint as pos, json_extract(j, '$."' || k.k || '"') as st from
        (select * from h where json_type(j) = 'OBJECT'), unnest(json_keys(j)) as k(k) where regexp_full_match(k.k, '\\d+')),
n as (select task_id, coalesce(try_cast(st->>'$.step_index' as int), try_cast(st->>'$.index' as int), pos) as step_index,
             st->'$.target' as t from l where json_type(st) = 'OBJECT'),
x as (select task_id, step_index, t->s.i as t from
        (select * from n where json_type(t) = 'ARRAY'), unnest(range(0, json_array_length(t)::bigint)) as s(i)
      union all select task_id, step_index, t from n where json_type(t) = 'OBJECT')
select distinct * from (
  select 'tasks' as table_name, task_id as record_id, step_index::int as step_index,
         coalesce({_ID.format("c")}, {_ATTR.format("c")}) as element_id from e
  union all
  select 'episode_traces', task_id, step_index::int, coalesce({_JSON_ID}) from x)
where element_id is not null"""

P5_STEPS = """
select s.i - 1 as _ordinal, task_id as up_task_id, st.step_index as step_index, st.action_uid as action_uid,
       st.operation as operation, st.value as value, st.action_repr as action_repr, st.url as url
from (select task_id, s.i, steps[s.i] as st from tasks, unnest(range(1, len(steps) + 1)) as s(i) where task_id is not null) as s"""


# paths as JSON lists them: array places are dropped, fields below attributes left out
P3_LIFESPANS = r"""
with r as (select feed, file_no, row_number() over () as rid, payload from raw_records where feed is not null and file_no is not null),
j as (select *, try_cast(payload as json) as j from r),
o as (select feed, file_no, rid, j from j where json_type(j) = 'OBJECT'),
t as (select o.feed, o.file_no, o.rid, t.type as kind, regexp_replace(regexp_replace(substr(t.fullkey, 3), '"', '', 'g'), '\[[0-9]+\]', '[]', 'g') as path
      from o, json_tree(o.j) t where t.fullkey <> '$' and t.type <> 'NULL'),
f as (select distinct feed, file_no, rid, path, case kind when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'array' when 'OBJECT' then 'object' else 'number' end as type
      from t where not ends_with(path, ']') and not regexp_matches(path, '(^|[.])attributes([.]|\[)')),
c as (select feed, file_no, path, type, count(*) as n from f group by all),
m as (select feed, file_no, path, type from (select *, row_number() over (partition by feed, file_no, path order by n desc, type) as rn from c) where rn = 1),
q as (select feed, file_no, row_number() over (partition by feed order by file_no) as seq from (select distinct feed, file_no from r)),
s as (select m.*, q.seq from m join q on q.feed = m.feed and q.file_no = m.file_no),
l as (select *, lag(seq) over w as p_seq, lag(type) over w as p_type from s window w as (partition by feed, path order by seq)),
i as (select *, sum(case when p_seq = seq - 1 and p_type = type then 0 else 1 end) over (partition by feed, path order by seq) as isle from l)
select feed, path, type, min(file_no) as first_file, max(file_no) as last_file from i group by feed, path, isle, type"""


def _p3_found() -> str:
    """Files compared one by one with the file before; canonical names by a walk along the parts of each path."""
    alias = lambda kind: "case n " + " ".join(f"when '{a}' then '{names[0]}'" for names in schema_drift.ALIASES[kind] for a in names) + " else n end"
    name = f"(case kind when 'record' then {alias('record')} when 'step' then {alias('step')} when 'candidate' then {alias('candidate')} else n end)"
    below = "(case when kind = 'record' and c = 'actions' then 'step' when kind = 'step' and c in ('pos_candidates', 'neg_candidates') then 'candidate' else 'other' end)"
    spelled = r"trim(lower(regexp_replace(regexp_replace(regexp_replace(part, '(\[\])+$', ''), '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[ \-_]+', '_', 'g')), '_')"
    marks = r"regexp_extract(part, '((\[\])*)$', 1)"
    head = P3_LIFESPANS[: P3_LIFESPANS.index("l as (select *, lag(seq)")].replace("with r as", "with recursive r as", 1)
    return f"""{head}
ps as (select distinct path, string_split(path, '.') as parts from s),
walk as (select path, parts, 1 as i, 'record' as kind, '' as parent, '' as canon, '' as c from ps
  union all select path, parts, i + 1, {below}, canon, case when canon = '' then c else canon || '.' || c end || mk, c
  from (select *, {name} as c from (select path, parts, i, kind, canon, {spelled} as n, {marks} as mk from (select path, parts, i, kind, canon, parts[i] as part from walk where i <= len(parts))))),
cn as (select path, parent, c as name from walk where i = len(parts) + 1),
pairs as (select a.feed, a.seq, a.path, a.type, b.type as old from s a left join s b on b.feed = a.feed and b.seq = a.seq - 1 and b.path = a.path where a.seq > 1),
ad as (select pairs.feed, pairs.seq, pairs.path, parent, name, row_number() over (partition by pairs.feed, pairs.seq, parent, name order by pairs.path) as nth from pairs join cn on cn.path = pairs.path where old is null),
gone as (select a.feed, a.seq + 1 as seq, a.path from s a join q on q.feed = a.feed and q.seq = a.seq + 1 left join s b on b.feed = a.feed and b.seq = a.seq + 1 and b.path = a.path where b.path is null),
rm as (select gone.*, parent, name, row_number() over (partition by feed, seq, parent, name order by gone.path) as nth from gone join cn on cn.path = gone.path),
ev as (select coalesce(ad.feed, rm.feed) as feed, coalesce(ad.seq, rm.seq) as seq, case when rm.path is null then 'added' when ad.path is null then 'removed' else 'renamed' end as kind, coalesce(rm.path, '') as o, coalesce(ad.path, '') as p
    from ad full join rm on rm.feed = ad.feed and rm.seq = ad.seq and rm.parent = ad.parent and rm.name = ad.name and rm.nth = ad.nth
  union all select feed, seq, 'retyped', path, path from pairs where old is not null and old <> type),
hit as (select feed, seq, o as up from ev where o <> '' union select feed, seq, p from ev where p <> ''),
up as (select feed, seq, kind, o, p from ev where exists (select 1 from hit h where h.feed = ev.feed and h.seq = ev.seq
    and (regexp_matches(ev.o, '^' || regexp_escape(h.up) || '(\\[\\])*\\.') or regexp_matches(ev.p, '^' || regexp_escape(h.up) || '(\\[\\])*\\.'))))
select fn.file_name, ev.kind as change_kind, ev.o as old_path, ev.p as new_path from (select * from ev except all select * from up) ev
join q on q.feed = ev.feed and q.seq = ev.seq join (select feed, file_no, min(file_name) as file_name from raw_records group by 1, 2) fn on fn.feed = ev.feed and fn.file_no = q.file_no"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p3_found": schema_drift.found,
        "p3_lifespans": schema_drift.spans,
        "p3_steps": schema_drift.steps,
        "p4_found": references.found,
        "p4_report": references.report,
        "p4_current": references.current_report,
        "p5_found": nested.found,
        "p5_task_steps": nested.task_steps,
        "p5_trace_steps": nested.trace_table,
        "p5_tasks": nested.task_part("tasks"),
        "p5_tasks_steps": nested.task_part("tasks.steps"),
        "p5_tasks_pos": nested.task_part("tasks.steps.pos_candidates"),
        "p5_tasks_neg": nested.task_part("tasks.steps.neg_candidates"),
        "p5_traces": nested.trace_part("traces"),
        "p5_trace_targets": nested.trace_part("traces.steps.target"),
        "p5_trace_candidates": nested.trace_part("traces.steps.observation_candidates"),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _p3_found(),
        "p3_lifespans": P3_LIFESPANS,
        "p4_found": P4,
        "p4_report": f"select child_table, period, reason, count(*) as orphans from ({P4}) group by 1, 2, 3",
        "p4_current": _CURRENT,
        "p5_found": P5,
        "p5_task_steps": P5_STEPS,
    }
