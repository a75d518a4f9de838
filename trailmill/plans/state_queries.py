"""Queries of names, step texts and page states, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import construct as C
from ..operators import describe as D
from ..operators import episodes as E
from ..operators import grounding as G
from ..operators import nested
from ..operators import states as St
from ..session import table
from . import records
from . import sqltext as S
from .episode_queries import STEPS, TASKS, described_ctes

# the steps of traces as JSON, from the SQL of p5_found
_TRACES = records.P5[records.P5.index("j as (") : records.P5.index("\nn as (")].rstrip().rstrip(",").replace("select task_id, ", "select task_id, loaded_at, ")


def _trace_steps(s, d):  # noqa: ANN001, ANN202
    t = table(s, d, "episode_traces").where(F.col("task_id").isNotNull()).select("task_id", F.explode(nested.json_steps(F.col("trajectory"))).alias("s"))
    return t.select("task_id", F.col("s.pos").alias("pos"), F.col("s.step").alias("step"))


def _domains(s, d):  # noqa: ANN001, ANN202
    t = table(s, d, "episode_traces").select(St.domain_name(F.col("domain")).alias("domain"), F.lower(F.coalesce("domain", F.lit(""))).alias("raw"))
    return t.groupBy("raw", "domain").agg(F.count("*").alias("n"))


def queries() -> dict:
    return {
        "operation_names": lambda s, d: E.steps(s, d).groupBy(St.operation_name(F.col("operation")).alias("operation")).agg(F.count("*").alias("n")),
        "domain_names": _domains,
        "split_hints": lambda s, d: table(s, d, "raw_records").select("feed", "file_name", St.split_hint(F.col("file_name")).alias("split")).distinct(),
        "shape_candidates": lambda s, d: St.shaped(E.steps(s, d)),
        "step_texts": lambda s, d: St.step_texts(C.described_steps(E.steps(s, d))),
        "abstract_states": lambda s, d: (lambda st: St.abstract_states(st, St.shaped(st)))(E.steps(s, d)),
        "json_spans": lambda s, d: table(s, d, "documents").select("doc_id", St.json_span(F.col("text")).alias("span")).where("span is not null"),
        "tasks_with_steps": lambda s, d: E.live_tasks(s, d).select("task_id", F.size(F.coalesce("steps", F.array())).alias("n_steps")).where("n_steps > 0"),
        "trace_observations": lambda s, d: St.observations(_trace_steps(s, d)),
    }


def _case(x: str, names: dict[str, str]) -> str:
    return f"case {x} " + " ".join(f"when '{k}' then '{v}'" for k, v in names.items())


def _shaped() -> str:
    el = f"coalesce(nullif(c.backend_node_id, ''), nullif(c.node_id, ''), {', '.join(f'nullif(c.attributes[{S.q(k)}], {S.q(str())})' for k in G.ATTRIBUTE_ID_KEYS)})"
    kind, tag = "lower(coalesce(c.attributes['type'], ''))", "lower(coalesce(c.tag, ''))"
    text = "concat_ws(' ', nullif(c.text, ''), " + ", ".join(f"nullif(c.attributes[{S.q(k)}], '')" for k in St.TEXT_ATTRIBUTES) + ")"
    return f"""h0 as (select task_id, pos, coalesce(pos_candidates, []) || coalesce(neg_candidates, []) as cs from st),
      h1 as (select task_id, pos, (s.i - 1)::int as index, cs[s.i] as c from h0, unnest(range(1, len(cs) + 1)) as s(i)),
      h2 as (select *, case when length(c.role) > 0 then lower(c.role) when {tag} = 'button' then 'button' when {tag} = 'a' then 'link' when {tag} in ('input', 'textarea') then
        case when {kind} in ('button', 'submit', 'checkbox', 'radio') then {kind} else 'textbox' end when {tag} = 'select' then 'combobox' when {tag} = '' then 'element' else {tag} end as role from h1),
      sh as materialized (select task_id, pos, index, coalesce({el}, 'candidate_' || index) as element_id, role, substring({S.collapse(text)}, 1, 240) as visible_text, substring({S.collapse('c.parent_context')}, 1, 240) as parent_context,
        substring({S.collapse('c.sibling_text')}, 1, 240) as sibling_text, role in ({', '.join(map(S.q, St.CLICKS))}) as clickable, role in ({', '.join(map(S.q, St.EDITS))}) as editable from h2)"""


def oracle_sql() -> dict[str, str]:
    low = "trim(replace(lower(coalesce(domain, '')), '-', '_'))"
    words = " ".join(f"when {S.contains_any(low, ws)} then '{n}'" for n, ws in St.DOMAIN_WORDS.items())
    hint = "translate(lower(coalesce(file_name, '')), '- ', '__')"
    hints = " ".join(f"when contains({hint}, '{a}') then '{n}'" for a, n in St.SPLIT_HINTS.items())
    names = {"role": "role", "label_or_text": "label", "element_purpose": "element_purpose", "parent_context": "parent", "form_section": "section", "field_slot": "slot"}
    query = ", ".join(f"nullif({names[f]}, '')" for f in St.QUERY_FIELDS if f in names)
    kinds = "concat_ws(',', case when clickable then 'clickable' end, case when editable then 'editable' end)"
    line = f"'- ' || element_id || ' role=' || role || ' label=' || visible_text || ' parent=' || substring(parent_context, 1, 120) || ' sibling=' || substring(sibling_text, 1, 80) || ' attrs=' || case when {kinds} = '' then 'static' else {kinds} end"
    evidence = ", ".join("case " + " ".join(f"when contains(t, {D._q(w)}) then {D._q(w)}" for w in ws) + f" else '' end as has_{n}" for n, ws in D.STATES.items())
    ids = ", ".join(f"nullif(st->>'$.target.{k}', '')" for k in G.ID_KEYS) + ", " + ", ".join(f"nullif(st->>'$.target.raw_candidate.{k}', '')" for k in G.ID_KEYS[1:])
    esc = lambda x: f"replace(replace(coalesce({x}, ''), '\\', '\\\\'), '''', '\\''')"
    typed = "o in ('type', 'input', 'fill')"
    return {
        "operation_names": f"with {STEPS} select case when operation = '' then 'click' else {_case('lower(operation)', St.OPERATION_NAMES)} else lower(operation) end end as operation, count(*) as n from st group by 1",
        "domain_names": f"select lower(coalesce(domain, '')) as raw, case when {low} in ({', '.join(map(S.q, St.DOMAIN_NAMES))}) then {_case(low, St.DOMAIN_NAMES)} end {words} when {low} = '' then 'unknown' else {low} end as domain, count(*) as n from episode_traces group by 1, 2",
        "split_hints": f"select distinct feed, file_name, case {hints} else 'unknown' end as split from raw_records",
        "shape_candidates": f"with {STEPS}, {_shaped()} select * from sh",
        "step_texts": f"""with {STEPS}, {described_ctes()} select task_id, pos, concat_ws(' ', op, nullif(role, ''), nullif(substring(label, 1, 300), ''), nullif(argument, '')) as action,
            trim(pos || ': ' || op || ' ' || label || ' ' || coalesce(argument, '')) as summary, {S.collapse(f"concat_ws(' ', {query})")} as query from dd""",
        "abstract_states": f"""with {STEPS}, {_shaped()}, g as (select task_id, pos, sum((clickable or editable)::int)::bigint as interactive, bool_or(editable) as ed, bool_or(clickable) as cl, string_agg({line}, chr(10) order by index) as lines,
              string_agg(concat_ws(' ', nullif(role, ''), nullif(visible_text, ''), nullif(parent_context, ''), nullif(sibling_text, '')), ' ' order by index) as texts from sh group by 1, 2),
            x as (select st.task_id, st.pos, coalesce(url, '') as url, coalesce(interactive, 0) as interactive, coalesce(ed, false) as has_editable_field, coalesce(cl, false) as has_clickable_control, lines,
              lower(concat_ws(' ', coalesce(url, ''), coalesce(texts, ''))) as t from st left join g on g.task_id = st.task_id and g.pos = st.pos)
            select task_id, pos, interactive, has_editable_field, has_clickable_control, {evidence}, concat_ws(chr(10), 'url: ' || url, lines) as summary from x""",
        "json_spans": """select doc_id, substr(text, s, e - s + 1) as span from (select doc_id, text, instr(text, '{') as s, length(text) - instr(reverse(text), '}') + 1 as e from documents where contains(text, '}')) where s > 0 and e > s""",
        "tasks_with_steps": f"select task_id, len(steps)::int as n_steps from {TASKS} where len(steps) > 0",
        "trace_observations": f"""with {_TRACES} select task_id, pos::int as pos, substring({S.collapse("coalesce(st->>'$.observation.text', case when json_type(st->'$.observation') <> 'OBJECT' then st->>'$.observation' end)")}, 1, 4000) as text,
            coalesce(st->>'$.observation.url', '') as url, coalesce(json_array_length(st->'$.observation.candidates'), 0)::int as candidates from l""",
        "resolve_actions": f"""with {_TRACES}, r as (select task_id, loaded_at, pos::int as pos, coalesce(st->>'$.operation', st->>'$.action', '') as op, st->>'$.argument' as argument, coalesce({ids}) as target,
              json_extract_string(st, '$.observation.candidates[*].element_id') as ids from l),
            z as (select *, lower(op) as o, target as e, coalesce(argument, '') as a, target is not null as has from r)
          select task_id, loaded_at, pos, op, target, coalesce(list_contains(ids, target), false) as found,
            case when o = 'click' and has then 'click [' || e || ']' when {typed} and has then 'type [' || e || '] [' || a || ']' when o = 'select' and has then 'select [' || e || '] [' || a || ']'
              when o = 'hover' and has then 'hover [' || e || ']' when o = 'press' then 'press [' || case when a = '' then 'ENTER' else a end || ']' when o = 'scroll' then 'scroll [' || case when a = '' then 'down' else a end || ']' else 'stop' end as brackets,
            case when o = 'click' and has then 'click(''' || {esc('e')} || ''')' when {typed} and has then 'fill(''' || {esc('e')} || ''', ''' || {esc('a')} || ''')' when o = 'select' and has then 'select_option(''' || {esc('e')} || ''', ''' || {esc('a')} || ''')'
              when o = 'hover' and has then 'hover(''' || {esc('e')} || ''')' when o = 'press' then 'press(''' || case when a = '' then 'Enter' else {esc('a')} end || ''')' when o = 'scroll' then 'scroll(''' || case when a = '' then 'down' else {esc('a')} end || ''')' else 'stop()' end as call,
            'stop' as coordinates from z""",
    }
