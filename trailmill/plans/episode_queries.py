"""Queries on episodes, descriptors, grounding and metrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import describe as D
from ..operators import episodes as E
from ..operators import grounding as G
from ..operators import metrics as M
from ..operators import nested, schema_drift
from ..session import cut, table
from . import sqltext as S
from .maintenance_queries import canonical_operation

TASKS = """(select * from (select *, row_number() over (partition by task_id order by loaded_at desc nulls last, instruction desc nulls last,
    split desc nulls last, source desc nulls last) as _rn from tasks where task_id is not null) where _rn = 1)"""
STEPS = f"""s0 as (select task_id, s.i - 1 as pos, steps[s.i] as s from (select task_id, steps from {TASKS}) t, unnest(range(1, len(steps) + 1)) as s(i)),
  st as materialized (select task_id, pos::int as pos, coalesce(s.operation, '') as operation, s.value as argument, s.url as url, s.action_repr as action_repr,
    {S.collapse('s.pos_candidates[1].text')} as label, {S.normal_key('coalesce(s.pos_candidates[1].role, s.pos_candidates[1].tag)')} as role,
    s.pos_candidates as pos_candidates, s.neg_candidates as neg_candidates from s0)"""


def _lead(prefix: str) -> str:
    top = f"greatest({', '.join(prefix + k for k in E.ORDER)})"
    return "case " + " ".join(f"when {prefix}{k} = {top} then '{k}'" for k in E.ORDER) + " end"


def _evidence() -> str:
    raw = []
    for k, (ws, ops, w) in E.KINDS.items():
        hit = f"list_has_any(tokens, {S.words(ws)})" + (f" or op in ({', '.join(S.q(o) for o in ops)})" if ops else "")
        raw.append(f"case when {hit} then {float(w)} else 0.0 end::double as r_{k}")
    total = " + ".join(f"r_{k}" for k in E.KINDS)
    norm = ", ".join(f"round(r_{k} / ({total} + r_generic), 9) as k_{k}" for k in E.ORDER)
    return f"""e1 as (select *, {S.normal_key('operation')} as op, {S.evidence_tokens("concat_ws(' ', operation, label, role, coalesce(argument, ''))")} as tokens from st),
  e2 as (select *, {', '.join(raw)} from e1), e3 as (select *, case when {total} = 0 then 0.5 else 0.0 end::double as r_generic from e2),
  e4 as (select task_id, pos, op, label, tokens, {norm} from e3), ev as materialized (select *, {_lead('k_')} as kind from e4)"""


EVIDENCE = f"{STEPS}, {_evidence()}"
_T = ", ".join(S.q(t) for t in E.TRANSITIONS)
BOUNDARIES = f"""{EVIDENCE},
  b1 as (select *, lag(tokens) over w as p_tokens, lag(kind) over w as p_kind, lag(op) over w as p_op from ev window w as (partition by task_id order by pos)),
  b2 as (select *, case when p_kind is not null then round(least(1.0, 0.5 * (case when len(tokens) = 0 or len(p_tokens) = 0 then 1.0 else 1.0 - {S.jaccard('tokens', 'p_tokens')} end)
     + (case when kind = p_kind then 0.0 else 0.35 end) + (case when op = p_op then 0.0 else 0.15 end)), 9) end as distance from b1),
  b3 as (select *, coalesce((kind <> p_kind and distance >= 0.35) or (p_op || '->' || op in ({_T}) and distance >= 0.25), true) as split from b2),
  b4 as (select *, (pos - max(case when split then pos end) over (partition by task_id order by pos rows unbounded preceding)) % 6 = 0 as boundary from b3),
  bo as materialized (select *, (sum(boundary::int) over (partition by task_id order by pos rows unbounded preceding))::int as stage from b4)"""
def _conf(top: str, n: str, inner: str) -> str:
    return f"round(greatest(0.0, least(1.0, 0.45 * {top} / {n} + 0.35 * (case when {n} = 1 then 1.0 else 1.0 - least(1.0, {inner} / ({n} - 1)) end) + 0.20 * least(1.0, sqrt({n}) / 2.5))), 6)"


_TOP = f"greatest({', '.join(f's_{k}' for k in E.ORDER)})"
_NAME = S.collapse("case when last_label is not null then replace(kind, '_', ' ') || ': ' || substring(last_label, 1, 48) else replace(kind, '_', ' ') end")
_NAMED = f"""task_id, stage, start, "end", kind, {_NAME} as name, confidence, lag(kind) over (partition by task_id order by stage) as previous, lead(kind) over (partition by task_id order by stage) as next"""
ROWS = f"""{BOUNDARIES},
  g1 as (select task_id, stage, min(pos) as start, max(pos) as "end", count(*) as n, coalesce(sum(case when not boundary then distance end), 0.0) as inner_d, coalesce(max(case when boundary then distance end), 0.0) as edge,
     max_by(case when label <> '' then label end, case when label <> '' then pos end) as last_label, {', '.join(f'round(sum(k_{k}), 6) as s_{k}' for k in E.ORDER)} from bo group by 1, 2),
  gr as materialized (select *, {_lead('s_')} as kind, case when sum(n) over (partition by task_id) = 1 then 0.8 else {_conf(_TOP, 'n', 'inner_d')} end as confidence from g1)"""
STAGES = f"{ROWS}, sg as materialized (select {_NAMED} from gr)"
# the merge as a walk along the stages of a task
MERGED = f"""with recursive {ROWS},
  walk as (select task_id, stage, false as taken, confidence < {E.LOW_CONFIDENCE} as opens from gr where stage = 1
    union all select g.task_id, g.stage, w.opens, g.confidence < {E.LOW_CONFIDENCE} and not w.opens from walk w join gr g on g.task_id = w.task_id and g.stage = w.stage + 1),
  m1 as (select g.*, w.taken, g.stage - w.taken::int as head from gr g join walk w on w.task_id = g.task_id and w.stage = g.stage),
  m2 as (select task_id, head, min(start) as start, max("end") as "end", sum(n)::bigint as n, sum(inner_d) + sum(case when taken then edge else 0.0 end) as inner_d, max(confidence) as own, count(*) as two,
     max_by(last_label, case when last_label is not null then stage end) as last_label, {', '.join(f'round(sum(s_{k}), 6) as s_{k}' for k in E.ORDER)} from m1 group by 1, 2),
  m3 as (select *, {_lead('s_')} as kind, case when two > 1 then greatest(own, {_conf(_TOP, 'n', 'inner_d')}) else own end as confidence, row_number() over (partition by task_id order by head)::int as stage, max("end") over (partition by task_id) as last_end from m2),
  m4 as (select * replace (case when stage = {E.MAX_STAGES} then last_end else "end" end as "end") from m3 where stage <= {E.MAX_STAGES})
  select {_NAMED} from m4"""


def _boundaries(s, d):  # noqa: ANN001, ANN202
    return E.boundaries(E.evidence(E.steps(s, d)))


def _damaged(spans):  # noqa: ANN001, ANN202
    """Spans with every third stage missing and starts pulled forward, for the repair to mend."""
    return spans.where(F.col("stage") % 3 != 2).select("task_id", "stage", F.greatest(F.lit(0), F.col("start") - 1).alias("start"), "end")


_DAMAGED = """dm as (select task_id, stage, greatest(0, start - 1) as start, "end" from sg where stage % 3 <> 2), ln as (select task_id, count(*)::int as n from st group by 1)"""


def _described(s, d):  # noqa: ANN001, ANN202
    from ..operators.maintenance import canonical_operation as canon

    c = F.get("pos_candidates", F.lit(0))
    rows = E.steps(s, d).select("task_id", "pos", canon(F.col("operation")).alias("op"), "argument", "label", F.when(F.col("role") == "", "generic").otherwise(F.col("role")).alias("role"), X.collapse(c["parent_context"]).alias("parent"), X.collapse(c["sibling_text"]).alias("sibling"))
    return D.described(rows).select("task_id", "pos", *D.FIELDS)


def described_ctes(source: str | None = None) -> str:
    """CTEs up to ``dd``: the steps, or the rows of ``source``, with their descriptor fields."""
    k = S.normal_key
    ws = lambda *xs: "concat_ws(' ', " + ", ".join(xs) + ")"
    steps = f"""select task_id, pos, {canonical_operation('operation')} as op, argument, label, case when role = '' then 'generic' else role end as role,
        {S.collapse('pos_candidates[1].parent_context')} as parent, {S.collapse('pos_candidates[1].sibling_text')} as sibling from st"""
    return f"""d0 as ({source or steps}),
      d1 as (select *, {k(ws('parent', 'label'))} as ctx from d0), d2 as (select *, {D.case('ctx', D.SECTIONS, 'task-relevant content area')} as section from d1),
      d3 as (select *, {k(ws('parent', 'section', 'label'))} as ctx2 from d2), d4 as (select *, {D.case('ctx2', D.REGIONS, 'main content')} as region from d3),
      d5 as (select *, {k(ws('label', 'parent', 'section', 'argument', 'op'))} as ctx3 from d4), d6 as (select *, {D.slot_case('ctx3', 'op')} as slot from d5),
      d7 as (select *, case when label <> '' then label when slot <> '' then slot else role end as label_text, {S.collapse('argument')} as arg, regexp_matches({S.collapse('argument')}, '[0-9]') as has_digit from d6),
      d8 as (select *, {k(ws('label_text', 'section', 'region'))} as ctx4, {k(ws('role', 'label', 'section', 'region'))} as ctx5 from d7),
      dd as (select task_id, pos, op, argument, label, role, parent, sibling, section, region, slot, {D.purpose_case()} as element_purpose, {D.change_case('ctx4')} as expected_state_change, {D.source_case()} as value_source,
        {D.negative_case('ctx5')} as negative_constraints, {D.priority_case()} as grounding_priority, {D.disambiguators_case()} as disambiguators from d8)"""


def _described_sql() -> str:
    return f"with {STEPS}, {described_ctes()} select task_id, pos, {', '.join(D.FIELDS)} from dd"


def _page(s, d):  # noqa: ANN001, ANN202
    return G.snapshot(G.elements(E.steps(s, d)))


_PATTERN = {
    "role": "role", "label_or_text": "label", "accessible_name": "''", "element_purpose": "element_purpose", "parent_context": "parent", "sibling_context": "sibling",
    "nearby_text": "''", "form_section": "section", "region": "region", "field_slot": "slot", "expected_state_change": "expected_state_change",
}
_STORED = {f: f"semantic_description.{f}" if f != "region" else "''" for f in G.FIELDS}


def _patterns(s, d):  # noqa: ANN001, ANN202
    """The pattern that each step leaves, with all its inferred fields."""
    from ..operators.construct import described_steps

    many = lambda c, sep: F.filter(F.split(c, sep), lambda t: t != "")
    return described_steps(E.steps(s, d)).select(
        "task_id", "pos", "op", "argument", "value_source", *[F.expr(c).alias(f"d_{f}") for f, c in _PATTERN.items()],
        many("disambiguators", "; ").alias("d_disambiguators"), many("negative_constraints", "; ").alias("d_negative_constraints"), many("grounding_priority", " ").alias("d_priority"),
    )


def _ground(s, d):  # noqa: ANN001, ANN202
    """Replay: each step's pattern grounded on the page it was recorded on."""
    return G.grounded(_patterns(s, d), _page(s, d))


def _ground_memory(s, d):  # noqa: ANN001, ANN202
    """The action that retrieval chooses for each query task, grounded on every page of the task."""
    from ..operators import memory, retrieval

    chosen = retrieval.hierarchical(s, d).where(F.col("action_id").isNotNull()).select(F.col("query_id").alias("task_id"), "action_id")
    a = memory.live(s, d, "actions").select("action_id", F.col("operation").alias("op"), F.col("argument_template").alias("argument"), F.col("semantic_description.value_source").alias("value_source"),
        *[X.blank(F.expr(c)).alias(f"d_{f}") for f, c in _STORED.items()], *[F.col(f"semantic_description.{c}").alias(f"d_{n}") for n, c in (("disambiguators", "disambiguators"), ("negative_constraints", "negative_constraints"), ("priority", "grounding_priority"))])
    a = a.join(cut(chosen), "action_id")
    page = _page(s, d)
    steps = page.select("task_id", "pos").distinct()
    return G.grounded(steps.join(a, "task_id"), page).join(chosen, "task_id").select("task_id", "pos", "action_id", "element_id", "total", "matched", "confidence", "argument")


def _predicted(s, d):  # noqa: ANN001, ANN202
    """What the agent would do on the first page of each query task: the grounded action, or a stop with the reason."""
    from ..operators import retrieval

    chosen = retrieval.hierarchical(s, d).select(F.col("query_id").alias("task_id"), "stage_id", "stage_decision", "action_id", F.lower(X.blank(F.col("operation"))).alias("op"))
    g = _ground_memory(s, d).drop("action_id")
    first = g.groupBy("task_id").agg(F.min_by(F.struct(*[c for c in g.columns if c != "task_id"]), "pos").alias("g")).select("task_id", "g.*")
    x = chosen.join(first, "task_id", "left")
    acts = F.col("element_id").isNotNull()
    reason = (
        F.when(F.col("action_id").isNull(), "no action hits").when(F.col("op") == "stop", "stored action is stop").when(F.col("total").isNull(), "no candidate elements available")
        .when(acts, "selected candidate with highest semantic grounding score").otherwise("best candidate below grounding confidence threshold")
    )
    return x.select("task_id", "stage_id", "action_id", F.when(acts, F.col("op")).otherwise("stop").alias("operation"), "element_id", F.when(acts, F.col("argument")).alias("argument"), F.when(acts, F.col("confidence")).otherwise(0.0).alias("confidence"), reason.alias("reason"))


def _predicted_sql() -> str:
    from .retrieval_queries import oracle_sql as retrieval_sql

    return f"""with h as (select query_id as task_id, stage_id, action_id, lower(coalesce(operation, '')) as op from ({retrieval_sql()['hierarchical_retrieval']})),
      g as (select * from (select *, row_number() over (partition by task_id order by pos) as rn from ({_ground_memory_sql()})) where rn = 1)
      select h.task_id, stage_id, h.action_id, case when element_id is not null then op else 'stop' end as operation, element_id, case when element_id is not null then argument end as argument,
        case when element_id is not null then confidence else 0.0 end as confidence, case when h.action_id is null then 'no action hits' when op = 'stop' then 'stored action is stop' when total is null then 'no candidate elements available'
        when element_id is not null then 'selected candidate with highest semantic grounding score' else 'best candidate below grounding confidence threshold' end as reason from h left join g on g.task_id = h.task_id"""


def _snapshot_ctes() -> str:
    el = lambda c: f"coalesce(nullif({c}.backend_node_id, ''), nullif({c}.node_id, ''), {', '.join(f'''nullif({c}.attributes['{k}'], '')''' for k in G.ATTRIBUTE_ID_KEYS)})"
    has = lambda k: f"coalesce(map_contains(c.attributes, '{k}'), false)"
    tags = " ".join(f"when '{t}' then '{r}'" for t, r in G.TAG_ROLES.items())
    lg = lambda k: f"{'lag' if k < 0 else 'lead'}(nullif(label, ''), {abs(k)}) over (partition by task_id, pos order by index)"
    places = " ".join(f"when {S.contains_any('k', ws)} then '{n}'" for n, ws in G.PLACES.items())
    state = "concat_ws(' ', case when disabled then 'disabled:True' end, case when hidden then 'visible:False' end)"
    parts = ", ".join(f"nullif({c}, '')" for c in ("role", "label", "parent", "region", "sibling", "nearby", "place"))
    acts = f"(role in ({', '.join(map(S.q, G.INTERACTIVE))}) or lower(tag) in ({', '.join(map(S.q, G.INTERACTIVE_TAGS))}) or handles)"
    return f"""c0 as (select task_id, pos, coalesce(pos_candidates, []) || coalesce(neg_candidates, []) as cs, len(coalesce(pos_candidates, [])) as np from st),
      c1 as (select *, cs[s.i] as c, (s.i - 1)::int as index from c0, unnest(range(1, len(cs) + 1)) as s(i)),
      c2 as (select task_id, pos, index, index < np as gold, coalesce(nullif({el('c')}, ''), 'el_' || index) as eid, coalesce(c.tag, '') as tag, {S.normal_key('c.role')} as own, {S.collapse('c.text')} as label,
        {S.collapse('c.parent_context')} as parent, {S.collapse('c.sibling_text')} as sib, {has('onclick')} or {has('tabindex')} as handles, {has('disabled')} or {S.normal_key("c.attributes['aria-disabled']")} = 'true' as disabled,
        {has('hidden')} or {S.normal_key("c.attributes['aria-hidden']")} = 'true' as hidden, {has('readonly')} as readonly from c1),
      c3 as (select *, case when own <> '' then own when tag = '' then 'generic' else case lower(tag) {tags} else lower(tag) end end as role, concat_ws(' ', {lg(-1)}, {lg(1)}) as both_sides,
        concat_ws(' ', {lg(-2)}, {lg(-1)}, {lg(1)}, {lg(2)}) as nearby, format('element {{}} of {{}}', index + 1, count(*) over (partition by task_id, pos)) as place from c2),
      c4 as (select *, case when sib <> '' then sib else both_sides end as sibling, {S.normal_key("concat_ws(' ', parent, nearby)")} as k from c3),
      c5 as (select *, case {places} else 'main content' end as region from c4),
      c6 as (select *, round((case when {acts} then 2.0 else 0.0 end + case when label <> '' then 1.0 else 0.0 end + case when parent <> '' then 0.5 else 0.0 end - case when disabled then 1.0 else 0.0 end
        + least(1.0, length(concat_ws(' ', {parts}, nullif({state}, ''))) / 120.0))::double, 4) as salience, {acts} as interactive,
        concat_ws(' ', role, label, parent, region, sibling, nearby, place, {state}) as whole from c5),
      sn as materialized (select *, (row_number() over (partition by task_id, pos order by salience desc, eid, index) - 1)::int as rank from c6)"""


def _grounded_ctes() -> str:
    """CTEs from ``ap`` (patterns) and ``sn`` (elements) to ``gb``, the best element of each action."""
    there = {"text": "label <> ''", "beside": "sides <> ''", "around": "true", "whole": "true"}
    num, den, hit = [], [], []
    for f, (w, part) in G.FIELDS.items():
        weight = f"(case when list_contains(d_priority, '{f}') then {w * G.PRIORITY} else {w} end)"
        value = f"({S.normal_key('d_role')} = {S.normal_key(chr(10).join(['concat_ws(chr(32), sn.role, nullif(tag, chr(32)[1:0]))']).replace('chr(32)[1:0]', repr('')))})::int::double" if part is None else S.jaccard(f"s_{f}", f"t_{part}", 1.0)
        both = f"(coalesce(d_{f}, '') <> '' and {there.get(part, 'true')})"
        num.append(f"case when {both} then {weight} * {value} else 0.0 end")
        den.append(f"case when {both} then {weight} else 0.0 end")
        hit.append(f"case when {both} and {value} > 0 then 1 else 0 end")
    sets = ", ".join(f"{S.token_set('d_' + f)} as s_{f}" for f, (_, part) in G.FIELDS.items() if part)
    each = lambda c: f"list_transform(list_filter(coalesce({c}, []), lambda t: {S.collapse('t')} <> ''), lambda t: {S.token_set('t')})"
    fits = " or ".join(f"(o = '{o}' and sn.role in ({', '.join(map(S.q, rs))}))" for o, rs in G.ROLES.items())
    fits += f" or (o not in ({', '.join(map(S.q, G.ROLES))}) and sn.role = 'generic')"
    over = lambda c: f"list_transform({c}, lambda t: {S.jaccard('t', 't_whole', 1.0)})"
    return f"""pa as materialized (select * replace (coalesce(d_priority, []) as d_priority), {S.normal_key('op')} as o, {sets}, {each('d_disambiguators')} as s_more, {each('d_negative_constraints')} as s_not from ap),
      ts as materialized (select *, concat_ws(' ', sibling, nearby) as sides, {S.token_set('label')} as t_text, {S.token_set('whole')} as t_whole, {S.token_set("concat_ws(' ', parent, region)")} as t_around, {S.token_set("concat_ws(' ', sibling, nearby)")} as t_beside from sn),
      x1 as (select sn.task_id, sn.pos, eid, index, rank, gold, salience, o, argument, value_source, readonly, disabled, hidden, case when {fits} then 1.0 else 0.65 end::double as fit,
        ({' + '.join(num)})::double as num, ({' + '.join(den)})::double as den, {' + '.join(hit)} as matched, {over('s_more')} as more, {over('s_not')} as nots from ts sn join pa on pa.task_id = sn.task_id and pa.pos = sn.pos),
      x2 as (select *, greatest(0.0, least(1.0, (fit + least(0.08, salience / 50.0)) * case when o = 'type' and readonly then 0.5 else 1.0 end)) as op_score, {G.NEGATIVE} * coalesce(list_max(nots), 0.0) as against,
        (case when disabled then {G.DISABLED} else 0.0 end + case when hidden then {G.HIDDEN} else 0.0 end)::double as state from x1),
      x3 as (select *, round(greatest(0.0, least(1.0, 0.22 * op_score + 0.58 * case when den > 0 then num / den else 0.0 end + {G.DISAMBIGUATORS} * case when len(more) > 0 then list_sum(more) / len(more) else 0.0 end
        + (least(0.04, salience / 100.0) + greatest(0.0, 0.03 - rank * 0.001)) - against - state)), 9) as total from x2),
      x4 as (select *, lead(total, 1, 0.0) over w as second, row_number() over w as rn from x3 window w as (partition by task_id, pos order by total desc, eid, index)),
      x5 as (select *, 0.78 * total + 0.15 * greatest(0.0, total - second) + least(0.15, 0.03 * matched) as raw from x4 where rn = 1),
      gb as (select task_id, pos, eid, o, total, matched, gold, argument as arg0, coalesce(value_source, '') as vs, round(case when o = 'stop' then 1.0 else least(1.0, case when against > 0 or state > 0 or op_score = 0 then {G.REJECTED} * raw else raw end) end, 6) as confidence from x5),
      gd as (select task_id, pos, case when confidence >= {G.FLOOR} and o <> 'stop' then eid end as element_id, total, matched, confidence, case when length(arg0) > 0 then arg0 when contains(vs, ':') then trim(substr(vs, instr(vs, ':') + 1)) end as argument, gold as correct from gb)"""


def _ground_sql(end: str = "select * from gd") -> str:
    many = lambda c, sep: f"list_filter(string_split({c}, '{sep}'), lambda t: t <> '')"
    return f"""with {STEPS}, {described_ctes()}, {_snapshot_ctes()}, ap as (select task_id, pos, op, argument, value_source, {', '.join(f'{c} as d_{f}' for f, c in _PATTERN.items())},
        {many('disambiguators', '; ')} as d_disambiguators, {many('negative_constraints', '; ')} as d_negative_constraints, {many('grounding_priority', ' ')} as d_priority from dd), {_grounded_ctes()} {end}"""


def _ground_memory_sql() -> str:
    from .memory_queries import live
    from .retrieval_queries import _HIER

    return f"""with {STEPS}, {_HIER.replace('st as (', 'hs as (').replace("_conditions('st')", '').replace(' from st)', ' from hs)')}, {_snapshot_ctes()},
      ho as (select query_id as task_id, action_id from f where rn = 1 and action_id is not null),
      ap as (select p.task_id, p.pos, ho.action_id, a.operation as op, a.argument_template as argument, a.semantic_description.value_source as value_source, {', '.join(f"coalesce({'a.' + c if f != 'region' else c}, '') as d_{f}" for f, c in _STORED.items())},
        a.semantic_description.disambiguators as d_disambiguators, a.semantic_description.negative_constraints as d_negative_constraints, a.semantic_description.grounding_priority as d_priority
        from (select distinct task_id, pos from sn) p join ho on ho.task_id = p.task_id join {live('actions')} a on a.action_id = ho.action_id), {_grounded_ctes()}
      select gd.task_id, gd.pos, ho.action_id, element_id, total, matched, confidence, argument from gd join ho on ho.task_id = gd.task_id"""


def _predictions(s, d):  # noqa: ANN001, ANN202
    """A simple baseline scored against each step: it repeats the step before and takes the first element by id."""
    from pyspark.sql import Window as W

    w = W.partitionBy("task_id").orderBy("pos")
    st = E.steps(s, d)
    ids = lambda c: F.array_compact(F.transform(F.coalesce(c, F.array()), G.element_id))
    gold, every = ids(F.col("pos_candidates")), F.concat(ids(F.col("pos_candidates")), ids(F.col("neg_candidates")))
    rows = st.withColumns({"gold": gold, "pred": F.array_min(every), "p_op": F.lag("operation").over(w), "p_arg": F.lag("argument").over(w), "p_repr": F.lag("action_repr").over(w)})
    clean = lambda c: F.lower(X.clean(c, 200))
    op = F.lower("operation")
    return rows.select(
        "task_id", F.coalesce(F.array_contains("gold", F.col("pred")), F.lit(False)).alias("element_ok"), (op == F.lower(F.coalesce("p_op", F.lit("click")))).alias("operation_ok"),
        F.when(op.isin("type", "select"), clean(F.col("argument")) == clean(F.col("p_arg"))).otherwise(True).alias("value_ok"), M.token_f1(F.col("p_repr"), F.col("action_repr")).alias("f1"),
    )


def _records(s, d):  # noqa: ANN001, ANN202
    """The same baseline as records: gold ids, predicted id, operations and values of each step."""
    from pyspark.sql import Window as W

    w = W.partitionBy("task_id").orderBy("pos")
    ids = lambda c: F.array_compact(F.transform(F.coalesce(c, F.array()), G.element_id))
    return E.steps(s, d).select(
        "task_id", ids("pos_candidates").alias("gold"), F.array_min(F.concat(ids("pos_candidates"), ids("neg_candidates"))).alias("pred"), F.col("operation").alias("operation_gold"),
        F.lag("operation").over(w).alias("operation_pred"), F.col("argument").alias("value_gold"), F.lag("argument").over(w).alias("value_pred"),
    )


def _resolved(s, d):  # noqa: ANN001, ANN202
    """Each trace step's target looked up among the candidates that the step observed, and its action in three dialects."""
    get = lambda p, kind="string": F.try_variant_get(F.col("s.step"), p, kind)
    t = table(s, d, "episode_traces").where(F.col("task_id").isNotNull()).select("task_id", "loaded_at", F.explode(nested.json_steps(F.col("trajectory"))).alias("s"))
    target = get("$.target", "variant")
    out = t.select(
        "task_id", "loaded_at", F.col("s.pos").alias("pos"), X.blank(F.coalesce(get("$.operation"), get("$.action"))).alias("op"), get("$.argument").alias("argument"),
        G.identifier(target).alias("target"), F.coalesce(get("$.observation.candidates", "array<variant>"), F.array().cast("array<variant>")).alias("candidates"),
    )
    return G.resolved(out).select("task_id", "loaded_at", "pos", "op", "target", "found", "brackets", "call", "coordinates")


_F1 = """(case when len(p) = 0 and len(g) = 0 then 1.0 when len(p) = 0 or len(g) = 0 then 0.0 else
  2.0 * list_sum(list_transform(list_distinct(p), lambda t: least(len(list_filter(p, lambda x: x = t)), len(list_filter(g, lambda x: x = t))))) / (len(p) + len(g)) end)::double"""
_IDS = "list_filter(list_transform(coalesce({c}, []), lambda c: coalesce(nullif(c.backend_node_id, ''), nullif(c.node_id, ''), nullif(c.attributes['backend_node_id'], ''), nullif(c.attributes['node_id'], ''), nullif(c.attributes['id'], ''), nullif(c.attributes['data_pw_testid'], ''))), lambda z: z is not null)"
_PRED = f"""{STEPS}, q1 as (select *, {_IDS.format(c='pos_candidates')} as gold, {_IDS.format(c='neg_candidates')} as neg, lag(operation) over w as p_op, lag(argument) over w as p_arg, lag(action_repr) over w as p_repr
    from st window w as (partition by task_id order by pos)),
  q2 as (select *, regexp_extract_all(lower(coalesce(p_repr, '')), '[a-z0-9_]+') as p, regexp_extract_all(lower(coalesce(action_repr, '')), '[a-z0-9_]+') as g from q1),
  q3 as materialized (select task_id, coalesce(list_contains(gold, list_min(gold || neg)), false) as element_ok, lower(operation) = lower(coalesce(p_op, 'click')) as operation_ok,
     case when lower(operation) in ('type', 'select') then lower(substring({S.collapse('argument')}, 1, 200)) = lower(substring({S.collapse('p_arg')}, 1, 200)) else true end as value_ok, {_F1} as f1 from q2)"""


def _log(s, d):  # noqa: ANN001, ANN202
    """Task log of the last arrivals of traces: method is the agent that recorded it, num_steps the steps of its trajectory (0 if it cannot be read)."""
    from ..operators import memory
    from ..operators.nested import json_steps

    n = F.coalesce(F.size(json_steps(F.col("trajectory"))), F.lit(0)).alias("num_steps")
    t = memory.upsert(table(s, d, "episode_traces").select("task_id", "loaded_at", "domain", "success", F.col("metadata")["agent"].alias("agent"), n), "task_id", ["loaded_at", "agent", "success", "domain", "num_steps"])
    return t.select(F.coalesce("agent", F.lit("none")).alias("method"), F.coalesce("domain", F.lit("unknown")).alias("domain"), "success", "num_steps")


_CONTAINER = ", ".join(f"j->'$.{k}'" for k in nested.CONTAINERS)
_LOG = f"""t0 as (select *, metadata['agent'] as agent, try_cast(trajectory as json) as j0 from episode_traces where task_id is not null),
  t1 as (select * exclude (j0), case when json_type(j0) = 'VARCHAR' then try_cast(j0->>'$' as json) else j0 end as j from t0),
  t2 as (select *, case when json_type(j) = 'OBJECT' then coalesce({_CONTAINER}, j) else j end as h from t1),
  t3 as (select *, coalesce(case json_type(h) when 'ARRAY' then json_array_length(h)::int when 'OBJECT' then len(list_filter(json_keys(h), lambda k: regexp_full_match(k, '[0-9]+')))::int end, 0) as num_steps from t2),
  l as (select coalesce(agent, 'none') as method, coalesce(domain, 'unknown') as domain, success, num_steps from (select *, row_number() over (partition by task_id
   order by loaded_at desc nulls last, agent desc nulls last, success desc nulls last, domain desc nulls last, num_steps desc) as rn from t3) where rn = 1)"""
_WIL = "round(100.0 * (((s / n::double) + 3.8416 / (2 * n)) / (1 + 3.8416 / n) {sign} 1.96 * sqrt((s / n::double) * (1 - s / n::double) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)), {r})"


def queries() -> dict:
    hint = lambda s, d: E.live_tasks(s, d).select("task_id", F.lower(X.collapse(F.col("instruction"))).alias("t"))
    rates = lambda s, d: M.success_rates(_log(s, d))
    scores = lambda s, d: rates(s, d).where(F.col("domain").isNotNull()).select("method", "domain", F.round("task_sr", 1).alias("score"))
    counts = lambda s, d: _log(s, d).groupBy("domain").agg(F.count("*").alias("n"))
    return {
        "step_evidence": lambda s, d: E.evidence(E.steps(s, d)).select("task_id", "pos", "op", "kind", F.array_sort("tokens").alias("tokens")),
        "stage_boundaries": lambda s, d: _boundaries(s, d).select("task_id", "pos", "distance", "split", "boundary", "stage"),
        "stage_spans": lambda s, d: E.stages(_boundaries(s, d)),
        "stage_merge": lambda s, d: E.merge_low_confidence(E.stage_rows(_boundaries(s, d))),
        "span_repair": lambda s, d: E.repaired(_damaged(E.stages(_boundaries(s, d))), E.lengths(E.steps(s, d))),
        "span_partition_check": lambda s, d: E.span_check(_damaged(E.stages(_boundaries(s, d))), E.lengths(E.steps(s, d))),
        "span_range_join": lambda s, d: E.assigned(E.steps(s, d).select("task_id", "pos"), _damaged(E.stages(_boundaries(s, d)))).select("task_id", "pos", "stage"),
        "history_tail": lambda s, d: E.history(E.steps(s, d)),
        "neighbour_text": lambda s, d: E.neighbours(E.steps(s, d)),
        "descriptor_fields": _described,
        "page_snapshot": lambda s, d: _page(s, d).select("task_id", "pos", "index", "eid", "role", "label", "parent", "sibling", "nearby", "place", "region", "salience", "interactive", "rank"),
        "page_summary": lambda s, d: G.page_summaries(_page(s, d)),
        "ground_best_element": _ground,
        "ground_breakdown": lambda s, d: G.breakdown(_patterns(s, d), _page(s, d)),
        "ground_memory_actions": _ground_memory,
        "agent_predictions": _predicted,
        "salience_topk": lambda s, d: G.salient(G.elements(E.steps(s, d)), E.live_tasks(s, d).select("task_id", X.blank(F.col("instruction")).alias("query"))),
        "serialize_actions": lambda s, d: (lambda st: st.select("task_id", "pos", *[c.alias(n) for n, c in G.serialized(F.col("operation"), G.element_id(F.get("pos_candidates", F.lit(0))), F.col("argument")).items()]))(E.steps(s, d)),
        "url_category": lambda s, d: E.steps(s, d).select("task_id", "pos", F.coalesce(F.parse_url("url", F.lit("HOST")), F.lit("")).alias("host"), F.lower(F.coalesce(F.parse_url("url", F.lit("PATH")), F.lit(""))).alias("path"), "url").select("task_id", "pos", "host", F.when(F.coalesce(F.length("url"), F.lit(0)) == 0, "unknown").otherwise(F.expr(D.case("path", {**D.URL_CATEGORIES}, ""))).alias("c"), "path").select("task_id", "pos", "host", F.when(F.col("c") != "", F.col("c")).when(F.col("path").isin("", "/"), "home").otherwise("detail_or_form").alias("category")),
        "state_flags": lambda s, d: table(s, d, "documents").select("doc_id", F.lower(X.blank(F.col("text"))).alias("t")).select("doc_id", *[F.expr("case " + " ".join(f"when contains(t, {D._q(w)}) then {D._q(w)}" for w in ws) + " else '' end").alias(f"has_{n}") for n, ws in D.STATES.items()]),
        "domain_hint": lambda s, d: hint(s, d).select("task_id", F.expr(D.case("t", D.DOMAINS, "other")).alias("domain_hint")),
        "quoted_constraints": lambda s, d: table(s, d, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("\"([^\"]+)\""), F.lit(1))).alias("i", "value")).select("doc_id", F.concat(F.lit("quoted_value_"), F.col("i") + 1).alias("slot"), "value"),
        "success_rate_by_domain": rates,
        "weighted_sr": lambda s, d: M.weighted(scores(s, d), counts(s, d)),
        "table_recompute": lambda s, d: M.table_recompute(scores(s, d), counts(s, d)),
        "step_metrics_percent": lambda s, d: M.step_metrics_percent(_predictions(s, d)),
        "step_metrics_records": lambda s, d: M.step_metrics_records(_records(s, d)),
        "run_metrics": lambda s, d: M.run_metrics(_log(s, d)),
        "resolve_actions": _resolved,
        "token_f1": lambda s, d: _predictions(s, d).groupBy("task_id").agg(F.round(F.avg("f1"), 6).alias("f1")),
        "llm_cost": lambda s, d: E.stages(_boundaries(s, d)).groupBy("task_id").agg(F.count("*").alias("stages")).join(E.lengths(E.steps(s, d)), "task_id").select("task_id", M.construction_calls(F.col("stages"), F.col("n"), F.lit(0)).alias("calls"), M.cost_usd(F.col("n") * 1000, F.col("stages") * 200, 2.5, 10.0).alias("usd")),
        "split_counts": lambda s, d: E.live_tasks(s, d).groupBy(split_name(F.col("split")).alias("split")).agg(F.count("*").alias("n")),
        "website_alias": lambda s, d: cut(schema_drift.steps(s, d)).groupBy("website").agg(F.countDistinct("task_id").alias("tasks"), F.count("step_pos").alias("steps")),
    }


# fixed values: other names of the splits
SPLIT_ALIASES = {"training": "train", "test_task": "cross_task", "test_website": "cross_website", "test_domain": "cross_domain"}


def split_name(c):  # noqa: ANN001, ANN201
    """Canonical split name; unknown where null or blank."""
    t = F.translate(F.lower(X.collapse(c)), " -", "__")
    out = F.when(t == "", "unknown")
    for alias, name in SPLIT_ALIASES.items():
        out = out.when(t == alias, name)
    return out.otherwise(t)


def oracle_sql() -> dict[str, str]:
    tail = "list(operation) over (partition by task_id order by pos rows between 6 preceding and 1 preceding)"
    lg = lambda k: f"{'lag' if k < 0 else 'lead'}(nullif(label, ''), {abs(k)}) over (partition by task_id order by pos)"
    eid = "coalesce(nullif(c.backend_node_id, ''), nullif(c.node_id, ''), nullif(c.attributes['backend_node_id'], ''), nullif(c.attributes['node_id'], ''), nullif(c.attributes['id'], ''), nullif(c.attributes['data_pw_testid'], ''))"
    esc = lambda x: f"replace(replace(coalesce({x}, ''), '\\', '\\\\'), '''', '\\''')"
    typed = "o in ('type', 'input', 'fill')"
    rate = f"""with {_LOG}, g as (select method, domain, count(*) as n, sum(coalesce(success, false)::int) as s, sum(num_steps) as steps from l group by grouping sets ((method, domain), (method)))
      select method, domain, n, s as successes, round(100.0 * s / n, 6) as task_sr, round(steps / n, 6) as avg_steps, {_WIL.format(sign='-', r=6)} as low, {_WIL.format(sign='+', r=6)} as high from g"""
    sc = f"""{_LOG}, sc as (select method, domain, round(round(100.0 * sum(coalesce(success, false)::int) / count(*), 6), 1) as score from l group by 1, 2), ct as (select domain, count(*) as n from l group by 1)"""
    host = "coalesce(nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), ''), '')"
    path = "lower(coalesce(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''))"
    return {
        "step_evidence": f"with {EVIDENCE} select task_id, pos, op, kind, list_sort(tokens) as tokens from ev",
        "stage_boundaries": f"with {BOUNDARIES} select task_id, pos, distance, split, boundary, stage from bo",
        "stage_spans": f"with {STAGES} select * from sg",
        "stage_merge": MERGED,
        "span_repair": f"""with recursive {STAGES}, {_DAMAGED}, o as (select dm.*, ln.n, row_number() over (partition by dm.task_id order by start, stage) as nth, count(*) over (partition by dm.task_id) as many from dm join ln on ln.task_id = dm.task_id),
          fix as (select task_id, stage, nth, many, n, 0 as start, case when nth = many then n - 1 else least(greatest("end", 0), n - 1) end as "end" from o where nth = 1
            union all select o.task_id, o.stage, o.nth, o.many, o.n, f."end" + 1, case when o.nth = o.many then o.n - 1 else least(greatest(o."end", f."end" + 1), o.n - 1) end
              from fix f join o on o.task_id = f.task_id and o.nth = f.nth + 1 where f."end" + 1 <= o.n - 1),
          l as (select *, max(nth) over (partition by task_id) as top from fix)
          select task_id, stage, start::int as start, (case when nth = top then n - 1 else "end" end)::int as "end" from l""",
        "span_partition_check": f"""with {STAGES}, {_DAMAGED}, x as (select *, lag("end") over (partition by task_id order by start) as p_end from dm),
          y as (select task_id, bool_and(coalesce(start = p_end + 1, true)) as contiguous, bool_or(coalesce(start <= p_end, false)) as "overlaps", sum("end" - start + 1) as covered, min(start) as lo, max("end") as hi from x group by 1)
          select y.task_id, contiguous, "overlaps", covered = n and lo = 0 and hi = n - 1 and not "overlaps" as covers from y join ln on ln.task_id = y.task_id""",
        "span_range_join": f"""with {STAGES}, {_DAMAGED} select st.task_id, st.pos, dm.stage from st left join dm on dm.task_id = st.task_id and st.pos between dm.start and dm."end" """,
        "history_tail": f"with {STEPS} select task_id, pos, coalesce(array_to_string({tail}, ' '), '') as history from st",
        "neighbour_text": f"""with {STEPS} select task_id, pos, concat_ws(' ', {lg(-1)}, {lg(1)}) as sibling_text, concat_ws(' ', {lg(-2)}, {lg(-1)}, {lg(1)}, {lg(2)}) as nearby_text,
          format('element {{}} of {{}}', pos + 1, count(*) over (partition by task_id)) as relative_position from st""",
        "descriptor_fields": _described_sql(),
        "page_snapshot": f"with {STEPS}, {_snapshot_ctes()} select task_id, pos, index, eid, role, label, parent, sibling, nearby, place, region, salience, interactive, rank from sn",
        "page_summary": f"""with {STEPS}, {_snapshot_ctes()} select task_id, pos, substring({S.collapse("'Salient elements: ' || string_agg('- ' || eid || ': role=' || role || '; text=' || label || '; context=' || concat_ws(' | ', nullif(parent, ''), nullif(region, '')), ' ' order by rank)")}, 1, 2400) as summary from sn where rank < 30 group by 1, 2""",
        "salience_topk": f"""with {STEPS}, {_snapshot_ctes()}, q as (select task_id, {S.token_set('instruction')} as qt from {TASKS}),
          z as (select sn.task_id, pos, index, coalesce({S.q('')} || nullif(eid, 'el_' || index), '') as key, {S.token_set("concat_ws(' ', role, label, parent, sib)")} as t, qt,
            case when role in ('button', 'link', 'menuitem', 'checkbox', 'radio', 'input', 'option', 'textbox', 'searchbox', 'combobox', 'textarea') then 1.0 else 0.0 end as inter from sn join q on q.task_id = sn.task_id),
          y as (select task_id, pos, index, key, round(1.0 + inter + {S.shared('qt', 't')}::double / greatest(1, len(qt) + len(t) - {S.shared('qt', 't')}) + 0.000001, 9) as score from z)
          select task_id, pos, index, score, rank from (select *, row_number() over (partition by task_id, pos order by score desc, key, index) as rank from y) where rank <= 30""",
        "ground_best_element": _ground_sql(),
        "ground_breakdown": _ground_sql("""select task_id, pos, rn as rank, eid as element_id, round(total, 6) as total, round(op_score, 6) as op_score, round(case when den > 0 then num / den else 0.0 end, 6) as fields,
            round(case when len(more) > 0 then list_sum(more) / len(more) else 0.0 end, 6) as disambiguators, round(against, 6) as negative, round(state, 6) as state, round(least(0.04, salience / 100.0) + greatest(0.0, 0.03 - rank * 0.001), 6) as tie, matched,
            list_filter([case when op_score = 0 then 'operation/role mismatch' end, case when state > 0 then 'candidate appears disabled or hidden' end, case when against > 0 then 'negative constraint matched' end], lambda z: z is not null) as rejected from x4 where rn <= 12"""),
        "ground_memory_actions": _ground_memory_sql(),
        "agent_predictions": _predicted_sql(),
        "serialize_actions": f"""with {STEPS}, x as (select *, pos_candidates[1] as c, lower(operation) as o, coalesce(argument, '') as a from st), y as (select *, {eid} as e from x), z as (select *, coalesce(length(e) > 0, false) as has from y)
          select task_id, pos, case when o = 'click' and has then 'click [' || e || ']' when {typed} and has then 'type [' || e || '] [' || a || ']' when o = 'select' and has then 'select [' || e || '] [' || a || ']'
            when o = 'hover' and has then 'hover [' || e || ']' when o = 'press' then 'press [' || case when a = '' then 'ENTER' else a end || ']' when o = 'scroll' then 'scroll [' || case when a = '' then 'down' else a end || ']' else 'stop' end as brackets,
            case when o = 'click' and has then 'click(''' || {esc('e')} || ''')' when {typed} and has then 'fill(''' || {esc('e')} || ''', ''' || {esc('a')} || ''')' when o = 'select' and has then 'select_option(''' || {esc('e')} || ''', ''' || {esc('a')} || ''')'
            when o = 'hover' and has then 'hover(''' || {esc('e')} || ''')' when o = 'press' then 'press(''' || case when a = '' then 'Enter' else {esc('a')} end || ''')' when o = 'scroll' then 'scroll(''' || case when a = '' then 'down' else {esc('a')} end || ''')' else 'stop()' end as call from z""",
        "url_category": f"""with {STEPS}, x as (select *, {host} as host, {path} as path from st)
          select task_id, pos, host, case when coalesce(length(url), 0) = 0 then 'unknown' else case when ({D.case('path', D.URL_CATEGORIES, '')}) <> '' then ({D.case('path', D.URL_CATEGORIES, '')}) when path in ('', '/') then 'home' else 'detail_or_form' end end as category from x""",
        "state_flags": "select doc_id, " + ", ".join("case " + " ".join(f"when contains(t, {D._q(w)}) then {D._q(w)}" for w in ws) + f" else '' end as has_{n}" for n, ws in D.STATES.items()) + " from (select doc_id, lower(coalesce(text, '')) as t from documents)",
        "domain_hint": f"select task_id, {D.case('t', D.DOMAINS, 'other')} as domain_hint from (select task_id, lower({S.collapse('instruction')}) as t from {TASKS})",
        "quoted_constraints": """select doc_id, 'quoted_value_' || s.i as slot, v[s.i] as value from (select doc_id, regexp_extract_all(text, '"([^"]+)"', 1) as v from documents), unnest(range(1, len(v) + 1)) as s(i)""",
        "success_rate_by_domain": rate,
        "weighted_sr": f"with {sc} select method, round(sum(n * score) / sum(n), 6) as weighted_sr, sum((n is null)::int) as missing from sc left join ct on ct.domain = sc.domain group by 1",
        "table_recompute": f"with {sc}, g as (select method, round_even(sum(n * score / 100.0), 0)::bigint as s, sum(n) as n from sc join ct on ct.domain = sc.domain group by 1) select method, s as successes, n, {_WIL.format(sign='-', r=4)} as low, {_WIL.format(sign='+', r=4)} as high from g",
        "step_metrics_percent": f"""with {_PRED}, t as (select task_id, bool_and(element_ok and operation_ok and value_ok) as a from q3 group by 1)
          select count(*) as num_steps, (select count(*) from t) as num_tasks, round(100.0 * avg(element_ok::int), 6) as element_accuracy, round(100.0 * avg(operation_ok::int), 6) as operation_accuracy, round(100.0 * avg(value_ok::int), 6) as value_accuracy,
          round(100.0 * avg(f1), 6) as action_f1, round(100.0 * avg((element_ok and operation_ok and value_ok)::int), 6) as step_success_rate, (select round(100.0 * avg(a::int), 6) from t) as task_success_rate from q3""",
        "step_metrics_records": f"""with {STEPS}, r as (select task_id, {_IDS.format(c='pos_candidates')} as gold, {_IDS.format(c='neg_candidates')} as neg, operation, argument, lag(operation) over w as p_op, lag(argument) over w as p_arg from st window w as (partition by task_id order by pos)),
          m as (select task_id, (case when len(gold) > 0 then coalesce(list_contains(gold, list_min(gold || neg)), false) else list_min(neg) is null end)::int as e, (lower(operation) = lower(coalesce(p_op, '')))::int as o,
            (coalesce(length(argument), 0) = 0 or trim(argument) = trim(coalesce(p_arg, '')))::int as v from r),
          t as (select task_id, min(least(e, o, v)) as a from m group by 1)
          select count(*) as num_steps, (select count(*) from t) as num_tasks, round(avg(e), 6) as element_accuracy, round(avg(o), 6) as operation_accuracy, round(avg(v), 6) as value_accuracy, round(sum((e + o + v) / 3.0) / count(*), 6) as action_f1,
            round(avg(least(e, o, v)), 6) as step_success_rate, (select round(avg(a), 6) from t) as task_success_rate from m""",
        "run_metrics": f"""with {_LOG} select domain, count(*) as num_tasks, sum(coalesce(success, false)::int) as success_count, round(100.0 * sum(coalesce(success, false)::int) / count(*), 6) as task_success_rate,
            round(sum(num_steps) / count(*), 6) as avg_steps, sum((coalesce(success, false) and num_steps > 0)::int) as inserted from l group by 1""",
        "token_f1": f"with {_PRED} select task_id, round(avg(f1), 6) as f1 from q3 group by 1",
        "llm_cost": f"with {STAGES}, x as (select task_id, count(*) as stages from sg group by 1), ln as (select task_id, count(*) as n from st group by 1) select x.task_id, 2 + stages + n as calls, round(n * 1000 / 1e6 * 2.5 + stages * 200 / 1e6 * 10.0, 8) as usd from x join ln on ln.task_id = x.task_id",
        "split_counts": f"""select split, count(*) as n from (select case {' '.join(f"when t = '{a}' then '{b}'" for a, b in SPLIT_ALIASES.items())} when t = '' then 'unknown' else t end as split from (select translate(lower({S.collapse('split')}), ' -', '__') as t from {TASKS})) group by 1""",
    }
