"""Queries of memory construction, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import construct as C
from ..operators import describe as D
from ..operators import episodes as E
from ..operators import memory, retrieval
from ..operators.maintenance import canonical_operation
from . import sqltext as S
from .episode_queries import _DAMAGED, STAGES, STEPS, TASKS, _boundaries, _damaged, described_ctes
from .maintenance_queries import canonical_operation as canonical_sql
from .memory_queries import live
from .retrieval_queries import _conditions


def _tasks(s, d):  # noqa: ANN001, ANN202
    return E.live_tasks(s, d).select("task_id", "instruction")


def _stages(s, d):  # noqa: ANN001, ANN202
    return C.stages(E.stages(_boundaries(s, d)), C.intents(_tasks(s, d)))


def _check(s, d):  # noqa: ANN001, ANN202
    """The check on stages of which every third is missing, and on actions whose step is in one of the others."""
    spans, rows = _damaged(E.stages(_boundaries(s, d))), E.steps(s, d)
    owned = E.assigned(rows.select("task_id", "pos"), spans).where(F.col("stage").isNotNull()).select("task_id", "pos")
    return C.consistency(spans.withColumn("n_conditions", F.lit(2)), rows, owned)


def _order(s, d):  # noqa: ANN001, ANN202
    """Live stages below each intent by their standing on the intent's text."""
    st = memory.live(s, d, "stages").select("stage_id", "parent_intent_id", "pre_conditions", "post_conditions", F.coalesce(F.col("span")[0], F.lit(0)).alias("start"))
    i = memory.live(s, d, "intents").select(F.col("intent_id").alias("parent_intent_id"), X.blank(F.col("canonical_intent")).alias("text"))
    rows = retrieval.conditions(st.join(i, "parent_intent_id"), F.col("pre_conditions"), F.col("post_conditions"), F.col("text"))
    met = (F.col("pre_score") >= 0.20) & (F.size(F.coalesce("pre_conditions", F.array())) > 0)
    rows = rows.select("parent_intent_id", "stage_id", "start", F.round("condition_score", 9).alias("score"), C.status(F.col("decision"), met, F.col("condition_score")).alias("status"))
    return C.ordered(rows, "parent_intent_id")


_FILLED = {"element_purpose": "element_purpose", "form_section": "section", "field_slot": "slot", "value_source": "value_source", "expected_state_change": "expected_state_change"}


def _enriched(s, d):  # noqa: ANN001, ANN202
    """Stored descriptors with the fields they lack, inferred from those they have."""
    sd = lambda f: F.col(f"semantic_description.{f}")
    a = memory.live(s, d, "actions").select(
        "action_id", canonical_operation(F.col("operation")).alias("op"), F.col("argument_template").alias("argument"), X.collapse(sd("label_or_text")).alias("label"),
        F.coalesce(F.nullif(X.normal_key(sd("role")), F.lit("")), F.lit("generic")).alias("role"), X.collapse(sd("parent_context")).alias("parent"), X.collapse(sd("sibling_context")).alias("sibling"),
        *[sd(f).alias(f"own_{f}") for f in _FILLED],
    )
    x = D.described(a)
    return x.select("action_id", *[c.alias(f) for f, c in D.enriched({f: F.col(f"own_{f}") for f in _FILLED}, {f: F.col(c) for f, c in _FILLED.items()}).items()])


def queries() -> dict:
    return {
        "enrich_descriptors": _enriched,
        "construct_intents": lambda s, d: C.intents(_tasks(s, d)),
        "construct_stages": _stages,
        "construct_actions": lambda s, d: C.actions(E.steps(s, d), _stages(s, d)),
        "consistency_check": _check,
        "stage_transitions": lambda s, d: C.transitions(_stages(s, d)),
        "stage_order": _order,
    }


def _id(prefix: str, *parts: str) -> str:
    return f"'{prefix}_' || substr(sha1(concat_ws(chr(1), {', '.join(f'coalesce({p}::varchar, {S.q(str())})' for p in parts)})), 1, 12)"


_QUOTED = "regexp_extract_all(coalesce(instruction, ''), '(''[^'']+''|\"[^\"]+\")')"
_INTENTS = f"""ci0 as (select task_id, instruction, lower(trim(coalesce(instruction, ''))) as low from {TASKS}),
  ci1 as (select task_id, {S.collapse("regexp_replace(low, '[.]+$', '')")} as canonical_intent, {D.case('low', D.DOMAINS, 'other')} as domain_hint,
    list_transform({_QUOTED}, lambda q, i: 'quoted_value_' || i || '=' || substring(q, 2, length(q) - 2)) as constraints from ci0),
  ci as materialized (select *, {_id('intent', 'canonical_intent', 'domain_hint', "array_to_string(constraints, ';')")} as intent_id from ci1)"""


def _by_kind(at: int) -> str:
    value = lambda v: S.words(v[0]) if at == 0 else S.words([v[1]])
    return "case kind " + " ".join(f"when '{k}' then {value(v)}" for k, v in C.CONDITIONS.items()) + " end"


_STAGES = f"""{STAGES}, {_INTENTS}, cs as materialized (select {_id('stage', 'sg.task_id', 'intent_id', 'stage', 'name', 'start', '"end"')} as stage_id, intent_id, sg.task_id, stage, name, start, "end", kind,
  {_by_kind(0)} as pre_conditions, {_by_kind(1)} as post_conditions from sg join ci on ci.task_id = sg.task_id)"""
_WARN = f"""list_filter([case when label = '' and parent = '' then {S.q(C.WARNINGS['evidence'])} end, case when role in ('generic', 'div', 'span') and op in ('click', 'type', 'select') then {S.q(C.WARNINGS['role'])} end,
  case when expected_state_change = '' then {S.q(C.WARNINGS['change'])} end, case when grounding_priority = '' then {S.q(C.WARNINGS['priority'])} end], lambda z: z is not null)"""


def oracle_sql() -> dict[str, str]:
    over = "over (partition by task_id order by stage)"
    pre, post = "array_to_string(pre_conditions, '; ')", "array_to_string(post_conditions, '; ')"
    rank = "case status " + " ".join(f"when '{k}' then {v}" for k, v in C.STATUS.items()) + " end"
    own = f"""select action_id as task_id, 0 as pos, {canonical_sql('operation')} as op, argument_template as argument, {S.collapse('semantic_description.label_or_text')} as label,
        coalesce(nullif({S.normal_key('semantic_description.role')}, ''), 'generic') as role, {S.collapse('semantic_description.parent_context')} as parent, {S.collapse('semantic_description.sibling_context')} as sibling from {live('actions')}"""
    return {
        "enrich_descriptors": f"""with {described_ctes(own)} select action_id, {', '.join(f"coalesce(nullif(semantic_description.{f}, ''), dd.{c}) as {f}" for f, c in _FILLED.items())} from {live('actions')} a join dd on dd.task_id = a.action_id""",
        "construct_intents": f"with {_INTENTS} select task_id, intent_id, canonical_intent, domain_hint, constraints from ci",
        "construct_stages": f"with {_STAGES} select * from cs",
        "construct_actions": f"""with {_STAGES}, {described_ctes()} select {_id('act', 'dd.task_id', 'stage_id', 'pos', 'op', 'label', 'role')} as action_id, stage_id, dd.task_id, pos as step_index, op as operation, argument as argument_template,
            role, label as label_or_text, parent, sibling, {', '.join(D.FIELDS)}, {_WARN} as warnings from dd join cs on cs.task_id = dd.task_id and pos between cs.start and cs."end" """,
        "consistency_check": f"""with {STAGES}, {_DAMAGED}, w as (select *, lag("end") over (partition by task_id order by start, stage) as p_end, lag(stage) over (partition by task_id order by start, stage) as p_stage from dm),
          sp as (select task_id, bool_or(coalesce(stage < p_stage, false)) as unordered, bool_or(coalesce(start <> p_end + 1, false)) as gap, bool_or(coalesce(start <= p_end, false)) as overlap from w group by 1),
          cov as (select st.task_id, st.pos, count(dm.stage) as times from st left join dm on dm.task_id = st.task_id and st.pos between dm.start and dm."end" group by 1, 2),
          c as (select task_id, bool_and(times = 1) as once from cov group by 1)
          select c.task_id, list_sort(list_filter([case when unordered then 'stage spans are not ordered' end, case when gap then 'stage spans are not contiguous' end, case when overlap then 'stage spans overlap' end,
            case when not once then 'stage spans do not cover the steps exactly' end, case when overlap then 'steps are covered more than once' end, case when not once then 'actions do not cover the steps exactly once' end],
            lambda z: z is not null)) as errors from c left join sp on sp.task_id = c.task_id""",
        "stage_transitions": f"""with {_STAGES} select stage_id, name, {pre} as pre, {post} as post, lag(stage_id) {over} as previous_id, lag({post}) {over} as previous_post, lead(stage_id) {over} as next_id, lead({pre}) {over} as next_pre from cs""",
        "stage_order": f"""with x as (select stage_id, parent_intent_id, pre_conditions, post_conditions, coalesce(span[1], 0) as start, coalesce(canonical_intent, '') as text, {S.token_set("coalesce(canonical_intent, '')")} as tokens
            from {live('stages')} s join {live('intents')} i on i.intent_id = s.parent_intent_id),
          y as (select parent_intent_id, stage_id, start, round(condition_score, 9) as score, case when decision = 'conflict' then 'conflict' when decision = 'already_completed' then 'completed'
            when pre_score >= 0.20 and len(coalesce(pre_conditions, [])) > 0 then 'ready' when condition_score > 0 then 'in_progress' else 'not_ready' end as status from {_conditions('x')})
          select *, row_number() over (partition by parent_intent_id order by {rank} desc, score desc, start, stage_id) as place from y""",
    }
