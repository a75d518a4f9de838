"""Queries of maintenance, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import maintenance as M
from ..operators import memory
from . import sqltext as S
from .memory_queries import DESCRIPTOR, STAGE_TEXT, live


def canonical_operation(x: str) -> str:
    op = f"{S.normal_key(x)}"
    cases = " ".join(f"when list_has_any(string_split({op}, ' '), {S.words(a)}) then '{n}'" for n, a in M.OPERATIONS.items())
    return f"""(case {cases} when {S.contains_any(op, ['click', 'press'])} then 'click' when {S.contains_any(op, ['type', 'fill', 'input'])} then 'type'
      when {S.contains_any(op, ['select', 'option'])} then 'select' when {op} = '' then 'click' else {op} end)"""


def _full(x: str) -> str:
    return f"coalesce(length({x}) > 0, false)"


_SD = "semantic_description"
_CAN = canonical_operation("operation")
PROBLEMS = f"""list_filter([case when {_CAN} in ('click', 'type', 'select') and not {_full(_SD + '.role')} then 'role is missing' end,
  case when {_CAN} in ('click', 'type', 'select') and not ({' or '.join(_full(f'{_SD}.{f}') for f in M.EVIDENCE_FIELDS)}) then 'no transferable grounding evidence' end,
  case when coalesce(operation = 'type', false) and not {_full('argument_template')} then 'type action has no argument template' end], lambda z: z is not null)"""
_GROUND = " + ".join(f"{_full(f'{_SD}.{f}')}::int" for f in M.GROUNDING_FIELDS)
_ISSUES = f"""with i as (select * from {live('intents')}), s as (select * from {live('stages')}), a as (select * from {live('actions')})
select 'error' as severity, 'stage' as record_type, stage_id as record_id, 'missing parent intent' as message from s where not exists (select 1 from i where i.intent_id = s.parent_intent_id)
union all select 'error', 'action', action_id, 'missing parent stage' from a where not exists (select 1 from s where s.stage_id = a.parent_stage_id)
union all select 'warning', 'stage', stage_id, 'too few pre-conditions' from s where len(coalesce(pre_conditions, [])) < 1
union all select 'warning', 'stage', stage_id, 'too few post-conditions' from s where len(coalesce(post_conditions, [])) < 1
union all select 'error', 'stage', stage_id, 'empty stage name' from s where {S.collapse('name')} = ''
union all select 'warning', 'action', action_id, unnest({PROBLEMS}) from a
union all select 'warning', 'action', action_id, 'semantic descriptor has few grounding fields' from a where {_GROUND} < 2
union all select 'warning', 'stage', parent_stage_id, 'stage has many action nodes' from a where parent_stage_id is not null group by parent_stage_id having count(*) > 50"""
_STATS = f"""with i as (select * from {live('intents')}), s as (select * from {live('stages')}), a as (select * from {live('actions')}),
d as (select source.dataset as d from i union all select source.dataset from s union all select source.dataset from a)
select 'intents' as name, '' as key, count(*)::double as n from i union all select 'stages', '', count(*) from s union all select 'actions', '', count(*) from a
union all select 'operation', coalesce(operation, ''), count(*) from a group by 2 union all select 'domain', coalesce(domain_hint, ''), count(*) from i group by 2
union all select 'dataset', d, count(*) from d where d is not null group by 2
union all select 'stages_per_intent', '', round(avg(c), 9) from (select count(*) as c from s where parent_intent_id is not null group by parent_intent_id)
union all select 'actions_per_stage', '', round(avg(c), 9) from (select count(*) as c from a where parent_stage_id is not null group by parent_stage_id)"""

_ITEXT = "concat_ws(' ', coalesce(canonical_intent, ''), coalesce(domain_hint, ''), array_to_string(list_transform(coalesce(constraints, []), lambda c: coalesce(c.slot, '') || ':' || coalesce(c.value, '')), ' '))"
_REPS = f"""m as materialized (select intent_id as id, list_sort({S.space_tokens(_ITEXT)}) as tokens from {live('intents')}),
  r as materialized (select min(id) as id, tokens, len(tokens) as n from m where len(tokens) > 0 group by tokens),
  p as materialized (select a.id as id_a, b.id as id_b, round({S.jaccard('a.tokens', 'b.tokens')}, 9) as score from r a join r b on a.id < b.id and least(a.n, b.n) >= 0.93 * greatest(a.n, b.n) - 1e-9
    where {S.jaccard('a.tokens', 'b.tokens')} >= 0.93)"""
_CLASSES = f"""with {_REPS} select m.id as intent_id, r.id as class_id, (select count(*) from p where p.id_a = r.id or p.id_b = r.id) as links from m join r on r.tokens = m.tokens"""
_STAGE_DUPS = f"""with m as (select stage_id as id, parent_intent_id as parent, list_sort({S.space_tokens(STAGE_TEXT)}) as tokens from {live('stages')} where parent_intent_id is not null),
  r as (select min(id) as id, parent, tokens from m where len(tokens) > 0 group by parent, tokens)
  select a.id as id_a, b.id as id_b, round({S.jaccard('a.tokens', 'b.tokens')}, 9) as score from r a join r b on a.parent = b.parent and a.id < b.id where {S.jaccard('a.tokens', 'b.tokens')} >= 0.9"""


def _action_dups() -> str:
    num, den = [], []
    for f, w in M.SIMILARITY_WEIGHTS.items():
        both = f"({_full('a.' + f)} and {_full('b.' + f)})"
        score = f"({S.normal_key('a.' + f)} = {S.normal_key('b.' + f)})::int::double" if f == "role" else S.jaccard(f"a.t_{f}", f"b.t_{f}")
        num.append(f"case when {both} then {w} * {score} else 0.0 end")
        den.append(f"case when {both} then {w} else 0.0 end")
    fields = ", ".join(f"{_SD}.{f} as {f}" for f in M.SIMILARITY_WEIGHTS)
    tokens = ", ".join(f"{S.word_tokens(f)} as t_{f}" for f in M.SIMILARITY_WEIGHTS)
    n, d = f"({' + '.join(num)})", f"({' + '.join(den)})"
    return f"""with x as (select action_id, parent_stage_id, coalesce(operation, '') as operation, {fields}, {DESCRIPTOR} as whole from {live('actions')} where parent_stage_id is not null),
      r as materialized (select *, {tokens}, {S.word_tokens('whole')} as t_whole from (select min(action_id) as id, * exclude (action_id) from x group by all)),
      c as (select a.id as id_a, b.id as id_b, round(case when {d} > 0 then {n}::double / {d} else {S.jaccard('a.t_whole', 'b.t_whole')} end, 9) as score
        from r a join r b on a.parent_stage_id = b.parent_stage_id and a.operation = b.operation and a.id < b.id)
      select * from c where score >= 0.92"""


_MERGE = f"""with recursive {_REPS.replace('m as', 'm as', 1)},
  o as (select id, row_number() over (order by id) as k from (select id_a as id from p union select id_b from p)),
  w as (select 0::bigint as k, []::varchar[] as alive union all
        select w.k + 1, case when exists (select 1 from p where p.id_b = o.id and list_contains(w.alive, p.id_a)) then w.alive else list_append(w.alive, o.id) end
        from w join o on o.k = w.k + 1),
  z as (select unnest(alive) as id from (select alive from w order by k desc limit 1)),
  g as (select id_b as rep, min(id_a) as kept from p where id_a in (select id from z) group by 1),
  u as (select m.id, coalesce(g.kept, r.id) as kept from m join r on r.tokens = m.tokens left join g on g.rep = r.id)
  select id as removed, kept, (select count(*) from {live('stages')} s where s.parent_intent_id = u.id) as stages_moved from u where kept <> id"""


def queries() -> dict:
    return {
        "memory_stats": M.stats,
        "memory_issues": M.issues,
        "near_dup_intents": M.near_dup_intents,
        "near_dup_classes": M.near_dup_classes,
        "near_dup_stages": M.near_dup_stages,
        "near_dup_actions": M.near_dup_actions,
        "near_dup_merge": M.near_dup_merge,
        "inspect_memory": M.inspection,
        "remapped_stages": M.remapped_stages,
        "clean_memory": M.cleaned,
        "canonical_operation": lambda s, d: memory.live(s, d, "actions").select("action_id", M.canonical_operation(F.col("operation")).alias("operation")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "memory_stats": _STATS,
        "memory_issues": _ISSUES,
        "near_dup_intents": f"with {_REPS} select * from p",
        "near_dup_classes": _CLASSES,
        "near_dup_stages": _STAGE_DUPS,
        "near_dup_actions": _action_dups(),
        "near_dup_merge": _MERGE,
        "inspect_memory": f"""select *, null::varchar as other_id, null::double as score from ({_ISSUES})
          union all select 'info', 'intent', id_a, 'near-duplicate record', id_b, score from (with {_REPS} select * from p)
          union all select 'info', 'stage', id_a, 'near-duplicate record', id_b, score from ({_STAGE_DUPS}) union all select 'info', 'action', id_a, 'near-duplicate record', id_b, score from ({_action_dups()})""",
        "remapped_stages": f"select stage_id, parent_intent_id as old_parent, kept as new_parent from {live('stages')} s join ({_MERGE}) g on g.removed = s.parent_intent_id",
        "clean_memory": f"""with s as (select stage_id from {live('stages')} where parent_intent_id in (select intent_id from {live('intents')})), g as ({_MERGE})
          select 'intent' as level, (select count(*) from {live('intents')}) as before, 0::bigint as orphans, (select count(*) from g) as merged
          union all select 'stage', (select count(*) from {live('stages')}), (select count(*) from {live('stages')}) - (select count(*) from s), 0
          union all select 'action', (select count(*) from {live('actions')}), (select count(*) from {live('actions')} where parent_stage_id is null or parent_stage_id not in (select stage_id from s)), 0""",
        "canonical_operation": f"select action_id, {canonical_operation('operation')} as operation from {live('actions')}",
    }
