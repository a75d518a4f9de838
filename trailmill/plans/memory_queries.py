"""Queries on the memory tree, with their SQL."""

from __future__ import annotations

from ..operators import memory
from . import sqltext as S

_TIES = {"intents": "canonical_intent, batch_no", "stages": "parent_intent_id, name", "actions": "parent_stage_id, operation, argument_template"}


def live(name: str) -> str:
    """Live rows of a level: the last row of each key unless it is deleted."""
    key = {"intents": "intent_id", "stages": "stage_id", "actions": "action_id"}[name]
    order = ", ".join(f"{c} desc nulls last" for c in ["loaded_at", *_TIES[name].split(", ")])
    dead = "" if name == "actions" else " and deleted_at is null"
    return f"""(select * from (select *, row_number() over (partition by {key} order by {order}) as _rn,
        min(loaded_at) over (partition by {key}) as first_at from {name} where {key} is not null) where _rn = 1{dead})"""


def ws(*xs: str) -> str:
    return f"concat_ws(' ', {', '.join(xs)})"


def aw(x: str) -> str:
    return f"array_to_string(list_filter(coalesce({x}, []), lambda z: z is not null), ' ')"


INTENT_TEXT = "trim(" + ws("coalesce(canonical_intent, '')", "array_to_string(list_transform(coalesce(constraints, []), lambda c: coalesce(c.slot, '') || ' ' || coalesce(c.value, '')), ' ')", "coalesce(domain_hint, '')") + ")"
STAGE_TEXT = "trim(" + ws("coalesce(name, '')", f"case when pre_conditions is null and post_conditions is null then '' else {aw('coalesce(pre_conditions, []) || coalesce(post_conditions, [])')} end", ws("stage_type", aw("completion_signals"), "transfer_rationale")) + ")"
DESCRIPTOR = ws(*[f"semantic_description.{f}" for f in memory.DESCRIPTOR], *[aw(f"semantic_description.{f}") for f in memory.DESCRIPTOR_LISTS])
ACTION_TEXT = f"trim({ws('coalesce(operation, chr(0)[1:0])', 'coalesce(argument_template, chr(0)[1:0])', DESCRIPTOR)})".replace("chr(0)[1:0]", "''")
NODES = f"""select 'intent' as record_type, intent_id as node_id, null::varchar as parent_id, {INTENT_TEXT} as text from {live('intents')}
union all select 'stage', stage_id, parent_intent_id, {STAGE_TEXT} from {live('stages')}
union all select 'action', action_id, parent_stage_id, {ACTION_TEXT} from {live('actions')}"""


FLAT = f"""with x as (select s.parent_intent_id as intent_id, count(*) as n,
              string_agg(concat_ws('|', coalesce(s.name, ''), coalesce(a.operation, ''), coalesce(a.argument_template, '')), '; '
                order by coalesce(s.span[1], 0), s.stage_id, coalesce(a.source.step_index, 0), a.action_id) as steps
            from {live('stages')} s join {live('actions')} a on a.parent_stage_id = s.stage_id group by 1)
            select 'workflow_' || i.intent_id as workflow_id, canonical_intent as instruction, coalesce(n, 0)::int as n_steps, coalesce(steps, '') as steps
            from {live('intents')} i left join x on x.intent_id = i.intent_id"""
_WORKFLOWS = f"""w as (select 'workflow_' || s.parent_intent_id as workflow_id, row_number() over (partition by s.parent_intent_id order by coalesce(s.span[1], 0), s.stage_id, coalesce(a.source.step_index, 0), a.action_id) - 1 as place,
  s.stage_id, s.name as stage, a.action_id, a.operation, a.argument_template from {live('stages')} s join {live('actions')} a on a.parent_stage_id = s.stage_id where s.parent_intent_id in (select intent_id from {live('intents')}))"""


def queries() -> dict:
    return {
        "id_upsert_last_wins": lambda s, d: memory.live(s, d, "intents").select("intent_id", "canonical_intent", "domain_hint", "batch_no", "first_at"),
        "record_union": memory.nodes,
        "tree_descent": memory.descend,
        "tree_flatten": memory.flatten_tree,
        "workflow_steps": memory.workflow_steps,
        "workflow_stages": lambda s, d: memory.from_workflows(memory.workflow_steps(s, d))[0],
        "cascade_delete": memory.cascade,
        "fifo_prune": memory.overflow,
        "index_manifest": memory.manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "id_upsert_last_wins": f"select intent_id, canonical_intent, domain_hint, batch_no, first_at from {live('intents')}",
        "record_union": NODES,
        "tree_descent": f"""select s.parent_intent_id as intent_id, count(*) as stages, sum(coalesce(n, 0))::bigint as actions
            from {live('stages')} s left join (select parent_stage_id, count(*) as n from {live('actions')} group by 1) a on a.parent_stage_id = s.stage_id
            where s.parent_intent_id in (select intent_id from {live('intents')}) group by 1""",
        "tree_flatten": FLAT,
        "workflow_steps": f"with {_WORKFLOWS} select * from w",
        "workflow_stages": f"""with {_WORKFLOWS} select workflow_id, stage_id, any_value(stage) as name, min(place) as start, max(place) as "end" from w group by 1, 2""",
        "cascade_delete": f"""with s as (select stage_id from {live('stages')} where parent_intent_id in (select intent_id from {live('intents')}))
            select 'intent' as level, count(*) as kept from {live('intents')} union all select 'stage', count(*) from s
            union all select 'action', count(*) from {live('actions')} where parent_stage_id in (select stage_id from s)""",
        "fifo_prune": f"""select domain, intent_id, place from (select coalesce(domain_hint, '') as domain, intent_id,
              row_number() over (partition by coalesce(domain_hint, '') order by first_at, intent_id) as place,
              (select count(*) from {live('intents')} j where coalesce(j.domain_hint, '') = coalesce(i.domain_hint, '')) as size
            from {live('intents')} i where coalesce(batch_no, 1) > 0) where place <= size - 50""",
        "index_manifest": f"""select record_type, count(*) as nodes, sum(('0x' || substr(sha1(concat_ws(chr(1), node_id, coalesce(parent_id, ''), text)), 1, 12))::bigint)::varchar as fingerprint
            from ({NODES}) group by 1""",
    }
