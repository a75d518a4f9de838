"""Queries of similarity search, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import memory, retrieval
from ..session import table
from . import sqltext as S
from .memory_queries import ACTION_TEXT, FLAT, INTENT_TEXT, STAGE_TEXT, live

TASKS = """(select task_id as query_id, coalesce(instruction, '') as text from (select *, row_number() over (partition by task_id
    order by loaded_at desc nulls last, instruction desc nulls last) as rn from tasks where task_id is not null)
    where rn = 1 and ('0x' || substr(task_id, 1, 6))::bigint % 20 = 0)"""


def _docs_topk(extra: str = "") -> str:
    return f"""with t as materialized (select doc_id, lang, {S.token_set('text')} as tokens from documents),
      s as (select q.doc_id as query_id, d.doc_id as id, round({S.set_cosine('q.tokens', 'd.tokens')}, 9) as score
            from t q, t d where q.doc_id % 20 = 0 {extra})
      select query_id, id, score, rank from (select *, row_number() over (partition by query_id order by score desc, id::varchar) as rank from s) where rank <= 5"""


_INTENTS = f"""q as materialized (select query_id, text, {S.token_set('text')} as tokens from {TASKS}),
  i as materialized (select intent_id, {S.token_set(INTENT_TEXT)} as tokens from {live('intents')}),
  hit as materialized (select * from (select query_id, intent_id as id, round({S.set_cosine('q.tokens', 'i.tokens')}, 9) as score,
     row_number() over (partition by query_id order by round({S.set_cosine('q.tokens', 'i.tokens')}, 9) desc, intent_id) as rank from q, i) where rank <= 5)"""


def _conditions(src: str) -> str:
    """Decision and score of rows with pre_conditions, post_conditions, text and tokens."""
    mx = lambda xs: f"coalesce(list_max(list_transform(coalesce({xs}, []), lambda c: {S.jaccard(S.token_set('c'), 'tokens', 1.0)})), 0.0)"
    every = "(coalesce(pre_conditions, []) || coalesce(post_conditions, []))"
    conflict = f"coalesce(list_max(list_transform({every}, lambda c: {S.contradiction('c', 'text', S.token_set('c'), 'tokens')})), 0.0)"
    return f"""(select *, case decision when 'already_completed' then post_score when 'satisfied' then pre_score when 'partial' then pre_score else 0.0 end as condition_score
      from (select *, case when conflict_score >= 0.10 then 'conflict' when post_score >= 0.25 and len(coalesce(post_conditions, [])) > 0 then 'already_completed'
        when pre_score >= 0.20 and len(coalesce(pre_conditions, [])) > 0 then 'satisfied' when pre_score > 0 then 'partial' else 'low_confidence' end as decision
      from (select *, {mx('pre_conditions')} as pre_score, {mx('post_conditions')} as post_score, {conflict} as conflict_score from {src})))"""


_STAGES = f"""{_INTENTS}, st as (select h.query_id, s.stage_id as id, s.pre_conditions, s.post_conditions, q.text, q.tokens,
     {S.set_cosine('q.tokens', 's.tokens')} as lexical from hit h join (select *, {S.token_set(STAGE_TEXT)} as tokens from {live('stages')}) s on s.parent_intent_id = h.id
     join q on q.query_id = h.query_id),
  sc as materialized (select query_id, id, decision, round(case decision when 'conflict' then -1.0 when 'already_completed' then 0.1 * lexical else 0.7 * lexical + 0.3 * condition_score end, 9) as score
     from {_conditions('st')}),
  top as materialized (select * from (select *, row_number() over (partition by query_id order by score desc, id) as rank from sc) where rank <= 8)"""

_HIER = f"""{_STAGES}, g as materialized (select query_id, id, decision, score, round(score - lead(score, 1, 0.0) over (partition by query_id order by rank), 9) as margin,
     row_number() over (partition by query_id order by rank) as place from top where score >= 0),
  ch as (select * from g where place = 1),
  ac as (select ch.*, a.action_id, a.operation, round({S.set_cosine('q.tokens', 'coalesce(a.tokens, [])')}, 9) as ascore from ch join q on q.query_id = ch.query_id
     left join (select *, {S.token_set(ACTION_TEXT)} as tokens from {live('actions')}) a on a.parent_stage_id = ch.id),
  f as (select *, row_number() over (partition by query_id order by ascore desc, coalesce(action_id, '')) as rn from ac)"""

_BUCKETS = "list_transform({t}, lambda t: ('0x' || substr(sha1(t), 1, 8))::bigint % 256)"
_COUNTS = "list_transform(range(0, 256), lambda b: len(list_filter({b}, lambda x: x = b))::double)"
_PHASE = f"""q0 as materialized (select query_id, {S.token_set('text')} as t from {TASKS}), i0 as materialized (select intent_id as id, {S.token_set(INTENT_TEXT)} as t from {live('intents')}),
  q as materialized (select query_id, t, {_COUNTS.replace('{b}', 'h')} as v from (select *, {_BUCKETS.replace('{t}', 't')} as h from q0)),
  i as materialized (select id, t, {_COUNTS.replace('{b}', 'h')} as v from (select *, {_BUCKETS.replace('{t}', 't')} as h from i0)),
  d as (select query_id, id, case when len(q.t) * len(i.t) = 0 then 0.0 else list_cosine_similarity(q.v, i.v) end as dense, {S.jaccard('q.t', 'i.t')} as lex, {S.jaccard('q.t', 'i.t', 1.0)} as over from q, i),
  f as materialized (select * from (select query_id, id, round({{first}}, 9) as score, lex, over, row_number() over (partition by query_id order by round({{first}}, 9) desc, id) as rn from d) where rn <= 20),
  r as (select query_id, id, score, round(lex, 9) as lexical, round(over, 9) as rerank from f)"""
_GATED = f"with {_HIER} select query_id, id, score, (score < 0.15 or margin < 0.1) as low from ch"
_COS = "list_cosine_similarity({a}::double[], {b}::double[])"


def condition_status(spark, d):  # noqa: ANN001, ANN201
    """Decision of each live stage on the text of its parent intent."""
    s = memory.live(spark, d, "stages").select("stage_id", "parent_intent_id", "pre_conditions", "post_conditions", "name", "transfer_rationale")
    i = memory.live(spark, d, "intents").select(F.col("intent_id").alias("parent_intent_id"), "canonical_intent")
    rows = s.join(i, "parent_intent_id")
    obs = F.concat_ws(" ", X.blank(F.col("canonical_intent")), X.blank(F.col("name")))
    out = retrieval.conditions(rows.withColumn("text", obs), F.col("pre_conditions"), F.col("post_conditions"), F.col("text"))
    r = lambda c: F.round(c, 9).alias(c)
    return out.select("stage_id", "decision", r("pre_score"), r("post_score"), r("conflict_score"), r("condition_score"))


def queries() -> dict:
    docs = lambda s, d: retrieval.doc_tokens(s, d)

    def lexical(s, d, filtered=False):  # noqa: ANN001, ANN202
        t = docs(s, d) if filtered else docs(s, d).drop("allow")
        return retrieval.lexical_topk(t.where(F.col("id") % 20 == 0).withColumnRenamed("id", "query_id"), t)

    def dense(s, d, same=False):  # noqa: ANN001, ANN202
        e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
        return retrieval.dense_topk(e.where(F.col("id") % 20 == 0).withColumnRenamed("id", "query_id"), e, same_label=same)

    return {
        "token_vocabulary": lambda s, d: docs(s, d).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df")),
        "lexical_topk": lexical,
        "lexical_topk_filtered": lambda s, d: lexical(s, d, True),
        "dense_topk": dense,
        "dense_topk_filtered": lambda s, d: dense(s, d, True),
        "two_phase_topk": retrieval.two_phase,
        "blended_topk": retrieval.blended,
        "all_actions_topk": retrieval.all_actions_topk,
        "l2_normalize": lambda s, d: table(s, d, "embeddings").select("vec_id", F.transform(retrieval.l2_normalize(F.col("embedding")), lambda x: F.round(x, 6)).alias("v")),
        "hash_encode": lambda s, d: docs(s, d).select("id", F.explode(retrieval.hash_encode(F.col("tokens"))).alias("e")).select("id", "e.bucket", "e.n"),
        "intent_topk": retrieval.intents_topk,
        "condition_status": condition_status,
        "condition_rescore_topk": retrieval.stages_topk,
        "low_confidence_gate": lambda s, d: retrieval.gate(retrieval.stages_topk(s, d), ["query_id"]).select("query_id", "id", "margin", "low_confidence"),
        "hierarchical_retrieval": retrieval.hierarchical,
        "flat_retrieval": flat,
        "workflow_topk": retrieval.workflows_topk,
        "confident_stage": retrieval.confident,
    }


def flat(s, d):  # noqa: ANN001, ANN201
    """Baseline: top 5 over all nodes of all levels, without the hierarchy."""
    q = retrieval.query_tasks(s, d).select("query_id", X.token_set(F.col("text")).alias("tokens"))
    n = memory.nodes(s, d).select(F.concat_ws(":", "record_type", "node_id").alias("id"), X.token_set(F.col("text")).alias("tokens"))
    return retrieval.lexical_topk(q, n)


def oracle_sql() -> dict[str, str]:
    dense = lambda extra: f"""select query_id, id, score, rank from (select q.vec_id as query_id, e.vec_id as id, round({_COS.format(a='q.embedding', b='e.embedding')}, 9) as score,
        row_number() over (partition by q.vec_id order by round({_COS.format(a='q.embedding', b='e.embedding')}, 9) desc, e.vec_id::varchar) as rank
        from embeddings q, embeddings e where q.vec_id % 20 = 0 {extra}) where rank <= 5"""  # noqa: E731
    from .memory_queries import NODES

    return {
        "token_vocabulary": f"select token, count(*) as df from (select unnest({S.token_set('text')}) as token from documents) group by 1",
        "lexical_topk": _docs_topk(),
        "lexical_topk_filtered": _docs_topk("and q.lang = d.lang"),
        "dense_topk": dense(""),
        "dense_topk_filtered": dense("and q.label = e.label"),
        "two_phase_topk": f"""with {_PHASE.replace('{first}', 'dense')}
          select query_id, id, case when rerank = 0 then score else rerank end as score, rank from (select *, row_number() over (partition by query_id order by rerank desc, id) as rank from r) where rank <= 5""",
        "blended_topk": f"""with {_PHASE.replace('{first}', '0.82 * dense + 0.18 * lex')},
          k as (select * from (select *, row_number() over (partition by query_id order by rerank desc, id) as n from r) where n <= 5),
          b as (select query_id, id, lexical, rerank, round(case when rerank = 0 then score else 0.65 * rerank + 0.35 * score end, 6) as score from k)
          select *, row_number() over (partition by query_id order by score desc, id) as rank from b""",
        "all_actions_topk": f"""with q as materialized (select query_id, {S.token_set('text')} as tokens from {TASKS}),
            n as materialized (select action_id as id, {S.token_set(ACTION_TEXT)} as tokens from {live('actions')})
          select * from (select query_id, id, round({S.set_cosine('q.tokens', 'n.tokens')}, 9) as score,
            row_number() over (partition by query_id order by round({S.set_cosine('q.tokens', 'n.tokens')}, 9) desc, id) as rank from q, n) where rank <= 5""",
        "l2_normalize": "select vec_id, list_transform(embedding, lambda x: round(x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double))), 6)) as v from embeddings",
        "hash_encode": f"""select id, bucket::int as bucket, count(*)::int as n from (select doc_id as id, ('0x' || substr(sha1(unnest({S.token_set('text')})), 1, 8))::bigint % 256 as bucket from documents) group by 1, 2""",
        "intent_topk": f"with {_INTENTS} select * from hit",
        "condition_status": f"""select stage_id, decision, round(pre_score, 9) as pre_score, round(post_score, 9) as post_score, round(conflict_score, 9) as conflict_score, round(condition_score, 9) as condition_score
          from {_conditions(f"(select *, {S.token_set('text')} as tokens from (select stage_id, pre_conditions, post_conditions, concat_ws(' ', coalesce(canonical_intent, ''), coalesce(s.name, '')) as text from {live('stages')} s join {live('intents')} i on i.intent_id = s.parent_intent_id))")}""",
        "condition_rescore_topk": f"with {_STAGES} select query_id, id, decision, score, rank from top",
        "low_confidence_gate": f"with {_HIER} select query_id, id, margin, (score < 0.15 or margin < 0.1) as low_confidence from ch",
        "hierarchical_retrieval": f"""with {_HIER} select query_id, id as stage_id, decision as stage_decision, round(greatest(0.0, least(1.0, score)), 6) as confidence,
            (score < 0.15 or margin < 0.1) as low_confidence, action_id, operation from f where rn = 1""",
        "workflow_topk": f"""with q as materialized (select query_id, {S.token_set('text')} as tokens from {TASKS}),
            n as materialized (select workflow_id as id, {S.token_set("concat_ws(' ', coalesce(instruction, ''), steps)")} as tokens from ({FLAT}))
          select * from (select query_id, id, round({S.set_cosine('q.tokens', 'n.tokens')}, 9) as score,
            row_number() over (partition by query_id order by round({S.set_cosine('q.tokens', 'n.tokens')}, 9) desc, id) as rank from q, n) where rank <= 5""",
        "confident_stage": f"""with a as ({_GATED}), b as ({_GATED.replace('where rank <= 5)', 'where rank <= 10)', 1)}), j as (select coalesce(a.query_id, b.query_id) as query_id, a.id as ia, b.id as ib, a.score as sa, b.score as sb, a.low as la, b.low as lb from a full join b on b.query_id = a.query_id)
          select query_id, case when not la then ia when not lb then ib end as id, round(case when not la then greatest(0.0, least(1.0, sa)) when not lb then greatest(0.0, least(1.0, sb)) else 0.0 end, 6) as confidence,
            case when not la then 'first' when not lb then 'expanded' else 'base_policy' end as source from j""",
        "flat_retrieval": f"""with q as materialized (select query_id, {S.token_set('text')} as tokens from {TASKS}),
            n as materialized (select record_type || ':' || node_id as id, {S.token_set('text')} as tokens from ({NODES}))
          select * from (select query_id, id, round({S.set_cosine('q.tokens', 'n.tokens')}, 9) as score,
            row_number() over (partition by query_id order by round({S.set_cosine('q.tokens', 'n.tokens')}, 9) desc, id) as rank from q, n) where rank <= 5""",
    }
