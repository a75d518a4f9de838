"""Similarity search over memory nodes: lexical, dense, blended, two-phase, hierarchical, with condition re-scoring.

Queries are a stated set (a twentieth of the rows); all rows are searched.
Items are cut into parts and queries into blocks, and each part meets each
block once in a task of its own (``block_topk``): tokens and vectors are read
once, nothing comes to the driver, a task holds one part and one block, and
only the best ``k`` of a part a query are shuffled on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions import text as X
from ..session import cut, spread, table
from . import memory

PART_ROWS, QUERY_BLOCK = 20_000, 10_000
CELLS = 1 << 22  # scores held at once
NONE = -(1 << 62)


def ranked(scored: DataFrame, k: int, by: list[str], score: str = "score", item: str = "id") -> DataFrame:
    """The ``k`` best a query by (-score, id as text), with ``rank`` from 1."""
    w = W.partitionBy(*by).orderBy(F.desc(score), F.col(item).cast("string"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def block_topk(queries: DataFrame, items: DataFrame, k: int, col: str, scorer: Callable, allow: str | None = None) -> DataFrame:
    """query_id, id, score, rank: the ``k`` best items a query by (-score, id as text), scores rounded to 9 places.

    ``scorer(items, queries)`` takes the Arrow columns ``col`` of a part and a
    block and returns ``score(from, to)``, the scores of some items (rows) for
    all queries (columns).  With ``allow`` a query gets items of its value
    only; null matches nothing.
    """
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    out = f"query_id {kind(queries, 'query_id')}, id {kind(items, 'id')}, score double"
    extra = [F.col(allow).cast("string").alias("_allow")] if allow else []
    items, queries = cut(items.select("id", col, *extra)), cut(queries.select("query_id", F.col(col), *extra))
    cores = items.sparkSession.sparkContext.defaultParallelism
    n, m = items.count(), queries.count()
    parts = max(1, -(-n // PART_ROWS), min(cores, n // 500))
    blocks = max(1, -(-m // QUERY_BLOCK))
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = items.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("_block", each(blocks) if blocks > 1 else F.lit(0))
    # names of their own, as both sides may come from one table
    right = queries.withColumnsRenamed({col: "_q", "_allow": "_may"}).withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("_part", each(parts) if parts > 1 else F.lit(0))

    def run(x: pa.Table, q: pa.Table) -> pa.Table:
        none = pa.table({"query_id": q["query_id"].slice(0, 0), "id": x["id"].slice(0, 0), "score": pa.array([], pa.float64())})
        if not x.num_rows or not q.num_rows:
            return none
        names = np.array([str(i) for i in x["id"].to_pylist()])
        x = x.take(pa.array(np.argsort(names, kind="stable")))
        score = scorer(x[col].combine_chunks(), q["_q"].combine_chunks())
        own = lambda c: np.array(["" if v is None else "=" + v for v in c.to_pylist()])
        mine, theirs = (own(x["_allow"]), own(q["_may"])) if allow else (None, None)
        step = max(1, CELLS // q.num_rows)
        ids, best = [], []
        for at in range(0, x.num_rows, step):
            s = np.rint(score(at, min(x.num_rows, at + step)) * 1e9).astype(np.int64)
            rows = len(s)
            # one number a cell: higher scores first, then the earlier id
            key = s * (1 << 23) + (rows - 1 - np.arange(rows))[:, None]
            if allow:
                may = (mine[at : at + rows, None] == theirs[None, :]) & (theirs != "")[None, :]
                key[~may] = NONE
            top = np.argpartition(-key, min(k, rows) - 1, axis=0)[: min(k, rows)] if rows > k else np.tile(np.arange(rows)[:, None], (1, q.num_rows))
            kept = np.take_along_axis(key, top, 0)
            ids.append(np.where(kept > NONE, top + at, -1))
            best.append(np.take_along_axis(s, top, 0))
        ids, best = np.concatenate(ids), np.concatenate(best)
        key = np.where(ids >= 0, best, NONE)
        order = np.lexsort((ids, -key), axis=0)[:k]
        ids, best = np.take_along_axis(ids, order, 0), np.take_along_axis(best, order, 0)
        ok = ids >= 0
        who = np.broadcast_to(np.arange(q.num_rows), ids.shape)[ok]
        return pa.table({"query_id": q["query_id"].take(pa.array(who)), "id": x["id"].take(pa.array(ids[ok])), "score": pa.array(best[ok] / 1e9)})

    by = ["_part", "_block"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, out)
    return ranked(found, k, ["query_id"])


def _offsets(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and flat values of a list column; null as empty."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lengths, column.flatten().to_numpy(zero_copy_only=False)


def set_cosines(items: pa.ListArray, queries: pa.ListArray) -> Callable[[int, int], np.ndarray]:
    """Cosines of sets of token hashes, by the queries' inverted index; an empty set scores 0."""
    n_i, t_i = _offsets(items)
    n_q, t_q = _offsets(queries)
    vocabulary, number = np.unique(t_q, return_inverse=True)
    order = np.argsort(number, kind="stable")
    posting = np.repeat(np.arange(len(n_q)), n_q)[order]
    first = np.searchsorted(number[order], np.arange(len(vocabulary) + 1))
    start = np.concatenate([[0], np.cumsum(n_i)])
    norms = np.sqrt(np.maximum(n_q, 1).astype(np.float64))

    def score(a: int, b: int) -> np.ndarray:
        tokens, row = t_i[start[a] : start[b]], np.repeat(np.arange(b - a), n_i[a:b])
        at = np.searchsorted(vocabulary, tokens)
        hit = at < len(vocabulary)
        hit[hit] = vocabulary[at[hit]] == tokens[hit]
        at, row = at[hit], row[hit]
        count = first[at + 1] - first[at]
        # the queries of every token met, as one flat list of cells
        skip = np.repeat(np.cumsum(count) - count, count)
        cells = np.repeat(row * len(n_q), count) + posting[np.arange(count.sum()) - skip + np.repeat(first[at], count)]
        shared = np.bincount(cells, minlength=(b - a) * len(n_q)).reshape(b - a, len(n_q))
        return shared / norms / np.sqrt(np.maximum(n_i[a:b], 1))[:, None]

    return score


def vector_cosines(items: pa.ListArray, queries: pa.ListArray) -> Callable[[int, int], np.ndarray]:
    """Cosines of vectors in double precision, over the places that both have; null and zero vectors score 0."""

    def unit(column: pa.ListArray) -> np.ndarray:
        n, flat = _offsets(column)
        out = np.zeros((len(n), max(1, int(n.max(initial=1)))))
        out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)

    x, q = unit(items), unit(queries)
    width = min(x.shape[1], q.shape[1])
    return lambda a, b: x[a:b, :width] @ q[:, :width].T


def hashed(tokens: Column) -> Column:
    """Token sets as 64-bit hashes, for ``set_cosines``."""
    return F.transform(tokens, lambda t: F.xxhash64(t))


def lexical_topk(queries: DataFrame, items: DataFrame, k: int = 5) -> DataFrame:
    """query_id, id, score, rank by set cosine of token sets.

    ``queries``: query_id, tokens; ``items``: id, tokens, and optionally
    ``allow`` on both, which restricts a query to the items of its value (null
    matches nothing).  Items with score 0 fill up the places, by id as text.
    Empty token sets score 0 with everything.
    """
    allow = "allow" if "allow" in items.columns and "allow" in queries.columns else None
    short = lambda df: df.withColumn("tokens", hashed(F.col("tokens")))
    return block_topk(short(queries), short(items), k, "tokens", set_cosines, allow)


def dense_topk(queries: DataFrame, items: DataFrame, k: int = 5, same_label: bool = False) -> DataFrame:
    """query_id, id, score, rank by cosine of vectors (in double precision); null and zero vectors score 0."""
    return block_topk(queries, items, k, "vector", vector_cosines, "label" if same_label else None)


def two_phase_topk(queries: DataFrame, items: DataFrame, k: int = 5, encode: Callable | None = None, rerank: Callable | None = None) -> DataFrame:
    """query_id, id, score, rank: the ``4 * k`` best by vectors, re-ranked; the rerank score counts, the vector's where it is 0.

    ``queries``: query_id, text; ``items``: id, text.  Plug-ins: ``encode``
    (text column to a vector column) and ``rerank`` (query text and item text
    columns to a score column), such as pandas functions that call a model.
    Without them hashed token counts and the overlap of token sets stand in.
    """
    encode, rerank = encode or hash_vector, rerank or overlap_rerank
    vector = lambda df, key: df.select(key, encode(F.col("text")).alias("vector"))
    first = dense_topk(vector(queries, "query_id"), vector(items, "id"), 4 * k).drop("rank")
    rows = first.join(queries.select("query_id", F.col("text").alias("_q")), "query_id").join(items.select("id", F.col("text").alias("_t")), "id")
    rows = rows.withColumn("rerank", F.round(rerank(F.col("_q"), F.col("_t")), 9))
    # only the k best by the rerank score stay, with the score that counts
    w = W.partitionBy("query_id").orderBy(F.desc("rerank"), F.col("id").cast("string"))
    rows = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return rows.select("query_id", "id", F.when(F.col("rerank") == 0, F.col("score")).otherwise(F.col("rerank")).alias("score"), "rank")


def blended_topk(queries: DataFrame, items: DataFrame, k: int = 5, encode: Callable | None = None, rerank: Callable | None = None) -> DataFrame:
    """query_id, id, semantic, lexical, score, rank of the index: 0.82 vector + 0.18 token overlap, the ``4 * k`` best re-ranked and blended 0.65 to 0.35.

    Arguments as for ``two_phase_topk``.  The blend of the first phase needs
    both scores of every item, so vectors and token hashes travel together.
    """
    encode, rerank = encode or hash_vector, rerank or overlap_rerank
    both = lambda df, key: df.select(key, F.struct(encode(F.col("text")).alias("v"), hashed(X.token_set(F.col("text"))).alias("t")).alias("both"))
    first = block_topk(both(queries, "query_id"), both(items, "id"), 4 * k, "both", blends).drop("rank")
    rows = first.join(queries.select("query_id", F.col("text").alias("_q")), "query_id").join(items.select("id", F.col("text").alias("_t")), "id")
    lexical = F.round(X.jaccard(X.token_set(F.col("_q")), X.token_set(F.col("_t"))), 9)
    rows = rows.withColumns({"lexical": lexical, "rerank": F.round(rerank(F.col("_q"), F.col("_t")), 9)})
    w = W.partitionBy("query_id").orderBy(F.desc("rerank"), F.col("id").cast("string"))
    rows = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)
    score = F.when(F.col("rerank") == 0, F.col("score")).otherwise(0.65 * F.col("rerank") + 0.35 * F.col("score"))
    return ranked(rows.select("query_id", "id", "lexical", "rerank", F.round(score, 6).alias("score")), k, ["query_id"])


def blends(items: pa.StructArray, queries: pa.StructArray) -> Callable[[int, int], np.ndarray]:
    """0.82 cosine of vectors + 0.18 Jaccard of token sets, 0 where one is empty."""
    dense = vector_cosines(items.field("v"), queries.field("v"))
    cosine = set_cosines(items.field("t"), queries.field("t"))
    n_i, n_q = _offsets(items.field("t"))[0], _offsets(queries.field("t"))[0]

    def score(a: int, b: int) -> np.ndarray:
        size = n_i[a:b, None] + n_q[None, :]
        shared = np.rint(cosine(a, b) * np.sqrt(np.maximum(n_i[a:b, None], 1) * np.maximum(n_q[None, :], 1)))
        return 0.82 * dense(a, b) + 0.18 * shared / np.maximum(1, size - shared)

    return score


@F.pandas_udf(ArrayType(DoubleType()))
def _counted(buckets: pd.Series, dim: pd.Series) -> pd.Series:
    return pd.Series([np.bincount(np.asarray(b, np.int64), minlength=n).astype(np.float64) for b, n in zip(buckets, dim, strict=True)])


def hash_vector(text: Column, dim: int = 256) -> Column:
    """The stand-in encoder: a vector of token counts by hash bucket."""
    buckets = F.transform(X.token_set(text), lambda t: (F.conv(F.substring(F.sha1(t), 1, 8), 16, 10).cast("bigint") % dim).cast("int"))
    return _counted(buckets, F.lit(dim))


def overlap_rerank(query: Column, text: Column) -> Column:
    """The stand-in reranker: overlap of token sets."""
    return X.overlap(X.token_set(query), X.token_set(text))


def l2_normalize(v: Column) -> Column:
    """A vector of length 1; a zero vector stays."""
    x = F.transform(v, lambda a: a.cast("double"))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, a: s + a * a))
    return F.when(norm == 0, x).otherwise(F.transform(x, lambda a: a / norm))


def hash_encode(tokens: Column, dim: int = 256) -> Column:
    """Counts of tokens by a stable hash bucket, as a map from bucket to count."""
    bucket = F.transform(tokens, lambda t: (F.conv(F.substring(F.sha1(t), 1, 8), 16, 10).cast("bigint") % dim).cast("int"))
    keys = F.array_sort(F.array_distinct(bucket))
    return F.transform(keys, lambda b: F.struct(b.alias("bucket"), F.size(F.filter(bucket, lambda x: x == b)).alias("n")))


def conditions(rows: DataFrame, pre: Column, post: Column, observation: Column, theta_pre: float = 0.20, theta_done: float = 0.25, theta_conflict: float = 0.10) -> DataFrame:
    """``rows`` with pre_score, post_score, conflict_score, decision and condition_score of a stage on an observation."""
    none = F.array().cast("array<string>")
    # texts and token sets once a condition and row, as columns, before they are compared
    parsed = lambda arr: F.transform(F.coalesce(arr, none), lambda c: F.struct(X.plain_text(c).alias("text"), X.token_set(c).alias("tokens")))
    rows = rows.withColumns({"_pre": parsed(pre), "_post": parsed(post), "_seen": X.token_set(observation), "_obs": X.plain_text(observation)})
    score = lambda c: F.coalesce(F.array_max(F.transform(c, lambda x: X.overlap(x["tokens"], F.col("_seen")))), F.lit(0.0))
    against = F.transform(F.concat("_pre", "_post"), lambda x: X.contradiction(x["text"], F.col("_obs"), x["tokens"], F.col("_seen")))
    rows = rows.withColumns({"pre_score": score("_pre"), "post_score": score("_post"), "conflict_score": F.coalesce(F.array_max(against), F.lit(0.0))})
    decision = (
        F.when(F.col("conflict_score") >= theta_conflict, "conflict")
        .when((F.col("post_score") >= theta_done) & (F.size(F.coalesce(post, none)) > 0), "already_completed")
        .when((F.col("pre_score") >= theta_pre) & (F.size(F.coalesce(pre, none)) > 0), "satisfied")
        .when(F.col("pre_score") > 0, "partial")
        .otherwise("low_confidence")
    )
    rows = rows.withColumn("decision", decision)
    value = F.when(F.col("decision") == "already_completed", F.col("post_score")).when(F.col("decision").isin("satisfied", "partial"), F.col("pre_score")).otherwise(0.0)
    return rows.withColumn("condition_score", value).drop("_pre", "_post", "_seen", "_obs")


def rescored(score: Column, weight: float = 0.3) -> Column:
    """Retrieval score blended with the condition's: conflicts leave, completed stages fall back."""
    return F.when(F.col("decision") == "conflict", -1.0).when(F.col("decision") == "already_completed", 0.1 * score).otherwise((1 - weight) * score + weight * F.col("condition_score"))


def gate(ranked: DataFrame, by: list[str], tau: float = 0.15, delta: float = 0.10) -> DataFrame:
    """The first hit a query that is no conflict, with confidence, margin and low_confidence."""
    w = W.partitionBy(*by).orderBy("rank")
    ok = ranked.where(F.col("score") >= 0)
    ok = ok.withColumn("margin", F.round(F.col("score") - F.lead("score", 1, 0.0).over(w), 9)).withColumn("place", F.row_number().over(w))
    out = ok.where(F.col("place") == 1)
    return out.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))).withColumn("low_confidence", (F.col("score") < tau) | (F.col("margin") < delta))


# --- over the tables --------------------------------------------------------------
def query_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, text: the live tasks whose id, read as a number, is divisible by 20."""
    t = memory.upsert(table(spark, sf_dir, "tasks").select("task_id", "instruction", "loaded_at"), "task_id", ["loaded_at", "instruction"])
    number = F.conv(F.substring("task_id", 1, 6), 16, 10).cast("bigint")
    return t.where(number % 20 == 0).select(F.col("task_id").alias("query_id"), X.blank(F.col("instruction")).alias("text"))


def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return d.select(F.col("doc_id").alias("id"), F.col("lang").alias("allow"), X.token_set(F.col("text")).alias("tokens"))


def intents_topk(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """Top intents of every query task."""
    q = query_tasks(spark, sf_dir).select("query_id", X.token_set(F.col("text")).alias("tokens"))
    i = memory.live(spark, sf_dir, "intents").select(F.col("intent_id").alias("id"), X.token_set(memory.intent_text()).alias("tokens"))
    return lexical_topk(q, i, k)


def stages_topk(spark: SparkSession, sf_dir: str, k: int = 8, intents: int = 5) -> DataFrame:
    """Stages below the top ``intents`` of a query, scored, re-scored on the query's text, best ``k``."""
    hits = cut(intents_topk(spark, sf_dir, intents))
    q = query_tasks(spark, sf_dir)
    s = memory.live(spark, sf_dir, "stages").select("stage_id", F.col("parent_intent_id").alias("id"), "pre_conditions", "post_conditions", memory.stage_text().alias("stage"))
    rows = hits.select("query_id", "id").join(s, "id").join(q, "query_id")
    rows = rows.withColumns({"_q": X.token_set(F.col("text")), "_s": X.token_set(F.col("stage"))})
    rows = conditions(rows.withColumn("lexical", X.set_cosine(F.col("_q"), F.col("_s"))), F.col("pre_conditions"), F.col("post_conditions"), F.col("text"))
    rows = rows.select("query_id", F.col("stage_id").alias("id"), "decision", F.round(rescored(F.col("lexical")), 9).alias("score"))
    return ranked(rows, k, ["query_id"])


def hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: query -> top intents -> their stages, condition-aware -> gate -> best action of the stage.

    Joins follow the foreign keys, so only children of hit parents are scored.
    """
    chosen = cut(gate(stages_topk(spark, sf_dir), ["query_id"]))
    q = query_tasks(spark, sf_dir)
    a = memory.live(spark, sf_dir, "actions").select(F.col("parent_stage_id").alias("id"), "action_id", "operation", memory.action_text().alias("action"))
    rows = chosen.select("query_id", "id", F.col("decision").alias("stage_decision"), F.round("confidence", 6).alias("confidence"), "low_confidence").join(a, "id", "left").join(q, "query_id")
    rows = rows.withColumns({"_q": X.token_set(F.col("text")), "_a": X.token_set(F.col("action"))})
    rows = rows.withColumn("score", F.round(X.set_cosine(F.col("_q"), F.col("_a")), 9))
    first = ranked(rows.withColumn("aid", X.blank(F.col("action_id"))), 1, ["query_id"], item="aid")
    return first.select("query_id", F.col("id").alias("stage_id"), "stage_decision", "confidence", "low_confidence", "action_id", "operation")


def intent_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and text of the live intents."""
    return memory.live(spark, sf_dir, "intents").select(F.col("intent_id").alias("id"), memory.intent_text().alias("text"))


def two_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-phase search of intents for every query task, with the stand-ins for models."""
    return two_phase_topk(query_tasks(spark, sf_dir), intent_texts(spark, sf_dir))


def blended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blended search of intents for every query task, with the stand-ins for models."""
    return blended_topk(query_tasks(spark, sf_dir), intent_texts(spark, sf_dir))


def all_actions_topk(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """Top actions of every query task over all stages."""
    q = query_tasks(spark, sf_dir).select("query_id", X.token_set(F.col("text")).alias("tokens"))
    a = memory.live(spark, sf_dir, "actions").select(F.col("action_id").alias("id"), X.token_set(memory.action_text()).alias("tokens"))
    return lexical_topk(q, a, k)


def workflows_topk(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """Baseline: top workflows of every query task by the text of goal and steps, without the hierarchy."""
    q = query_tasks(spark, sf_dir).select("query_id", X.token_set(F.col("text")).alias("tokens"))
    w = memory.flatten_tree(spark, sf_dir).select(F.col("workflow_id").alias("id"), X.token_set(F.concat_ws(" ", X.blank(F.col("instruction")), "steps")).alias("tokens"))
    return lexical_topk(q, w, k)


def selected(first: DataFrame, expanded: DataFrame, key: str = "query_id") -> DataFrame:
    """``key``, id, confidence and source of ``gate``d hits: the first unless it is of low confidence, then the expanded one, else none (the base policy decides).

    A key in neither has no row; one with low confidence in both has a null id.
    """
    of = lambda df, n: df.select(key, F.when(~F.col("low_confidence"), F.col("id")).alias(f"id_{n}"), F.col("confidence").alias(f"c_{n}"))
    x = of(first, "first").join(of(expanded, "more"), key, "full")
    source = F.when(F.col("id_first").isNotNull(), "first").when(F.col("id_more").isNotNull(), "expanded").otherwise("base_policy")
    confidence = F.when(F.col("id_first").isNotNull(), F.col("c_first")).when(F.col("id_more").isNotNull(), F.col("c_more")).otherwise(0.0)
    return x.select(key, F.coalesce("id_first", "id_more").alias("id"), F.round(confidence, 6).alias("confidence"), source.alias("source"))


def confident(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stage of every query task below its top 5 intents, if that is of low confidence below its top 10, else left to the base policy."""
    return selected(gate(stages_topk(spark, sf_dir), ["query_id"]), gate(stages_topk(spark, sf_dir, intents=10), ["query_id"]))
