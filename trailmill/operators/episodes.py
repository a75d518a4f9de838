"""Steps of recorded tasks: evidence, stage kinds, boundaries, stages, their checks and repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import table
from . import memory

# fixed values: words that speak for a kind of stage, operations that do, weight
KINDS: dict[str, tuple[list[str], list[str], float]] = {
    "navigation": ("home menu section category subreddit repository classification open".split(), [], 1.0),
    "search_form": ("search find query from to date flight hotel".split(), [], 1.0),
    "filtering": ("filter sort brand price rating refine".split(), [], 1.0),
    "item_selection": ("select choose product item option configuration color size".split(), [], 0.8),
    "configuration": ("configure storage protection financing plan option".split(), [], 1.0),
    "checkout_or_confirmation": ("cart checkout continue confirm payment shipping".split(), [], 1.0),
    "content_reading": ("read answer classification section content list subreddit".split(), [], 0.8),
    "form_filling": ("field textbox input enter".split(), ["type", "input", "fill"], 1.0),
    "submission": ("submit apply go done save search".split(), [], 0.8),
    "answer_extraction": ("final answer done".split(), ["stop", "answer", "finish"], 1.0),
}
GENERIC = 0.5
TRANSITIONS = ("click->type", "click->select", "submit->click", "click->stop", "type->click")
MAX_STAGE, MAX_STAGES, LOW_CONFIDENCE = 6, 8, 0.35
ORDER = sorted([*KINDS, "generic"], reverse=True)  # a tie goes to the last name


def live_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each task by load time."""
    return memory.upsert(table(spark, sf_dir, "tasks"), "task_id", ["loaded_at", "instruction", "split", "source"])


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task_id, pos (from 0), and the fields of each step; label and role of the first positive candidate."""
    t = live_tasks(spark, sf_dir).select("task_id", F.posexplode("steps").alias("pos", "s"))
    first = F.get(F.col("s.pos_candidates"), F.lit(0))
    return t.select(
        "task_id", "pos", X.blank(F.col("s.operation")).alias("operation"), F.col("s.value").alias("argument"), F.col("s.url").alias("url"),
        F.col("s.action_repr").alias("action_repr"), X.collapse(first["text"]).alias("label"), X.normal_key(F.coalesce(first["role"], first["tag"])).alias("role"),
        F.col("s.pos_candidates").alias("pos_candidates"), F.col("s.neg_candidates").alias("neg_candidates"),
    )


def evidence(rows: DataFrame) -> DataFrame:
    """``rows`` of steps with op, tokens and one normalised score a kind of stage (k_...), and the leading kind."""
    rows = rows.withColumn("op", X.normal_key(F.col("operation")))
    text = F.concat_ws(" ", "operation", "label", "role", X.blank(F.col("argument")))
    rows = rows.withColumn("tokens", X.evidence_tokens(text))
    raw = {}
    for kind, (words, ops, weight) in KINDS.items():
        hit = F.arrays_overlap("tokens", F.array(*[F.lit(w) for w in words]))
        raw[kind] = F.when(hit | F.col("op").isin(*ops) if ops else hit, weight).otherwise(0.0)
    rows = rows.withColumns({f"r_{k}": c for k, c in raw.items()})
    total = sum((F.col(f"r_{k}") for k in list(KINDS)[1:]), F.col(f"r_{list(KINDS)[0]}"))
    rows = rows.withColumn("r_generic", F.when(total == 0, GENERIC).otherwise(0.0))
    total = total + F.col("r_generic")
    rows = rows.withColumns({f"k_{k}": F.round(F.col(f"r_{k}") / total, 9) for k in ORDER}).drop(*[f"r_{k}" for k in ORDER])
    return rows.withColumn("kind", leading("k_"))


def leading(prefix: str) -> Column:
    """The kind with the highest score; of equal ones the last by name."""
    top = F.greatest(*[F.col(f"{prefix}{k}") for k in ORDER])
    out = None
    for k in ORDER:
        out = F.when(F.col(f"{prefix}{k}") == top, k) if out is None else out.when(F.col(f"{prefix}{k}") == top, k)
    return out


def boundaries(rows: DataFrame, max_len: int = MAX_STAGE) -> DataFrame:
    """Evidence rows with distance to the step before, ``split``, ``boundary`` and ``stage`` (from 1).

    All windows share one partitioning by task, hence one shuffle.
    """
    w = W.partitionBy("task_id").orderBy("pos")
    before = lambda c: F.lag(c).over(w)
    rows = rows.withColumns({"p_tokens": before("tokens"), "p_kind": before("kind"), "p_op": before("op")})
    either = (F.size("tokens") == 0) | (F.size("p_tokens") == 0)
    lexical = F.when(either, 1.0).otherwise(1.0 - X.jaccard(F.col("tokens"), F.col("p_tokens")))
    distance = F.least(F.lit(1.0), 0.5 * lexical + F.when(F.col("kind") == F.col("p_kind"), 0.0).otherwise(0.35) + F.when(F.col("op") == F.col("p_op"), 0.0).otherwise(0.15))
    rows = rows.withColumn("distance", F.when(F.col("p_kind").isNotNull(), F.round(distance, 9)))
    move = F.concat(F.col("p_op"), F.lit("->"), F.col("op")).isin(*TRANSITIONS)
    split = ((F.col("kind") != F.col("p_kind")) & (F.col("distance") >= 0.35)) | (move & (F.col("distance") >= 0.25))
    rows = rows.withColumn("split", F.coalesce(split, F.lit(True)))
    last = F.max(F.when(F.col("split"), F.col("pos"))).over(w.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("boundary", F.pmod(F.col("pos") - last, F.lit(max_len)) == 0)
    return rows.withColumn("stage", F.sum(F.col("boundary").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("p_tokens", "p_kind", "p_op")


def _confidence(top: Column, n: Column, inner: Column) -> Column:
    """Confidence of ``n`` steps with the greatest sum of scores ``top`` and the sum of distances ``inner`` between them."""
    coherent = F.when(n == 1, 1.0).otherwise(1.0 - F.least(F.lit(1.0), inner / (n - 1)))
    value = 0.45 * top / n + 0.35 * coherent + 0.20 * F.least(F.lit(1.0), F.sqrt(n) / 2.5)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 6)


def _named(g: DataFrame) -> DataFrame:
    """``g`` with the name of each stage and the kinds of those before and after."""
    w = W.partitionBy("task_id").orderBy("stage")
    g = g.withColumns({"previous": F.lag("kind").over(w), "next": F.lead("kind").over(w)})
    kind = F.replace("kind", F.lit("_"), F.lit(" "))
    name = F.when(F.col("last_label").isNotNull(), F.concat(kind, F.lit(": "), F.substring("last_label", 1, 48))).otherwise(kind)
    return g.withColumn("name", X.collapse(name)).select("task_id", "stage", "start", "end", "kind", "name", "confidence", "previous", "next")


def stage_rows(rows: DataFrame) -> DataFrame:
    """One row a stage with what a merge needs: span, sums of scores, sum of inner distances, distance to the stage before."""
    sums = [F.round(F.sum(f"k_{k}"), 6).alias(f"s_{k}") for k in ORDER]
    inner = F.coalesce(F.sum(F.when(~F.col("boundary"), F.col("distance"))), F.lit(0.0)).alias("inner")
    edge = F.coalesce(F.max(F.when(F.col("boundary"), F.col("distance"))), F.lit(0.0)).alias("edge")
    label = F.max_by(F.when(F.col("label") != "", F.col("label")), F.when(F.col("label") != "", F.col("pos")))
    g = rows.groupBy("task_id", "stage").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.count("*").alias("n"), inner, edge, label.alias("last_label"), *sums)
    top = F.greatest(*[F.col(f"s_{k}") for k in ORDER])
    alone = F.sum("n").over(W.partitionBy("task_id")) == 1  # a task of one step
    return g.withColumns({"kind": leading("s_"), "confidence": F.when(alone, 0.8).otherwise(_confidence(top, F.col("n"), F.col("inner")))})


def stages(rows: DataFrame) -> DataFrame:
    """One row a stage: span, kind, name, confidence, and the kinds of the stages before and after."""
    return _named(stage_rows(rows))


def merge_low_confidence(rows: DataFrame, threshold: float = LOW_CONFIDENCE, most: int = MAX_STAGES) -> DataFrame:
    """Stages (``stage_rows``) in order, where one below ``threshold`` takes in the next; then the ``most``-th runs to the end of the task.

    A stage that was taken in takes in none itself, so in a run of weak ones
    every second is taken in, which windows tell without a fold.  Kind and
    confidence of two stages are those of their steps together, the latter no
    less than either had.  Later stages are covered by the last one kept.
    """
    w = W.partitionBy("task_id").orderBy("stage")
    weak = F.col("confidence") < threshold
    strong = F.max(F.when(~weak, F.col("stage"))).over(w.rowsBetween(W.unboundedPreceding, -1))  # the last strong one before
    x = rows.withColumn("taken", F.pmod(F.col("stage") - 1 - F.coalesce(strong, F.lit(0)), F.lit(2)) == 1)
    x = x.withColumn("head", F.col("stage") - F.col("taken").cast("int"))
    sums = [F.round(F.sum(f"s_{k}"), 6).alias(f"s_{k}") for k in ORDER]
    inner = F.sum("inner") + F.sum(F.when(F.col("taken"), F.col("edge")).otherwise(0.0))
    label = F.max_by("last_label", F.when(F.col("last_label").isNotNull(), F.col("stage")))
    g = x.groupBy("task_id", "head").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"), inner.alias("inner"), F.max("confidence").alias("own"), F.count("*").alias("two"), label.alias("last_label"), *sums)
    top = F.greatest(*[F.col(f"s_{k}") for k in ORDER])
    both = F.greatest("own", _confidence(top, F.col("n"), F.col("inner")))
    g = g.withColumns({"kind": leading("s_"), "confidence": F.when(F.col("two") > 1, both).otherwise(F.col("own"))})
    h = W.partitionBy("task_id")
    g = g.withColumn("stage", F.row_number().over(h.orderBy("head"))).withColumn("last", F.max("end").over(h)).where(F.col("stage") <= most)
    return _named(g.withColumn("end", F.when(F.col("stage") == most, F.col("last")).otherwise(F.col("end"))))


def repaired(spans: DataFrame, lengths: DataFrame) -> DataFrame:
    """Spans made to cover steps 0 .. n-1 without a gap: each starts behind the farthest end so far, the last runs to n-1.

    ``lengths``: task_id, n.  A span wholly behind what is covered becomes one step, and spans beyond the end are dropped.
    """
    w = W.partitionBy("task_id").orderBy("start", "stage")
    s = spans.join(lengths, "task_id").withColumn("_nth", F.row_number().over(w))
    # a span covers at least one step more than those before: end_i = max over j <= i of (end_j + i - j)
    reach = F.max(F.col("end") - F.col("_nth")).over(w.rowsBetween(W.unboundedPreceding, 0)) + F.col("_nth")
    reach = F.greatest(reach, F.col("_nth") - 1)
    s = s.withColumn("new_end", F.least(reach, F.col("n") - 1))
    s = s.withColumn("new_start", F.coalesce(F.lag("new_end").over(w) + 1, F.lit(0))).where(F.col("new_start") <= F.col("n") - 1)
    last = F.lead("stage").over(w).isNull()
    return s.select("task_id", "stage", F.col("new_start").cast("int").alias("start"), F.when(last, F.col("n") - 1).otherwise(F.col("new_end")).cast("int").alias("end"))


def span_check(spans: DataFrame, lengths: DataFrame) -> DataFrame:
    """task_id, contiguous, overlaps, covers: whether spans tile steps 0 .. n-1."""
    w = W.partitionBy("task_id").orderBy("start")
    s = spans.withColumn("p_end", F.lag("end").over(w))
    per = s.groupBy("task_id").agg(
        F.min(F.coalesce(F.col("start") == F.col("p_end") + 1, F.lit(True))).alias("contiguous"),
        F.max(F.coalesce(F.col("start") <= F.col("p_end"), F.lit(False))).alias("overlaps"),
        F.sum(F.col("end") - F.col("start") + 1).alias("covered"), F.min("start").alias("lo"), F.max("end").alias("hi"),
    )
    ok = (F.col("covered") == F.col("n")) & (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & ~F.col("overlaps")
    return per.join(lengths, "task_id").select("task_id", "contiguous", "overlaps", ok.alias("covers"))


def lengths(rows: DataFrame) -> DataFrame:
    return rows.groupBy("task_id").agg(F.count("*").cast("int").alias("n"))


def assigned(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Steps with the stage whose closed span holds them: an equi join on the task with a range residual."""
    s = spans.select("task_id", "stage", "start", "end")
    hit = (rows.task_id == s.task_id) & (F.col("pos") >= F.col("start")) & (F.col("pos") <= F.col("end"))
    return rows.join(s, hit, "left").drop(s.task_id)


def history(rows: DataFrame, n: int = 6) -> DataFrame:
    """The operations of the last ``n`` steps before each step, oldest first."""
    w = W.partitionBy("task_id").orderBy("pos")
    return rows.select("task_id", "pos", F.concat_ws(" ", F.collect_list("operation").over(w.rowsBetween(-n, -1)) if n else F.array().cast("array<string>")).alias("history"))


def neighbours(rows: DataFrame) -> DataFrame:
    """Sibling text (one step to each side), nearby text (two) and relative position of each step's label."""
    w = W.partitionBy("task_id").orderBy("pos")
    label = F.nullif(F.col("label"), F.lit(""))
    around = lambda *ks: F.concat_ws(" ", *[F.lag(label, -k).over(w) for k in ks])
    n = F.count("*").over(W.partitionBy("task_id"))
    return rows.select("task_id", "pos", around(-1, 1).alias("sibling_text"), around(-2, -1, 1, 2).alias("nearby_text"), F.format_string("element %d of %d", F.col("pos") + 1, n).alias("relative_position"))
