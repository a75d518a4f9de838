"""The memory tree as three keyed tables: upsert, union, descent, flattening, cascade, eviction, manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import blank
from ..session import table

LEVELS = (("intents", "intent_id", None), ("stages", "stage_id", "parent_intent_id"), ("actions", "action_id", "parent_stage_id"))
DESCRIPTOR = (
    "role label_or_text accessible_name element_purpose parent_context sibling_context nearby_text form_section"
    " relative_position field_slot value_source input_value_type expected_state_change"
).split()
DESCRIPTOR_LISTS = ("disambiguators", "negative_constraints", "grounding_priority")


def upsert(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by ``order`` (nulls first), with the order of its first row as ``first_at``.

    One aggregation with map-side combine: redelivered keys shrink before the shuffle.  Null keys are left out.
    """
    rest = [c for c in rows.columns if c != key]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    out = rows.where(F.col(key).isNotNull()).groupBy(key).agg(last, F.min(order[0]).alias("first_at"))
    return out.select(key, "_row.*", "first_at")


def live(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rows of a level that stand now: the last of each key, unless deleted."""
    key = next(k for n, k, _ in LEVELS if n == name)
    rows = table(spark, sf_dir, name)
    if name == "intents":
        tie = ["canonical_intent", "batch_no"]
    elif name == "stages":
        tie = ["parent_intent_id", "name"]
    else:
        tie = ["parent_stage_id", "operation", "argument_template"]
    out = upsert(rows, key, ["loaded_at", *tie])
    return out.where(F.col("deleted_at").isNull()) if "deleted_at" in out.columns else out


def constraints_text(c: Column, sep: str) -> Column:
    return F.concat_ws(" ", F.transform(F.coalesce(c, F.array().cast(_CONSTRAINTS)), lambda x: F.concat(blank(x["slot"]), F.lit(sep), blank(x["value"]))))


_CONSTRAINTS = "array<struct<slot:string,value:string,evidence:string>>"


def intent_text() -> Column:
    return F.trim(F.concat_ws(" ", blank(F.col("canonical_intent")), constraints_text(F.col("constraints"), " "), blank(F.col("domain_hint"))))


def stage_text() -> Column:
    conditions = F.concat_ws(" ", "pre_conditions", "post_conditions")
    extra = F.concat_ws(" ", "stage_type", F.concat_ws(" ", "completion_signals"), "transfer_rationale")
    return F.trim(F.concat_ws(" ", blank(F.col("name")), conditions, extra))


def descriptor_text() -> Column:
    """All values of the descriptor in order, lists flattened, nulls left out."""
    d = "semantic_description"
    return F.concat_ws(" ", *[F.col(f"{d}.{f}") for f in DESCRIPTOR], *[F.concat_ws(" ", f"{d}.{f}") for f in DESCRIPTOR_LISTS])


def action_text() -> Column:
    return F.trim(F.concat_ws(" ", blank(F.col("operation")), blank(F.col("argument_template")), descriptor_text()))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table of all live nodes: record_type, node_id, parent_id, text."""
    texts = {"intents": intent_text(), "stages": stage_text(), "actions": action_text()}
    parts = [
        live(spark, sf_dir, name).select(
            F.lit(name[:-1]).alias("record_type"), F.col(key).alias("node_id"),
            (F.col(parent) if parent else F.lit(None).cast("string")).alias("parent_id"), texts[name].alias("text"),
        )
        for name, key, parent in LEVELS
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def union_tree(intents: DataFrame, stages: DataFrame, actions: DataFrame) -> DataFrame:
    """Heterogeneous records of a tree in one table, intents first by ``record_type``."""
    return intents.unionByName(stages, allowMissingColumns=True).unionByName(actions, allowMissingColumns=True)


def descend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages and actions below each live intent that has stages: two equi joins on the foreign keys."""
    s = live(spark, sf_dir, "stages").select("stage_id", F.col("parent_intent_id").alias("intent_id"))
    a = live(spark, sf_dir, "actions").groupBy(F.col("parent_stage_id").alias("stage_id")).agg(F.count("*").alias("n"))
    i = live(spark, sf_dir, "intents").select("intent_id")
    per = s.join(a, "stage_id", "left").groupBy("intent_id").agg(F.count("*").alias("stages"), F.sum(F.coalesce("n", F.lit(0))).alias("actions"))
    return per.join(i, "intent_id")


def flatten_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One workflow an intent: its actions in order of stage span and step, as ``steps``.

    Steps are ordered by span start, stage, step index and action id; an intent
    without stages has no steps.  A workflow's steps are one row's array, as
    the record format demands.
    """
    s = live(spark, sf_dir, "stages").select("stage_id", F.col("parent_intent_id").alias("intent_id"), F.col("name").alias("stage"), F.coalesce(F.col("span")[0], F.lit(0)).alias("at"))
    a = live(spark, sf_dir, "actions").select(F.col("parent_stage_id").alias("stage_id"), "action_id", "operation", F.coalesce("source.step_index", F.lit(0)).alias("step"), "argument_template")
    step = F.struct("at", "stage_id", "step", "action_id", F.concat_ws("|", blank(F.col("stage")), blank(F.col("operation")), blank(F.col("argument_template"))).alias("text"))
    per = s.join(a, "stage_id").groupBy("intent_id").agg(F.sort_array(F.collect_list(step)).alias("s"))
    i = live(spark, sf_dir, "intents").select("intent_id", "canonical_intent")
    out = i.join(per, "intent_id", "left")
    text = F.concat_ws("; ", F.transform("s", lambda x: x["text"]))
    return out.select(F.concat(F.lit("workflow_"), "intent_id").alias("workflow_id"), F.col("canonical_intent").alias("instruction"), F.greatest(F.size("s"), F.lit(0)).alias("n_steps"), text.alias("steps"))


def workflow_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of all workflows as rows with their place (from 0), in the order of ``flatten_tree``: nothing is joined into one text."""
    s = live(spark, sf_dir, "stages").select("stage_id", F.col("parent_intent_id").alias("intent_id"), F.col("name").alias("stage"), F.coalesce(F.col("span")[0], F.lit(0)).alias("at"))
    a = live(spark, sf_dir, "actions").select(F.col("parent_stage_id").alias("stage_id"), "action_id", "operation", F.coalesce("source.step_index", F.lit(0)).alias("step"), "argument_template")
    i = live(spark, sf_dir, "intents").select("intent_id")
    rows = s.join(a, "stage_id").join(i, "intent_id", "left_semi")
    # places without one task an intent: stages are placed by the sizes of those before, steps within their stage
    sizes = rows.groupBy("intent_id", "stage_id", "at").agg(F.count("*").alias("n"))
    w = W.partitionBy("intent_id").orderBy("at", "stage_id").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).select("intent_id", "stage_id", "before")
    nth = F.row_number().over(W.partitionBy("stage_id").orderBy("step", "action_id")) - 1
    out = rows.withColumn("nth", nth).join(before, ["intent_id", "stage_id"])
    return out.select(F.concat(F.lit("workflow_"), "intent_id").alias("workflow_id"), (F.col("before") + F.col("nth")).alias("place"), "stage_id", "stage", "action_id", "operation", "argument_template")


def from_workflows(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stages and actions out of ``workflow_steps``: the way up, with spans of places."""
    stages = steps.groupBy("workflow_id", "stage_id").agg(F.first("stage").alias("name"), F.min("place").alias("start"), F.max("place").alias("end"))
    return stages, steps.select("action_id", F.col("stage_id").alias("parent_stage_id"), "operation", "argument_template", F.col("place").alias("step_index"))


def cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each level when every record below a missing parent goes too: two semi joins."""
    i = live(spark, sf_dir, "intents").select("intent_id")
    s0, a0 = live(spark, sf_dir, "stages"), live(spark, sf_dir, "actions")
    s = s0.join(i, s0.parent_intent_id == i.intent_id, "left_semi").select("stage_id")
    a = a0.join(s, a0.parent_stage_id == s.stage_id, "left_semi").select("action_id")
    rows = i.select(F.lit("intent").alias("level")).unionByName(s.select(F.lit("stage").alias("level"))).unionByName(a.select(F.lit("action").alias("level")))
    return rows.groupBy("level").agg(F.count("*").alias("kept"))


def overflow(spark: SparkSession, sf_dir: str, keep: int = 50) -> DataFrame:
    """Intents that first-in first-out eviction removes from domains with more than ``keep``; batch 0 is protected.

    The rank within a domain is exact without one task per domain: rows are
    counted by domain and day of arrival, and ranked within the day.
    """
    i = live(spark, sf_dir, "intents").select(blank(F.col("domain_hint")).alias("domain"), "intent_id", "first_at", "batch_no")
    days = i.withColumn("day", F.to_date("first_at"))
    removable = F.coalesce(F.col("batch_no"), F.lit(1)) > 0
    sums = days.groupBy("domain", "day").agg(F.count("*").alias("n"), F.sum(removable.cast("int")).alias("r"))
    sums = sums.withColumn("before", F.coalesce(F.sum("r").over(W.partitionBy("domain").orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    sums = sums.withColumn("size", F.sum("n").over(W.partitionBy("domain")))
    ranked = days.where(removable).withColumn("nth", F.row_number().over(W.partitionBy("domain", "day").orderBy("first_at", "intent_id")))
    out = ranked.join(sums, ["domain", "day"]).where(F.col("before") + F.col("nth") <= F.col("size") - keep)
    return out.select("domain", "intent_id", (F.col("before") + F.col("nth")).alias("place"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and a fingerprint a type: node hashes are summed up by type in blocks, so no list of all nodes is built."""
    n = nodes(spark, sf_dir)
    h = F.sha1(F.concat_ws("\u0001", "node_id", blank(F.col("parent_id")), "text"))
    part = n.select("record_type", F.substring(h, 1, 2).alias("block"), F.conv(F.substring(h, 1, 12), 16, 10).cast("decimal(38,0)").alias("v"))
    blocks = part.groupBy("record_type", "block").agg(F.count("*").alias("n"), F.sum("v").alias("v"))
    return blocks.groupBy("record_type").agg(F.sum("n").alias("nodes"), F.sum("v").cast("string").alias("fingerprint"))
