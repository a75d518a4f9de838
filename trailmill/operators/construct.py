"""Memory out of recorded tasks: intents, stages with conditions, action patterns, and the check of the three together.

Everything is a projection or a window over the steps of a task; ids are
hashes of what identifies a node, so equal inputs give equal ids.  Model calls
have their place as arguments (``normalize``, ``describe``): functions from
columns to a column, with the rules here standing in for them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from . import describe as D
from . import episodes as E
from .maintenance import canonical_operation

# fixed values: conditions before and after a stage of a kind
CONDITIONS = {
    "navigation": (
        ["task-relevant site or landing page is visible", "navigation controls or content links are available"],
        "the next task-relevant page, section, or listing is visible",
    ),
    "search_form": (
        ["task search form or relevant input fields are visible", "task constraints can be entered or selected"],
        "the search query or form constraints are reflected in the page state",
    ),
    "filtering": (
        ["result list is visible", "filter, sort, or refinement controls are available"],
        "the visible results reflect the applied filter or sort option",
    ),
    "item_selection": (
        ["candidate items or options are visible", "the desired item can be identified by task constraints"],
        "the intended item or option is selected or opened",
    ),
    "configuration": (["product or workflow configuration options are visible"], "the chosen configuration options are visible as selected"),
    "checkout_or_confirmation": (["the selected item or completed form is ready to continue"], "the workflow advances to checkout, confirmation, or the next step"),
    "content_reading": (["the relevant content page or section can be opened or read"], "the requested content is visible for reading or answering"),
    "form_filling": (["input fields relevant to the current task stage are visible"], "the task-provided values are present in the appropriate fields"),
    "submission": (["all required fields for the current form or filter are filled"], "the page updates to results, saved state, or submitted state"),
    "answer_extraction": (["the requested answer or final state is visible"], "the task can be stopped with the extracted answer"),
    "generic": (["task-relevant page state is visible"], "the stage outcome is visible"),
}
WARNINGS = {
    "evidence": "descriptor has little lexical grounding evidence",
    "role": "target role is generic; grounding may require context",
    "change": "expected state change is missing",
    "priority": "grounding priority is missing",
}
# fixed values: fields of an element that are not carried over to another page
FORBIDDEN = "backend_node_id node_id raw_node_id css_selector selector xpath absolute_coordinates coordinates bbox dom_path candidate_id data_reactid".split()
STATUS = {"conflict": -1, "completed": 0, "not_ready": 1, "in_progress": 3, "ready": 4}


def stable_id(prefix: str, *parts: Column) -> Column:
    """Prefix and the first 12 hex digits of the hash of the parts; a null part counts as empty."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 12))


def quoted(text: Column) -> Column:
    """The parts of a text in single or double quotes, in order."""
    return F.regexp_extract_all(X.blank(text), F.lit("('[^']+'|\"[^\"]+\")"), F.lit(1))


def intents(tasks: DataFrame, normalize: Callable[[Column], Column] | None = None) -> DataFrame:
    """task_id, intent_id, canonical_intent, domain_hint, constraints (``slot=value``) of tasks (task_id, instruction).

    ``normalize`` is the place for a model: instruction to canonical intent.
    A null instruction is an empty one.
    """
    t = tasks.select("task_id", F.col("instruction").alias("raw"), F.lower(F.trim(X.blank(F.col("instruction")))).alias("low"))
    canonical = normalize(F.col("raw")) if normalize else X.collapse(F.regexp_replace("low", r"\.+$", ""))
    value = F.transform(quoted(F.col("raw")), lambda q, i: F.concat(F.lit("quoted_value_"), (i + 1).cast("string"), F.lit("="), F.substring(q, F.lit(2), F.length(q) - 2)))
    t = t.select("task_id", canonical.alias("canonical_intent"), F.expr(D.case("low", D.DOMAINS, "other")).alias("domain_hint"), value.alias("constraints"))
    return t.withColumn("intent_id", stable_id("intent", F.col("canonical_intent"), F.col("domain_hint"), F.concat_ws(";", "constraints")))


def stages(spans: DataFrame, intents_: DataFrame, describe: Callable[[Column], Column] | None = None) -> DataFrame:
    """stage_id, intent_id, task_id, stage, name, start, end, kind, pre_conditions, post_conditions of spans with their kinds.

    ``describe`` is the place for a model: the stage's name and kind to a name.
    """
    pre = F.create_map(*[x for k, (p, _) in CONDITIONS.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in p]))])
    post = F.create_map(*[x for k, (_, p) in CONDITIONS.items() for x in (F.lit(k), F.array(F.lit(p)))])
    s = spans.join(intents_.select("task_id", "intent_id"), "task_id")
    name = describe(F.struct("name", "kind")) if describe else F.col("name")
    s = s.withColumns({"name": name, "pre_conditions": pre[F.col("kind")], "post_conditions": post[F.col("kind")]})
    key = [F.col(c) for c in ("task_id", "intent_id", "stage", "name", "start", "end")]
    return s.select(stable_id("stage", *key).alias("stage_id"), "intent_id", "task_id", "stage", "name", "start", "end", "kind", "pre_conditions", "post_conditions")


def described_steps(rows: DataFrame) -> DataFrame:
    """Steps (``E.steps``) with all descriptor fields of their first positive element."""
    c = F.get("pos_candidates", F.lit(0))
    x = rows.select(
        "task_id", "pos", canonical_operation(F.col("operation")).alias("op"), "argument", "label", F.when(F.col("role") == "", "generic").otherwise(F.col("role")).alias("role"),
        X.collapse(c["parent_context"]).alias("parent"), X.collapse(c["sibling_text"]).alias("sibling"), "action_repr",
    )
    return D.described(x)


def actions(rows: DataFrame, stages_: DataFrame) -> DataFrame:
    """action_id, stage_id, task_id, step_index, operation, argument_template and descriptor of each step, with its quality warnings."""
    x = described_steps(rows)
    s = stages_.select(F.col("task_id").alias("_t"), "stage_id", "start", "end")
    x = x.join(s, (F.col("task_id") == F.col("_t")) & (F.col("pos") >= F.col("start")) & (F.col("pos") <= F.col("end")))
    return x.select(
        stable_id("act", F.col("task_id"), F.col("stage_id"), F.col("pos"), F.col("op"), F.col("label"), F.col("role")).alias("action_id"), "stage_id", "task_id", F.col("pos").alias("step_index"),
        F.col("op").alias("operation"), F.col("argument").alias("argument_template"), "role", F.col("label").alias("label_or_text"), "parent", "sibling", *D.FIELDS, warnings().alias("warnings"),
    )


def warnings() -> Column:
    """What makes a descriptor weak, in order."""
    few = (F.col("label") == "") & (F.col("parent") == "")
    generic = F.col("role").isin("generic", "div", "span") & F.col("op").isin("click", "type", "select")
    rules = {"evidence": few, "role": generic, "change": F.col("expected_state_change") == "", "priority": F.col("grounding_priority") == ""}
    return F.array_compact(F.array(*[F.when(rule, WARNINGS[k]) for k, rule in rules.items()]))


def consistency(spans: DataFrame, rows: DataFrame, owned: DataFrame) -> DataFrame:
    """task_id and ``errors`` (sorted) of the stages of each task: order, gaps, overlaps, cover, conditions, actions.

    ``spans``: task_id, stage, start, end, n_conditions; ``rows``: the steps;
    ``owned``: task_id, pos of every action.  Tasks without an error have an empty list.
    """
    w = W.partitionBy("task_id").orderBy("start", "stage")
    s = spans.withColumns({"p_end": F.lag("end").over(w), "p_stage": F.lag("stage").over(w)})
    span = s.groupBy("task_id").agg(
        F.max(F.coalesce(F.col("stage") < F.col("p_stage"), F.lit(False))).alias("unordered"), F.max(F.coalesce(F.col("start") != F.col("p_end") + 1, F.lit(False))).alias("gap"),
        F.max(F.coalesce(F.col("start") <= F.col("p_end"), F.lit(False))).alias("overlap"), F.max(F.col("n_conditions") == 0).alias("bare"),
        F.sum(F.col("end") - F.col("start") + 1).alias("covered"), F.min("start").alias("lo"), F.max("end").alias("hi"),
    )
    steps = rows.groupBy("task_id").agg(F.count("*").alias("n"))
    acts = owned.groupBy("task_id").agg(F.count("*").alias("acts"), F.countDistinct("pos").alias("distinct_acts"))
    x = steps.join(span, "task_id", "left").join(acts, "task_id", "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    exact = (F.col("covered") == F.col("n")) & (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & ~no("overlap")
    rules = {
        "stage spans are not ordered": no("unordered"), "stage spans are not contiguous": no("gap"), "stage spans overlap": no("overlap"),
        "stage has no observable conditions": no("bare"), "stage spans do not cover the steps exactly": ~F.coalesce(exact, F.lit(False)),
        "steps are covered more than once": F.coalesce(F.col("overlap"), F.lit(False)),
        "actions do not cover the steps exactly once": ~F.coalesce((F.col("acts") == F.col("n")) & (F.col("distinct_acts") == F.col("n")), F.lit(False)),
    }
    return x.select("task_id", F.array_sort(F.array_compact(F.array(*[F.when(r, m) for m, r in rules.items()]))).alias("errors"))


def transitions(stages_: DataFrame) -> DataFrame:
    """Each stage with the names and conditions that hand over to it and from it."""
    w = W.partitionBy("task_id").orderBy("stage")
    text = lambda c: F.concat_ws("; ", c)
    return stages_.select(
        "stage_id", "name", text("pre_conditions").alias("pre"), text("post_conditions").alias("post"),
        F.lag("stage_id").over(w).alias("previous_id"), F.lag(text("post_conditions")).over(w).alias("previous_post"),
        F.lead("stage_id").over(w).alias("next_id"), F.lead(text("pre_conditions")).over(w).alias("next_pre"),
    )


def status(decision: Column, pre_met: Column, score: Column) -> Column:
    """Where a stage stands, from the decision on its conditions."""
    return (
        F.when(decision == "conflict", "conflict").when(decision == "already_completed", "completed").when(pre_met, "ready")
        .when(score > 0, "in_progress").otherwise("not_ready")
    )


def ordered(rows: DataFrame, by: str) -> DataFrame:
    """Evaluated stages (``status``, ``score``, ``start``, ``stage_id``) with their place: ready ones first, conflicts last."""
    priority = F.create_map(*[F.lit(v) for kv in STATUS.items() for v in kv])
    w = W.partitionBy(by).orderBy(F.desc(priority[F.col("status")]), F.desc("score"), "start", "stage_id")
    return rows.withColumn("place", F.row_number().over(w))


def built(rows: DataFrame, tasks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Intents, stages and actions of tasks out of their steps."""
    i = intents(tasks)
    s = stages(E.stages(E.boundaries(E.evidence(rows))), i)
    return i, s, actions(rows, s)
