"""Small projections between raw records and the agent's view: names, texts of steps, elements, states of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import describe as D
from .grounding import element_id
from .nested import _variant

# fixed values: names of operations and domains, roles that act on a click or take text, attributes with text
OPERATION_NAMES = {"click": "click", "select": "select", "type": "type", "input": "type", "hover": "hover", "press": "press", "stop": "stop"}
DOMAIN_WORDS = {"gitlab": ["gitlab"], "reddit": ["reddit"], "shopping_admin": ["admin", "cms"], "shopping": ["shop"], "map": ["map"]}
DOMAIN_NAMES = {"shopping_admin": "shopping_admin", "cms": "shopping_admin", "admin": "shopping_admin", "map": "map", "maps": "map"}
CLICKS = "button link menuitem checkbox radio input option".split()
EDITS = "textbox searchbox combobox textarea".split()
TEXT_ATTRIBUTES = "text title aria-label placeholder value alt name".split()
SPLIT_HINTS = {
    "train": "train", "training": "train", "cross_task": "cross_task", "test_task": "cross_task", "cross_website": "cross_website",
    "test_website": "cross_website", "cross_domain": "cross_domain", "test_domain": "cross_domain",
}
QUERY_FIELDS = "role label_or_text accessible_name element_purpose parent_context form_section field_slot nearby_text".split()


def operation_name(c: Column) -> Column:
    """A recorded operation in one name; unknown ones in lower case, an empty or null one is a click."""
    low = F.lower(X.blank(c))
    names = F.create_map(*[F.lit(x) for kv in OPERATION_NAMES.items() for x in kv])
    return F.when(low == "", "click").otherwise(F.coalesce(names[low], low))


def domain_name(c: Column) -> Column:
    """A domain by its name, else by a word in it, else as it is; empty is unknown."""
    t = F.trim(F.translate(F.lower(X.blank(c)), "-", "_"))
    names = F.create_map(*[F.lit(x) for kv in DOMAIN_NAMES.items() for x in kv])
    out = F.when(names[t].isNotNull(), names[t])
    for name, words in DOMAIN_WORDS.items():
        out = out.when(X.contains_any(t, words), name)
    return out.when(t == "", "unknown").otherwise(t)


def split_hint(file_name: Column) -> Column:
    """The split that a file's name speaks of; unknown without one."""
    t = F.translate(F.lower(X.blank(file_name)), "- ", "__")
    out = None
    for alias, name in SPLIT_HINTS.items():
        hit = F.contains(t, F.lit(alias))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unknown")


def shaped(steps: DataFrame) -> DataFrame:
    """Each candidate of a step as the agent sees it: id, role, text and contexts cut at 240 characters, clickable, editable.

    ``steps``: task_id, pos, pos_candidates, neg_candidates; an element without an id is named by its place.
    """
    every = F.concat(F.coalesce("pos_candidates", F.array()), F.coalesce("neg_candidates", F.array()))
    e = steps.select("task_id", "pos", F.posexplode(every).alias("index", "c"))
    a = F.coalesce("c.attributes", F.create_map().cast("map<string,string>"))
    tag, kind = F.lower(X.blank(F.col("c.tag"))), F.lower(X.blank(a["type"]))
    role = (
        F.when(F.length("c.role") > 0, F.lower("c.role")).when(tag == "button", "button").when(tag == "a", "link")
        .when(tag.isin("input", "textarea"), F.when(kind.isin("button", "submit", "checkbox", "radio"), kind).otherwise("textbox"))
        .when(tag == "select", "combobox").when(tag == "", "element").otherwise(tag)
    )
    text = F.concat_ws(" ", F.nullif("c.text", F.lit("")), *[F.nullif(a[k], F.lit("")) for k in TEXT_ATTRIBUTES])
    return e.select(
        "task_id", "pos", "index", F.coalesce(element_id(F.col("c")), F.concat(F.lit("candidate_"), F.col("index").cast("string"))).alias("element_id"), role.alias("role"),
        X.clean(text, 240).alias("visible_text"), X.clean(F.col("c.parent_context"), 240).alias("parent_context"), X.clean(F.col("c.sibling_text"), 240).alias("sibling_text"),
        role.isin(*CLICKS).alias("clickable"), role.isin(*EDITS).alias("editable"),
    )


def step_texts(described: DataFrame) -> DataFrame:
    """The texts of a step (``construct.described_steps``): description of the action, one-line summary, query for an element."""
    given = lambda c: F.nullif(X.blank(F.col(c)), F.lit(""))
    action = F.concat_ws(" ", "op", given("role"), F.nullif(F.substring("label", 1, 300), F.lit("")), given("argument"))
    summary = F.trim(F.concat(F.col("pos").cast("string"), F.lit(": "), F.col("op"), F.lit(" "), F.col("label"), F.lit(" "), X.blank(F.col("argument"))))
    names = {"role": "role", "label_or_text": "label", "element_purpose": "element_purpose", "parent_context": "parent", "form_section": "section", "field_slot": "slot"}
    query = X.collapse(F.concat_ws(" ", *[given(names[f]) for f in QUERY_FIELDS if f in names]))
    return described.select("task_id", "pos", action.alias("action"), summary.alias("summary"), query.alias("query"))


def abstract_states(steps: DataFrame, elements: DataFrame) -> DataFrame:
    """State of the page of each step: url parts, counts of its elements (``shaped``), keyword evidence in their texts, and a summary of lines.

    A step without elements has counts of 0; the summary lists the elements in their order.
    """
    label = F.col("visible_text")
    kinds = F.concat_ws(",", F.when(F.col("clickable"), "clickable"), F.when(F.col("editable"), "editable"))
    line = F.concat(
        F.lit("- "), "element_id", F.lit(" role="), "role", F.lit(" label="), label, F.lit(" parent="), F.substring("parent_context", 1, 120),
        F.lit(" sibling="), F.substring("sibling_text", 1, 80), F.lit(" attrs="), F.when(kinds == "", "static").otherwise(kinds),
    )
    text = F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in ("role", "visible_text", "parent_context", "sibling_text")])
    per = elements.groupBy("task_id", "pos").agg(
        F.sum((F.col("clickable") | F.col("editable")).cast("int")).alias("interactive"), F.max("editable").alias("has_editable_field"), F.max("clickable").alias("has_clickable_control"),
        F.sort_array(F.collect_list(F.struct("index", line.alias("line"), text.alias("text")))).alias("e"),
    )
    x = steps.select("task_id", "pos", X.blank(F.col("url")).alias("url")).join(per, ["task_id", "pos"], "left")
    x = x.withColumn("t", F.lower(F.concat_ws(" ", "url", F.concat_ws(" ", F.transform("e", lambda e: e["text"])))))
    evidence = {f"has_{n}": F.expr("case " + " ".join(f"when contains(t, {D._q(w)}) then {D._q(w)}" for w in ws) + " else '' end") for n, ws in D.STATES.items()}
    x = x.withColumns(evidence)
    lines = F.concat(F.array(F.concat(F.lit("url: "), "url")), F.coalesce(F.transform("e", lambda e: e["line"]), F.array().cast("array<string>")))
    no = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return x.select("task_id", "pos", F.coalesce("interactive", F.lit(0)).alias("interactive"), no("has_editable_field"), no("has_clickable_control"), *evidence, F.concat_ws("\n", lines).alias("summary"))


def observations(steps: DataFrame) -> DataFrame:
    """What each step of a trace (``step``: variant) observed: text cut at 4000 characters, url, and number of candidates."""
    get = lambda p: _variant("step", p, "string")
    plain = F.when(_variant("step", "$.observation", "map<string,variant>").isNull(), get("$.observation"))
    text = F.coalesce(get("$.observation.text"), plain)
    n = F.size(F.coalesce(_variant("step", "$.observation.candidates", "array<variant>"), F.array().cast("array<variant>")))
    return steps.select("task_id", "pos", X.clean(text, 4000).alias("text"), X.blank(get("$.observation.url")).alias("url"), n.alias("candidates"))


def json_span(text: Column) -> Column:
    """The part of a text from its first ``{`` to its last ``}``, in which an answer in prose holds its object; null without one."""
    t = X.blank(text)
    start, end = F.instr(t, "{"), F.length(t) - F.instr(F.reverse(t), "}") + 1
    return F.when((start > 0) & F.contains(t, F.lit("}")) & (end > start), F.substring(t, start, end - start + 1))
