"""Matching an action pattern to the elements of a page: scored within the step, best element with calibrated confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from .nested import ATTRIBUTE_ID_KEYS

# fixed values: roles an operation goes with, and weights
ROLES = {
    "click": "button link tab menuitem option checkbox radio switch summary generic".split(),
    "type": "textbox searchbox combobox spinbutton input textarea generic".split(),
    "select": "combobox listbox option radio checkbox switch generic".split(),
    "hover": "link button menuitem generic".split(),
    "scroll": "main region generic".split(),
    "stop": ["generic"],
}
# fixed values: weight of a descriptor field, and the part of an element that it is compared with
FIELDS = {
    "role": (0.12, None), "label_or_text": (0.20, "text"), "accessible_name": (0.18, "text"), "element_purpose": (0.12, "whole"),
    "parent_context": (0.12, "around"), "sibling_context": (0.06, "beside"), "nearby_text": (0.08, "beside"), "form_section": (0.08, "around"),
    "region": (0.05, "around"), "field_slot": (0.08, "whole"), "expected_state_change": (0.04, "whole"),
}
PRIORITY, DISAMBIGUATORS, NEGATIVE, REJECTED, FLOOR = 1.25, 0.18, 0.35, 0.92, 0.05
INTERACTIVE = "button link textbox combobox checkbox radio menuitem option tab switch slider searchbox spinbutton listbox treeitem".split()
INTERACTIVE_TAGS = "a button input select textarea option summary details".split()
TAG_ROLES = {"a": "link", "select": "combobox", "textarea": "textbox", "input": "textbox", "nav": "navigation", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading"}
PLACES = {
    "filter panel": "filter sort refine".split(), "search form": ["search", "query"], "checkout area": "cart checkout payment".split(),
    "navigation area": "navigation menu section".split(), "content discussion area": "comment reply post".split(),
}
DISABLED, HIDDEN = 0.45, 0.35


def elements(steps: DataFrame) -> DataFrame:
    """task_id, pos, index, element_id, tag, role, text fields and state of each candidate of a step, positives first."""
    both = F.concat(
        F.transform(F.coalesce("pos_candidates", F.array()), lambda c: F.struct(c.alias("c"), F.lit(True).alias("gold"))),
        F.transform(F.coalesce("neg_candidates", F.array()), lambda c: F.struct(c.alias("c"), F.lit(False).alias("gold"))),
    )
    e = steps.select("task_id", "pos", F.posexplode(both).alias("index", "e"))
    names = F.create_map(*[F.lit(x) for kv in TAG_ROLES.items() for x in kv])
    tag = F.lower(X.blank(F.col("e.c.tag")))
    own = X.normal_key(F.col("e.c.role"))
    role = F.when(own != "", own).when(tag == "", "generic").otherwise(F.coalesce(names[tag], tag))
    a = F.coalesce("e.c.attributes", F.create_map().cast("map<string,string>"))
    has = lambda k: F.map_contains_key(a, k)
    return e.select(
        "task_id", "pos", "index", F.col("e.gold").alias("gold"), element_id(F.col("e.c")).alias("element_id"), X.blank(F.col("e.c.tag")).alias("tag"),
        role.alias("role"), X.collapse(F.col("e.c.text")).alias("label"), X.collapse(F.col("e.c.parent_context")).alias("parent"), X.collapse(F.col("e.c.sibling_text")).alias("sibling"),
        (has("onclick") | has("tabindex")).alias("handles"), (has("disabled") | (X.normal_key(a["aria-disabled"]) == "true")).alias("disabled"),
        (has("hidden") | (X.normal_key(a["aria-hidden"]) == "true")).alias("hidden"), has("readonly").alias("readonly"),
    )


def snapshot(page: DataFrame) -> DataFrame:
    """``elements`` of pages with the context that a page gives: neighbours, place, region and salience, and their order by it (``rank`` from 0).

    One shuffle by page; the order is by salience, then by id as text.
    """
    w = W.partitionBy("task_id", "pos").orderBy("index")
    label = F.nullif("label", F.lit(""))
    around = lambda *ks: F.concat_ws(" ", *[F.lag(label, -k).over(w) for k in ks])
    x = page.withColumn("eid", F.coalesce(F.nullif("element_id", F.lit("")), F.concat(F.lit("el_"), F.col("index").cast("string"))))
    x = x.withColumns({"_beside": around(-1, 1), "nearby": around(-2, -1, 1, 2), "place": F.format_string("element %d of %d", F.col("index") + 1, F.count("*").over(W.partitionBy("task_id", "pos")))})
    x = x.withColumn("sibling", F.when(F.col("sibling") != "", F.col("sibling")).otherwise(F.col("_beside"))).drop("_beside")
    key = X.normal_key(F.concat_ws(" ", "parent", "nearby"))
    region = None
    for name, words in PLACES.items():
        hit = X.contains_any(key, words)
        region = F.when(hit, name) if region is None else region.when(hit, name)
    x = x.withColumn("region", region.otherwise("main content"))
    state = F.concat_ws(" ", F.when(F.col("disabled"), "disabled:True"), F.when(F.col("hidden"), "visible:False"))
    parts = ["role", "label", "parent", "region", "sibling", "nearby", "place"]
    length = F.length(F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in parts], F.nullif(state, F.lit(""))))
    acts = F.col("role").isin(*INTERACTIVE) | F.lower("tag").isin(*INTERACTIVE_TAGS) | F.col("handles")
    one = lambda c, v: F.when(c, v).otherwise(0.0)
    salience = one(acts, 2.0) + one(F.col("label") != "", 1.0) + one(F.col("parent") != "", 0.5) - one(F.col("disabled"), 1.0) + F.least(F.lit(1.0), length / 120.0)
    x = x.withColumn("salience", F.round(salience, 4))
    best = W.partitionBy("task_id", "pos").orderBy(F.desc("salience"), "eid", "index")
    return x.withColumns({"interactive": acts, "rank": F.row_number().over(best) - 1, "whole": F.concat_ws(" ", *parts, state)})


def page_summaries(page: DataFrame, most: int = 30, chars: int = 2400) -> DataFrame:
    """task_id, pos and ``summary``: the ``most`` most salient elements of a snapshot, a line each, cut at ``chars``."""
    where = F.concat_ws(" | ", F.nullif("parent", F.lit("")), F.nullif("region", F.lit("")))
    line = F.concat(F.lit("- "), "eid", F.lit(": role="), "role", F.lit("; text="), "label", F.lit("; context="), where)
    lines = page.where(F.col("rank") < most).groupBy("task_id", "pos").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    text = F.concat(F.lit("Salient elements: "), F.concat_ws(" ", F.transform("l", lambda x: x["line"])))
    return lines.select("task_id", "pos", F.substring(X.collapse(text), 1, chars).alias("summary"))


def element_id(c: Column) -> Column:
    attributes = [F.nullif(c["attributes"][k], F.lit("")) for k in ATTRIBUTE_ID_KEYS]
    return F.coalesce(F.nullif(c["backend_node_id"], F.lit("")), F.nullif(c["node_id"], F.lit("")), *attributes)


def scored(actions: DataFrame, page: DataFrame) -> DataFrame:
    """Every element of the page of each action with the parts of its score and its place (``rn`` from 1).

    ``actions``: task_id, pos, op, argument, d_... for each of ``FIELDS``, and
    d_disambiguators, d_negative_constraints, d_priority (arrays); ``page``: a
    ``snapshot``.  The join is on the step, so every action meets the elements
    of its page only.
    """
    parts = {"text": F.col("label"), "whole": F.col("whole"), "around": F.concat_ws(" ", "parent", "region"), "beside": F.concat_ws(" ", "sibling", "nearby")}
    p = page.withColumns({f"t_{n}": X.token_set(c) for n, c in parts.items()}).withColumn("_beside", parts["beside"])
    sets = lambda c: F.transform(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda t: X.collapse(t) != ""), X.token_set)
    a = actions.withColumns({f"s_{f}": X.token_set(F.col(f"d_{f}")) for f in FIELDS if f != "role"})
    a = a.withColumns({"s_more": sets(F.col("d_disambiguators")), "s_not": sets(F.col("d_negative_constraints")), "d_priority": F.coalesce("d_priority", F.array().cast("array<string>"))})
    x = p.join(a, ["task_id", "pos"])
    op = X.normal_key(F.col("op"))
    fits, generic = F.lit(False), F.lit(False)
    for name, roles in ROLES.items():
        fits = fits | ((op == name) & F.col("role").isin(*roles))
    fits = fits | (~op.isin(*ROLES) & (F.col("role") == "generic"))
    base = F.when(fits, 1.0).otherwise(0.65) + F.least(F.lit(0.08), F.col("salience") / 50.0)
    base = F.when((op == "type") & F.col("readonly"), 0.5 * base).otherwise(base)
    x = x.withColumn("op_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), base)))
    total, weights, matched = F.lit(0.0), F.lit(0.0), F.lit(0)
    for f, (w, part) in FIELDS.items():
        weight = F.when(F.array_contains("d_priority", f), w * PRIORITY).otherwise(w)
        if part is None:
            value = (X.normal_key(F.col("d_role")) == X.normal_key(F.concat_ws(" ", "role", F.nullif("tag", F.lit(""))))).cast("double")
            there = F.lit(True)
        else:
            value = X.overlap(F.col(f"s_{f}"), F.col(f"t_{part}"))
            there = F.col("label") != "" if part == "text" else F.col("_beside") != "" if part == "beside" else F.lit(True)
        both = (X.blank(F.col(f"d_{f}")) != "") & there
        total = total + F.when(both, weight * value).otherwise(0.0)
        weights = weights + F.when(both, weight).otherwise(0.0)
        matched = matched + F.when(both & (value > 0), 1).otherwise(0)
    x = x.withColumns({"fields": F.when(weights > 0, total / weights).otherwise(0.0), "matched": matched})
    over = lambda c: F.transform(c, lambda t: X.overlap(t, F.col("t_whole")))
    more = F.when(F.size("s_more") > 0, F.aggregate(over("s_more"), F.lit(0.0), lambda s, v: s + v) / F.size("s_more")).otherwise(0.0)
    against = NEGATIVE * F.coalesce(F.array_max(over("s_not")), F.lit(0.0))
    state = F.when(F.col("disabled"), DISABLED).otherwise(0.0) + F.when(F.col("hidden"), HIDDEN).otherwise(0.0)
    tie = F.least(F.lit(0.04), F.col("salience") / 100.0) + F.greatest(F.lit(0.0), 0.03 - F.col("rank") * 0.001)
    x = x.withColumn("rejected", (against > 0) | (state > 0) | (F.col("op_score") == 0))
    score = 0.22 * F.col("op_score") + 0.58 * F.col("fields") + DISAMBIGUATORS * more + tie - against - state
    x = x.withColumns({"disambiguators": more, "negative": against, "state": state, "tie": tie, "total": F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 9)})
    w = W.partitionBy("task_id", "pos").orderBy(F.desc("total"), "eid", "index")
    return x.withColumn("second", F.lead("total", 1, 0.0).over(w)).withColumn("rn", F.row_number().over(w))


def breakdown(actions: DataFrame, page: DataFrame, most: int = 12) -> DataFrame:
    """The ``most`` best elements of each action with the parts of their scores and why they are held back."""
    x = scored(actions, page).where(F.col("rn") <= most)
    why = F.array_compact(F.array(F.when(F.col("op_score") == 0, "operation/role mismatch"), F.when(F.col("state") > 0, "candidate appears disabled or hidden"), F.when(F.col("negative") > 0, "negative constraint matched")))
    part = lambda c: F.round(c, 6).alias(c)
    return x.select("task_id", "pos", F.col("rn").alias("rank"), F.col("eid").alias("element_id"), *[part(c) for c in ("total", "op_score", "fields", "disambiguators", "negative", "state", "tie")], "matched", why.alias("rejected"))


def grounded(actions: DataFrame, page: DataFrame) -> DataFrame:
    """Best element of each action (``scored``): task_id, pos, element_id, total, matched, confidence, argument, correct.

    ``element_id`` is null below the confidence floor, and for a stop.
    """
    x = scored(actions, page).where(F.col("rn") == 1)
    op = X.normal_key(F.col("op"))
    conf = 0.78 * F.col("total") + 0.15 * F.greatest(F.lit(0.0), F.col("total") - F.col("second")) + F.least(F.lit(0.15), 0.03 * F.col("matched"))
    conf = F.least(F.lit(1.0), F.when(F.col("rejected"), REJECTED * conf).otherwise(conf))
    x = x.withColumn("confidence", F.round(F.when(op == "stop", 1.0).otherwise(conf), 6))
    keep = (F.col("confidence") >= FLOOR) & (op != "stop")
    return x.select("task_id", "pos", F.when(keep, F.col("eid")).alias("element_id"), "total", "matched", "confidence", argument().alias("argument"), F.col("gold").alias("correct"))


def argument() -> Column:
    """The action's own argument, else what its value source names behind a colon; null without either."""
    source = X.blank(F.col("value_source"))
    behind = F.trim(F.substring(source, F.instr(source, ":") + 1, F.length(source)))
    return F.when(F.length("argument") > 0, F.col("argument")).when(F.contains(source, F.lit(":")), behind)


def serialized(op: Column, element: Column, argument: Column) -> dict[str, Column]:
    """An action in the bracket and the call dialect."""
    o, e, a = F.lower(op), element, F.coalesce(argument, F.lit(""))
    has = F.coalesce(F.length(e) > 0, F.lit(False))
    esc = lambda c: F.replace(F.replace(X.blank(c), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    b = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    typed = o.isin("type", "input", "fill")
    press, scroll = F.when(a == "", "ENTER").otherwise(a), F.when(a == "", "down").otherwise(a)
    press_call, scroll_call = F.when(a == "", "Enter").otherwise(esc(a)), F.when(a == "", "down").otherwise(esc(a))
    brackets = (
        F.when((o == "click") & has, b("click [", e, "]")).when(typed & has, b("type [", e, "] [", a, "]")).when((o == "select") & has, b("select [", e, "] [", a, "]"))
        .when((o == "hover") & has, b("hover [", e, "]")).when(o == "press", b("press [", press, "]")).when(o == "scroll", b("scroll [", scroll, "]")).otherwise("stop")
    )
    call = (
        F.when((o == "click") & has, b("click('", esc(e), "')")).when(typed & has, b("fill('", esc(e), "', '", esc(a), "')")).when((o == "select") & has, b("select_option('", esc(e), "', '", esc(a), "')"))
        .when((o == "hover") & has, b("hover('", esc(e), "')")).when(o == "press", b("press('", press_call, "')")).when(o == "scroll", b("scroll('", scroll_call, "')")).otherwise("stop()")
    )
    return {"brackets": brackets, "call": call}


def salient(page: DataFrame, query: DataFrame, k: int = 30) -> DataFrame:
    """The ``k`` most salient elements of a step for a query text (task_id, query): visible, interactive, overlapping."""
    x = page.join(query, "task_id")
    q, t = X.token_set(F.col("query")), X.token_set(F.concat_ws(" ", "role", "label", "parent", "sibling"))
    inter, union = F.size(F.array_intersect(q, t)), F.greatest(F.lit(1), F.size(F.array_union(q, t)))
    interactive = F.when(F.col("role").isin("button", "link", "menuitem", "checkbox", "radio", "input", "option", "textbox", "searchbox", "combobox", "textarea"), 1.0).otherwise(0.0)
    x = x.withColumn("score", F.round(1.0 + interactive + inter / union + 0.000001, 9)).withColumn("eid", X.blank(F.col("element_id")))
    w = W.partitionBy("task_id", "pos").orderBy(F.desc("score"), "eid", "index")
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("task_id", "pos", "index", "score", "rank")


# fixed values: names of an element's id, and of its box
ID_KEYS = "element_id backend_node_id node_id uid id candidate_id ref".split()
BOX_KEYS = "bbox bounding_box rect".split()


def centre(candidate: Column) -> Column:
    """struct<x, y>: the centre of the box of an element (a variant), its own or that of ``raw_candidate``; null without one.

    A box is an object of x, y (or left, top), width and height (w, h), an
    object with ``center``, or a list: two corners where the second is not
    before the first, else corner and size.
    """
    get = lambda path, kind: F.try_variant_get(candidate, path, kind)
    boxes = [f"$.{k}" for k in BOX_KEYS] + [f"$.raw_candidate.{k}" for k in BOX_KEYS]

    def of(b: str) -> Column:
        x, y = F.coalesce(get(f"{b}.x", "double"), get(f"{b}.left", "double")), F.coalesce(get(f"{b}.y", "double"), get(f"{b}.top", "double"))
        w, h = F.coalesce(get(f"{b}.width", "double"), get(f"{b}.w", "double")), F.coalesce(get(f"{b}.height", "double"), get(f"{b}.h", "double"))
        whole = x.isNotNull() & y.isNotNull() & w.isNotNull() & h.isNotNull()
        cx, cy = get(f"{b}.center[0]", "double"), get(f"{b}.center[1]", "double")
        p = [get(f"{b}[{i}]", "double") for i in range(4)]
        corners = (p[2] >= p[0]) & (p[3] >= p[1])
        four = p[3].isNotNull() & p[0].isNotNull() & p[1].isNotNull() & p[2].isNotNull()
        at = lambda a, c: F.struct(a.alias("x"), c.alias("y"))
        return (
            F.when(whole, at(x + w / 2, y + h / 2)).when(cx.isNotNull() & cy.isNotNull(), at(cx, cy))
            .when(four & corners, at((p[0] + p[2]) / 2, (p[1] + p[3]) / 2)).when(four, at(p[0] + p[2] / 2, p[1] + p[3] / 2))
        )

    return F.coalesce(*[of(b) for b in boxes])


def identifier(candidate: Column) -> Column:
    """The id of an element (a variant) under its first name that is neither null nor empty, its own before those of ``raw_candidate``."""
    names = [f"$.{k}" for k in ID_KEYS] + [f"$.raw_candidate.{k}" for k in ID_KEYS[1:]]
    return F.coalesce(*[F.nullif(F.try_variant_get(candidate, n, "string"), F.lit("")) for n in names])


def by_coordinates(op: Column, at: Column, argument: Column) -> Column:
    """An action in the dialect of coordinates; a stop without any."""
    o, x, y = F.lower(op), F.format_string("%.1f", at["x"]), F.format_string("%.1f", at["y"])
    name = F.when(o.isin("type", "input", "fill"), "type").otherwise(o)
    text = F.when(name == "type", F.concat(F.lit(" ["), X.blank(argument), F.lit("]"))).otherwise("")
    return F.when(at.isNull(), "stop").otherwise(F.concat(name, F.lit(" ["), x, F.lit("] ["), y, F.lit("]"), text))


def resolved(outputs: DataFrame) -> DataFrame:
    """``outputs`` (op, target, argument, candidates: array of variants) with the first candidate of that id, its place and the action in three dialects.

    The id of a target that no candidate has stands as it is; a null target has none.
    """
    hit = F.get(F.filter("candidates", lambda c: identifier(c) == F.col("target")), F.lit(0))
    x = outputs.withColumn("_hit", hit).withColumn("at", centre(F.col("_hit"))).withColumn("found", F.col("_hit").isNotNull())
    dialects = serialized(F.col("op"), F.col("target"), F.col("argument"))
    return x.withColumns({**dialects, "coordinates": by_coordinates(F.col("op"), F.col("at"), F.col("argument"))}).drop("_hit", "candidates")
