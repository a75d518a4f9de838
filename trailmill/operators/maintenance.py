"""Inspection and cleaning of memory: statistics, issues, near duplicates, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import cut
from . import memory

# fixed values: thresholds and field weights
INTENT_SIMILARITY, STAGE_SIMILARITY, ACTION_SIMILARITY = 0.93, 0.90, 0.92
MAX_ACTIONS, MIN_FIELDS = 50, 2
SIMILARITY_WEIGHTS = {
    "role": 0.12, "label_or_text": 0.20, "accessible_name": 0.18, "element_purpose": 0.12,
    "parent_context": 0.12, "form_section": 0.10, "nearby_text": 0.08, "field_slot": 0.08,
}
GROUNDING_FIELDS = ("label_or_text", "accessible_name", "element_purpose", "parent_context", "form_section", "field_slot", "nearby_text")
EVIDENCE_FIELDS = ("label_or_text", "accessible_name", "element_purpose", "parent_context", "field_slot")


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, key, n: counts of nodes, operations, domains and datasets, and average children of parents that have any."""
    i, s, a = (memory.live(spark, sf_dir, n) for n in ("intents", "stages", "actions"))
    row = lambda df, name, key: df.groupBy(key.alias("key")).agg(F.count("*").cast("double").alias("n")).select(F.lit(name).alias("name"), "key", "n")
    all_ = F.lit("")
    average = lambda df, name, parent: df.where(F.col(parent).isNotNull()).groupBy(parent).count().agg(F.round(F.avg("count"), 9).alias("n")).select(F.lit(name).alias("name"), F.lit("").alias("key"), "n")
    sources = [x.select(F.col("source.dataset").alias("d")) for x in (i, s, a)]
    parts = [
        row(i, "intents", all_), row(s, "stages", all_), row(a, "actions", all_),
        row(a, "operation", X.blank(F.col("operation"))), row(i, "domain", X.blank(F.col("domain_hint"))),
        row(sources[0].unionByName(sources[1]).unionByName(sources[2]).where(F.col("d").isNotNull()), "dataset", F.col("d")),
        average(s, "stages_per_intent", "parent_intent_id"), average(a, "actions_per_stage", "parent_stage_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def filled(c: Column) -> Column:
    return F.coalesce(F.length(c) > 0, F.lit(False))


def descriptor_problems(operation: Column, argument: Column, get) -> Column:  # noqa: ANN001
    """What keeps an action pattern from being carried over to another page; ``get(field)`` is a text column."""
    op = canonical_operation(operation)
    evidence = filled(get(EVIDENCE_FIELDS[0]))
    for f in EVIDENCE_FIELDS[1:]:
        evidence = evidence | filled(get(f))
    grounded = op.isin("click", "type", "select")
    return F.array_compact(
        F.array(
            F.when(grounded & ~filled(get("role")), "role is missing"),
            F.when(grounded & ~evidence, "no transferable grounding evidence"),
            F.when(F.coalesce(operation == "type", F.lit(False)) & ~filled(argument), "type action has no argument template"),
        )
    )


# fixed values: names of operations
OPERATIONS = {
    "click": "click press tap select choose open submit check uncheck".split(),
    "type": "type input fill enter write set_value send_keys".split(),
    "select": "select choose_option dropdown pick".split(),
    "hover": "hover move".split(),
    "scroll": ["scroll"],
    "stop": "stop finish answer done".split(),
}


def canonical_operation(c: Column) -> Column:
    """One of the canonical operations by name or word, else by part, else as it is; empty is a click."""
    op = X.normal_key(c)
    tokens = F.split(op, " ")
    out = None
    for name, aliases in OPERATIONS.items():
        hit = F.arrays_overlap(tokens, F.array(*[F.lit(a) for a in aliases]))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    out = out.when(X.contains_any(op, ["click", "press"]), "click").when(X.contains_any(op, ["type", "fill", "input"]), "type")
    return out.when(X.contains_any(op, ["select", "option"]), "select").when(op == "", "click").otherwise(op)


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """severity, record_type, record_id, message of every rule that a live record breaks."""
    i, s, a = (memory.live(spark, sf_dir, n) for n in ("intents", "stages", "actions"))
    issue = lambda df, sev, kind, key, msg: df.select(F.lit(sev).alias("severity"), F.lit(kind).alias("record_type"), F.col(key).alias("record_id"), F.lit(msg).alias("message"))
    rules = lambda df, kind, key, *rs: df.select(F.col(key).alias("record_id"), F.explode(F.array_compact(F.array(*[F.when(w, F.struct(F.lit(sev).alias("severity"), F.lit(msg).alias("message"))) for sev, msg, w in rs]))).alias("x")).select("x.severity", F.lit(kind).alias("record_type"), "record_id", "x.message")
    few = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0)) < 1
    d = lambda f: F.col(f"semantic_description.{f}")
    grounding = sum((filled(d(f)).cast("int") for f in GROUNDING_FIELDS[1:]), filled(d(GROUNDING_FIELDS[0])).cast("int"))
    problems = a.select("action_id", F.explode(descriptor_problems(F.col("operation"), F.col("argument_template"), d)).alias("m"))
    many = a.where(F.col("parent_stage_id").isNotNull()).groupBy("parent_stage_id").count().where(F.col("count") > MAX_ACTIONS)
    parts = [
        issue(s.join(i, s.parent_intent_id == i.intent_id, "left_anti"), "error", "stage", "stage_id", "missing parent intent"),
        issue(a.join(s, a.parent_stage_id == s.stage_id, "left_anti"), "error", "action", "action_id", "missing parent stage"),
        rules(s, "stage", "stage_id", ("warning", "too few pre-conditions", few("pre_conditions")), ("warning", "too few post-conditions", few("post_conditions")), ("error", "empty stage name", X.collapse(F.col("name")) == "")),
        problems.select(F.lit("warning").alias("severity"), F.lit("action").alias("record_type"), F.col("action_id").alias("record_id"), F.col("m").alias("message")),
        rules(a, "action", "action_id", ("warning", "semantic descriptor has few grounding fields", grounding < MIN_FIELDS)),
        issue(many, "warning", "stage", "parent_stage_id", "stage has many action nodes"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def similar_pairs(items: DataFrame, threshold: float, block: list[str]) -> DataFrame:
    """id_a < id_b and score of items (id, tokens, block columns) with Jaccard >= ``threshold`` within a block.

    Items with equal token sets are grouped first and only representatives are
    compared.  Of each set, its rarest tokens look for partners: sets of n
    tokens this similar share one of their rarest ``n - ceil(threshold * n) + 1``
    tokens, so nothing is lost and common tokens emit nothing.  The result has
    the pairs between representatives; ``members`` names the groups.
    """
    df = items.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    ranked = items.select("id", *block, F.size("tokens").alias("n"), F.explode("tokens").alias("t")).join(df, "t")
    ranked = ranked.groupBy("id", "n", *block).agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("g"))
    prefix = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1
    probe = cut(ranked.select("id", "n", *block, F.explode(F.slice("g", 1, prefix)).alias("g")).select("id", "n", *block, "g.t"))
    a, b = probe, probe.select(F.col("id").alias("id_b"), F.col("n").alias("n_b"), *block, "t")
    fits = (F.col("id") < F.col("id_b")) & (F.least("n", "n_b") >= threshold * F.greatest("n", "n_b") - 1e-9)
    pairs = a.join(b, [*block, "t"]).where(fits).select(F.col("id").alias("id_a"), "id_b").distinct()
    left, right = items.select(F.col("id").alias("id_a"), F.col("tokens").alias("ta")), items.select(F.col("id").alias("id_b"), F.col("tokens").alias("tb"))
    out = pairs.join(left, "id_a").join(right, "id_b").withColumn("score", X.jaccard(F.col("ta"), F.col("tb")))
    return out.where(F.col("score") >= threshold).select("id_a", "id_b", F.round("score", 9).alias("score"))


def grouped(items: DataFrame, block: list[str]) -> tuple[DataFrame, DataFrame]:
    """Items with a sorted token set, one a block and set, and the members (id, rep)."""
    rows = items.withColumn("tokens", F.array_sort("tokens")).where(F.size("tokens") > 0).withColumn("h", F.xxhash64("tokens"))
    reps = rows.groupBy("tokens", "h", *block).agg(F.min("id").alias("rep"))
    key = ["h", "tokens", *block]
    members = rows.join(reps, key).select("id", "rep")
    return reps.select(F.col("rep").alias("id"), "tokens", *block), members


def intent_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat_ws(" ", X.blank(F.col("canonical_intent")), X.blank(F.col("domain_hint")), memory.constraints_text(F.col("constraints"), ":"))
    return memory.live(spark, sf_dir, "intents").select(F.col("intent_id").alias("id"), X.space_tokens(t).alias("tokens"))


def near_dup_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of near-duplicate intents, between representatives of equal token sets."""
    reps, _ = grouped(intent_items(spark, sf_dir), [])
    return similar_pairs(cut(reps), INTENT_SIMILARITY, [])


def near_dup_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every intent with its class (least id of equal token sets) and the class's number of near-duplicate classes."""
    reps, members = grouped(intent_items(spark, sf_dir), [])
    p = similar_pairs(cut(reps), INTENT_SIMILARITY, [])
    links = p.select(F.col("id_a").alias("rep")).unionByName(p.select(F.col("id_b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
    return members.join(links, "rep", "left").select(F.col("id").alias("intent_id"), F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def near_dup_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of near-duplicate stages of one parent, between representatives of equal token sets."""
    t = memory.stage_text()
    rows = memory.live(spark, sf_dir, "stages").where(F.col("parent_intent_id").isNotNull())
    reps, _ = grouped(rows.select(F.col("stage_id").alias("id"), F.col("parent_intent_id").alias("parent"), X.space_tokens(t).alias("tokens")), ["parent"])
    return similar_pairs(cut(reps), STAGE_SIMILARITY, ["parent"])


def descriptor_similarity(get_a, get_b, whole_a: Column, whole_b: Column) -> Column:  # noqa: ANN001
    """Weighted overlap of the fields that both descriptors fill; overlap of the whole texts if none is."""
    total, weights = F.lit(0.0), F.lit(0.0)
    for field, weight in SIMILARITY_WEIGHTS.items():
        a, b = get_a(field), get_b(field)
        both = filled(a) & filled(b)
        score = (X.normal_key(a) == X.normal_key(b)).cast("double") if field == "role" else X.jaccard(X.word_tokens(a), X.word_tokens(b))
        total = total + F.when(both, weight * score).otherwise(0.0)
        weights = weights + F.when(both, weight).otherwise(0.0)
    return F.when(weights > 0, total / weights).otherwise(X.jaccard(X.word_tokens(whole_a), X.word_tokens(whole_b)))


def near_dup_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of actions of one stage and operation with similar descriptors; equal descriptors are grouped first."""
    names = list(SIMILARITY_WEIGHTS)
    a = memory.live(spark, sf_dir, "actions").where(F.col("parent_stage_id").isNotNull())
    a = a.select("action_id", "parent_stage_id", X.blank(F.col("operation")).alias("operation"), *[F.col(f"semantic_description.{n}").alias(n) for n in names], memory.descriptor_text().alias("whole"))
    reps = a.groupBy("parent_stage_id", "operation", "whole", *names).agg(F.min("action_id").alias("id"))
    return descriptor_pairs(reps, ["parent_stage_id", "operation"])


def descriptor_pairs(reps: DataFrame, block: list[str]) -> DataFrame:
    """id_a < id_b and score of descriptors (id, ``block``, the weighted fields, whole) of a block with ``descriptor_similarity`` >= ``ACTION_SIMILARITY``.

    No pair is lost and none is met by chance.  Which fields count for a pair
    follows from the fields that each fills (its pattern).  Where the mean of the
    fields in common is 0.92, those below 0.8 have less than 0.4 of their weight;
    so of two descriptors the first looks for the second, pattern by pattern,
    by its fields with the rarest tokens only, until they have 0.4 of the
    weight, and by the rarest tokens of each of these, one of which sets that
    are alike to 0.8 share.  Patterns with only the role in common meet by equal roles, patterns
    with nothing in common by the whole text.
    """
    names = [*[n for n in SIMILARITY_WEIGHTS if n != "role"], "role"]
    role, whole = len(names) - 1, len(names)
    least = lambda f: F.when(f == whole, ACTION_SIMILARITY).when(f == role, 1.0).otherwise(0.8)
    total = lambda xs: sum(xs[1:], xs[0])
    reps = reps.withColumns({"pattern": total([F.when(filled(F.col(n)), 1 << i).otherwise(0) for i, n in enumerate(names)]), "_b": F.xxhash64(*block)})
    # the patterns of a block, at most 2^8; a descriptor alone in its block has no partner
    patterns = reps.groupBy("_b").agg(F.collect_set("pattern").alias("patterns"), F.count("*").alias("size")).where(F.col("size") > 1).drop("size")
    reps = cut(reps.join(patterns, "_b"))
    meets = lambda mask: F.exists("patterns", lambda q: F.col("pattern").bitwiseAND(q) == mask)
    none = F.array().cast("array<string>")
    # blocks, fields and tokens travel as numbers; what is found is scored on the texts
    sets = [X.word_tokens(F.col(n)) for n in names[:-1]] + [F.when(meets(1 << role), F.array(X.normal_key(F.col("role")))).otherwise(none), F.when(meets(0), X.word_tokens(F.col("whole"))).otherwise(none)]
    fields = F.array(*[F.struct(F.lit(i).cast("tinyint").alias("f"), F.transform(t, lambda x: F.xxhash64(x)).alias("t")) for i, t in enumerate(sets)])
    rows = reps.select("id", "_b", "pattern", F.explode(fields).alias("x")).select("id", "_b", "pattern", "x.f", F.size("x.t").alias("n"), F.explode("x.t").alias("t"))
    df = rows.groupBy("_b", "f", "t").agg(F.count("*").alias("df"))
    ranked = rows.join(df, ["_b", "f", "t"]).groupBy("id", "_b", "pattern", "f", "n").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("g"))
    prefix = F.slice("g", 1, F.col("n") - F.ceil(F.col("n") * least(F.col("f")) - 1e-9).cast("int") + 1)
    ranked = cut(ranked.select("id", "_b", "pattern", "f", prefix.alias("g")))
    index = ranked.select("_b", "pattern", "f", F.explode("g.t").alias("t"), F.col("id").alias("id_b"))
    weight = F.array(*[F.lit(SIMILARITY_WEIGHTS[n]) for n in names])
    bits = F.array(*[F.lit(1 << i) for i in range(len(names))])
    cost = F.aggregate("g", F.lit(0).cast("long"), lambda s, x: s + x["df"])
    mine = ranked.groupBy("id", "_b", "pattern").agg(F.sort_array(F.collect_list(F.struct(cost.alias("cost"), "f", F.col("g.t").alias("t")))).alias("fields"))
    mine = mine.join(patterns, "_b").withColumn("q", F.explode("patterns")).withColumn("both", F.col("pattern").bitwiseAND(F.col("q")))
    mine = mine.withColumn("mass", total([F.when(F.col("both").bitwiseAND(F.lit(1 << i)) > 0, SIMILARITY_WEIGHTS[n]).otherwise(0.0) for i, n in enumerate(names)]))
    mine = mine.withColumn("usable", F.filter("fields", lambda x: (x["f"] < role) & (F.get(bits, x["f"].cast("int")).bitwiseAND(F.col("both")) > 0)))
    start = F.struct(F.filter("fields", lambda x: F.lit(False)).alias("take"), F.lit(0.0).alias("w"))
    # a field without tokens has no row here and adds no weight, as nothing is alike to it
    chosen = F.aggregate("usable", start, lambda s, x: F.when(s["w"] >= 0.4 * F.col("mass") - 1e-9, s).otherwise(F.struct(F.array_append(s["take"], x).alias("take"), (s["w"] + F.get(weight, x["f"].cast("int"))).alias("w"))))
    only = lambda i: F.filter("fields", lambda x: x["f"] == i)
    take = F.when(F.col("both") == 0, only(whole)).when(F.col("both") == 1 << role, only(role)).otherwise(chosen["take"])
    probe = mine.select("id", "_b", F.col("q").alias("pattern"), F.explode(take).alias("x")).select("id", "_b", "pattern", "x.f", F.explode("x.t").alias("t"))
    pairs = probe.join(index, ["_b", "pattern", "f", "t"]).where(F.col("id") < F.col("id_b")).select(F.col("id").alias("id_a"), "id_b").distinct()
    every = list(SIMILARITY_WEIGHTS)
    la = reps.select(F.col("id").alias("id_a"), *block, *[F.col(n).alias(f"a_{n}") for n in every], F.col("whole").alias("a_whole"))
    lb = reps.select(F.col("id").alias("id_b"), *block, *[F.col(n).alias(f"b_{n}") for n in every], F.col("whole").alias("b_whole"))
    out = pairs.join(la, "id_a").join(lb, ["id_b", *block])
    sim = descriptor_similarity(lambda f: F.col(f"a_{f}"), lambda f: F.col(f"b_{f}"), F.col("a_whole"), F.col("b_whole"))
    return out.withColumn("score", F.round(sim, 9)).where(F.col("score") >= ACTION_SIMILARITY).select("id_a", "id_b", "score")


def survivors(pairs: DataFrame) -> DataFrame:
    """id and kept: every id of a pair that merging in sorted order removes, with the smallest survivor it goes to.

    A node is removed iff a surviving smaller node matches it.  Each round
    settles the nodes whose smaller neighbours are all settled, at least one
    where any is open, so the rounds end.
    """
    state = cut(pairs.select(F.col("id_a").alias("id")).unionByName(pairs.select(F.col("id_b").alias("id"))).distinct().withColumn("alive", F.lit(None).cast("boolean")))
    while not state.where(F.col("alive").isNull()).isEmpty():
        below = pairs.join(state.select(F.col("id").alias("id_a"), F.col("alive").alias("a")), "id_a").groupBy(F.col("id_b").alias("id"))
        below = below.agg(F.max(F.coalesce("a", F.lit(False))).alias("beaten"), F.max(F.col("a").isNull()).alias("open"))
        new = state.join(below, "id", "left")
        settled = F.when(F.col("alive").isNotNull(), F.col("alive")).when(F.coalesce("beaten", F.lit(False)), False).when(~F.coalesce("open", F.lit(False)), True)
        state = cut(new.select("id", settled.alias("alive")))
    alive = state.where("alive").select(F.col("id").alias("id_a"))
    return pairs.join(alive, "id_a").groupBy(F.col("id_b").alias("id")).agg(F.min("id_a").alias("kept"))


def near_dup_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intents that merging removes, with the intent that takes over their stages, and how many stages move."""
    reps, members = grouped(intent_items(spark, sf_dir), [])
    gone = survivors(cut(similar_pairs(cut(reps), INTENT_SIMILARITY, [])))
    out = members.join(gone.withColumnRenamed("id", "rep"), "rep", "left").withColumn("kept", F.coalesce("kept", "rep")).where(F.col("kept") != F.col("id"))
    s = memory.live(spark, sf_dir, "stages").groupBy(F.col("parent_intent_id").alias("id")).agg(F.count("*").alias("moved"))
    return out.join(s, "id", "left").select(F.col("id").alias("removed"), "kept", F.coalesce("moved", F.lit(0)).alias("stages_moved"))


def inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``issues`` and one row of information for each near-duplicate pair: severity, record_type, record_id, message, other_id, score."""
    row = lambda df, kind: df.select(F.lit("info").alias("severity"), F.lit(kind).alias("record_type"), F.col("id_a").alias("record_id"), F.lit("near-duplicate record").alias("message"), F.col("id_b").alias("other_id"), "score")
    out = issues(spark, sf_dir).withColumns({"other_id": F.lit(None).cast("string"), "score": F.lit(None).cast("double")})
    for kind, pairs in (("intent", near_dup_intents), ("stage", near_dup_stages), ("action", near_dup_actions)):
        out = out.unionByName(row(pairs(spark, sf_dir), kind))
    return out


def remapped_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live stages whose intent goes when near duplicates are merged, with the intent that they move to."""
    gone = near_dup_merge(spark, sf_dir).select(F.col("removed").alias("old_parent"), F.col("kept").alias("new_parent"))
    return memory.live(spark, sf_dir, "stages").select("stage_id", F.col("parent_intent_id").alias("old_parent")).join(gone, "old_parent").select("stage_id", "old_parent", "new_parent")


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """level, before, orphans and merged: what a cleaning run starts with, drops as below no parent, and merges into a near duplicate.

    Stages of merged intents move to the kept ones; orphans go first, with all below them.
    """
    left = memory.cascade(spark, sf_dir)
    before = [memory.live(spark, sf_dir, n).agg(F.count("*").alias("before")).select(F.lit(n[:-1]).alias("level"), "before") for n in ("intents", "stages", "actions")]
    merged = near_dup_merge(spark, sf_dir).agg(F.count("*").alias("merged")).select(F.lit("intent").alias("level"), "merged")
    out = before[0].unionByName(before[1]).unionByName(before[2]).join(left, "level").join(merged, "level", "left")
    return out.select("level", "before", (F.col("before") - F.col("kept")).alias("orphans"), F.coalesce("merged", F.lit(0)).alias("merged"))
