"""Online memory over all three levels: episodes of a domain in order, merged node by node into what was kept before.

An episode brings the intent, stages and actions that ``construct`` makes of
its steps.  When it passes the gate, an intent, stage or action that is near
to a kept one (below the same kept parent) is that one, and its children go
below it; the others are added.  Beyond ``max_intents`` the oldest intents
leave with all that is below them, but for protected ones.  ``merge`` is the
update; ``replayed`` runs it over a table and ``stream`` as a stateful operator.
The order within a domain is a recurrence, so a domain is one task; its state
is bounded by ``max_intents``, and a row holds the nodes of one episode.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as X
from ..operators import construct as C
from ..operators import episodes as E
from ..operators.maintenance import SIMILARITY_WEIGHTS, canonical_operation
from ..operators.nested import _variant, json_steps
from ..session import cut, table
from .online import DUPLICATE, DUPLICATE_COST, LEAST_QUALITY, MAX_INTENTS, PROBLEM, QUALITY, similarity

TRACE = (
    "domain string, stream_index long, task_id string, inserted boolean, reason string, quality double, duplicate_of string, new_intents int,"
    " new_stages int, new_actions int, known_stages int, known_actions int, evicted int, intents int, stages int, actions int"
)
NAMES = [c.split()[0] for c in TRACE.split(",")]
NODE = "domain string, level string, node_id string, parent_id string"
WEIGHTS = list(SIMILARITY_WEIGHTS.values())


def alike(a: list[list[str]], b: list[list[str]]) -> float:
    """Weighted overlap of the fields (token lists, the role first) that both descriptors fill; 0 without one."""
    total = weights = 0.0
    for i, w in enumerate(WEIGHTS):
        x, y = set(a[i]), set(b[i])
        if x and y:
            total += w * (float(x == y) if i == 0 else len(x & y) / len(x | y))
            weights += w
    return total / weights if weights else 0.0


class Memory:
    """The kept nodes of one domain, in order of insertion."""

    def __init__(self, state: dict | None = None) -> None:
        s = state or {"intents": [], "stages": [], "actions": []}
        self.intents = [(i, frozenset(t)) for i, t in s["intents"]]
        self.stages = [(i, p, frozenset(t)) for i, p, t in s["stages"]]
        self.actions = [tuple(a) for a in s["actions"]]  # id, parent, operation, argument, fields

    def state(self) -> dict:
        return {"intents": [(i, sorted(t)) for i, t in self.intents], "stages": [(i, p, sorted(t)) for i, p, t in self.stages], "actions": self.actions}

    def intent(self, tokens: frozenset) -> str | None:
        return next((i for i, t in self.intents if similarity(tokens, t) >= DUPLICATE), None)

    def add(self, r: dict, known: str | None) -> tuple[int, int, int, int, int]:
        """Takes in the nodes of an episode: new intents, stages and actions, known stages and actions."""
        n = [0, 0, 0, 0, 0]
        parent = known or r["intent_id"]
        if known is None:
            self.intents.append((r["intent_id"], frozenset(r["tokens"])))
            n[0] = 1
        at: dict[str, str] = {}
        for s in r["nodes"]:
            own = frozenset(s["tokens"])
            same = next((i for i, p, t in self.stages if p == parent and similarity(own, t) >= DUPLICATE), None)
            at[s["stage_id"]] = same or s["stage_id"]
            if same is None:
                self.stages.append((s["stage_id"], parent, own))
            n[1 if same is None else 3] += 1
            for a in s["actions"]:
                below, op, arg, fields = at[s["stage_id"]], a["op"], a["argument"] or "", [list(f) for f in a["fields"]]
                dup = any(p == below and o == op and g == arg and alike(fields, f) >= DUPLICATE for _, p, o, g, f in self.actions)
                if not dup:
                    self.actions.append((a["action_id"], below, op, arg, fields))
                n[4 if dup else 2] += 1
        return tuple(n)

    def evict(self, most: int, protected: frozenset) -> int:
        """Removes the oldest intents beyond ``most``, with their stages and these stages' actions."""
        over = len(self.intents) - most
        gone = {i for i in [i for i, _ in self.intents if i not in protected][: max(0, over)]}
        if gone:
            stages = {i for i, p, _ in self.stages if p in gone}
            self.intents = [x for x in self.intents if x[0] not in gone]
            self.stages = [x for x in self.stages if x[0] not in stages]
            self.actions = [x for x in self.actions if x[1] not in stages]
        return len(gone)


def merge(memory: Memory, rows: list[dict], max_intents: int = MAX_INTENTS, protected: frozenset = frozenset()) -> list[tuple]:
    """Updates ``memory`` by episodes in order; a trace row for each."""
    out = []
    for r in rows:
        dup, q, n, evicted = None, 0.0, (0, 0, 0, 0, 0), 0
        actions = [a for s in r["nodes"] for a in s["actions"]]
        if not r["success"]:
            reason = "failed"
        elif not actions:
            reason = "empty"
        else:
            dup = memory.intent(frozenset(r["tokens"]))
            transfer = sum(max(0.0, 1.0 - PROBLEM * a["problems"]) for a in actions) / len(actions)
            q = QUALITY["intent"] + QUALITY["stages"] + QUALITY["actions"] + QUALITY["transfer"] * transfer - DUPLICATE_COST * (dup is not None)
            q = round(max(0.0, min(1.0, q)), 9)
            if q < LEAST_QUALITY:
                reason = "low quality"
            elif dup is not None and q < LEAST_QUALITY + 0.20:
                reason = "near duplicate"
            else:
                reason = "merged" if dup is not None else "inserted"
                n = memory.add(r, dup)
                evicted = memory.evict(max_intents, protected)
        sizes = (len(memory.intents), len(memory.stages), len(memory.actions))
        out.append((r["domain"], int(r["stream_index"]), r["task_id"], reason in ("merged", "inserted"), reason, q, dup, *n, evicted, *sizes))
    return out


def trace_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(steps, traces): the steps of the first arrivals of traces in the form of ``episodes.steps``, and the traces with their place in the stream."""
    late = F.lit("9999-12-31").cast("timestamp_ntz")
    t = table(spark, sf_dir, "episode_traces").where(F.col("task_id").isNotNull())
    first = F.min(F.struct(F.coalesce("loaded_at", late).alias("at"), "domain", "instruction", "success", "trajectory")).alias("r")
    t = cut(t.groupBy("task_id").agg(first).select("task_id", "r.*"))
    w = W.partitionBy("domain").orderBy("at", "task_id")
    traces = t.select(F.coalesce("domain", F.lit("unknown")).alias("domain"), "task_id", "instruction", F.coalesce("success", F.lit(False)).alias("success"), "at")
    traces = traces.withColumn("stream_index", F.row_number().over(w).cast("long")).drop("at")
    get = lambda p: _variant("step", p, "string")
    one = lambda k: F.coalesce(get(f"$.target.{k}"), get(f"$.target[0].{k}"))
    s = t.select("task_id", F.explode(json_steps(F.col("trajectory"))).alias("s")).select("task_id", F.col("s.pos").alias("pos"), F.col("s.step").alias("step"))
    s = s.where(_variant("step", "$", "map<string,variant>").isNotNull())
    s = s.withColumn("pos", F.row_number().over(W.partitionBy("task_id").orderBy("pos")) - 1)
    element = F.struct(one("parent_context").alias("parent_context"), one("sibling_context").alias("sibling_text"))
    rows = s.select(
        "task_id", "pos", X.blank(F.coalesce(get("$.operation"), get("$.action"))).alias("operation"), get("$.argument").alias("argument"), get("$.observation.url").alias("url"),
        get("$.action_text").alias("action_repr"), X.collapse(one("label_or_text")).alias("label"), X.normal_key(one("role")).alias("role"), F.array(element).alias("pos_candidates"),
    )
    return rows, traces


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """domain, stream_index, task_id, success, intent_id, tokens and nodes (stages with their actions) of every trace."""
    rows, traces = trace_rows(spark, sf_dir)
    i, s, a = C.built(rows, traces.select("task_id", "instruction"))
    tokens = lambda c: F.array_except(c, F.array(F.lit("")))
    fields = ["label_or_text", None, "element_purpose", "parent", "section", None, "slot"]
    texts = F.array(F.array_compact(F.array(F.nullif("role", F.lit("")))), *[X.word_tokens(F.col(f)) if f else F.array().cast("array<string>") for f in fields])
    op = canonical_operation(F.col("operation"))
    problems = F.when(op.isin("click", "type", "select") & (F.col("role") == "generic"), 1).otherwise(0) + F.when((op == "type") & (F.length(X.blank(F.col("argument_template"))) == 0), 1).otherwise(0)
    one = F.struct("step_index", "action_id", F.col("operation").alias("op"), F.col("argument_template").alias("argument"), texts.alias("fields"), problems.alias("problems"))
    per = a.groupBy("stage_id").agg(F.sort_array(F.collect_list(F.struct("step_index", "action_id"))).alias("_order"), F.collect_list(one).alias("actions"))
    stage = F.concat_ws(" ", "name", F.concat_ws(" ", "pre_conditions"), F.concat_ws(" ", "post_conditions"))
    s = s.withColumn("tokens", tokens(X.space_tokens(stage))).join(per.drop("_order"), "stage_id")
    nodes = s.groupBy("task_id").agg(F.collect_list(F.struct("stage", "stage_id", "tokens", "actions")).alias("nodes"))
    text = F.concat_ws(" ", "canonical_intent", "domain_hint", F.concat_ws(" ", F.transform("constraints", lambda c: F.replace(c, F.lit("="), F.lit(":")))))
    i = i.select("task_id", "intent_id", tokens(X.space_tokens(text)).alias("tokens"))
    return traces.drop("instruction").join(i, "task_id").join(nodes, "task_id", "left")


def _rows(pdf: pd.DataFrame) -> list[dict]:
    """Episodes of a domain in order, with stages and actions in order too."""
    rows = pdf.sort_values("stream_index").to_dict("records")
    for r in rows:
        nodes = r["nodes"] if r["nodes"] is not None else []
        r["nodes"] = sorted(({**s, "actions": sorted(s["actions"], key=lambda a: a["step_index"])} for s in nodes), key=lambda s: s["stage"])
    return rows


def replayed(rows: DataFrame, max_intents: int = MAX_INTENTS) -> DataFrame:
    """Trace of every episode (``episodes``): one ordered update a domain."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(merge(Memory(), _rows(pdf), max_intents), columns=NAMES)

    return rows.groupBy("domain").applyInPandas(run, TRACE)


def kept(rows: DataFrame, max_intents: int = MAX_INTENTS) -> DataFrame:
    """The nodes that are left of each domain once all episodes are taken in: domain, level, node_id, parent_id."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m, name = Memory(), pdf["domain"].iloc[0]
        merge(m, _rows(pdf), max_intents)
        out = [(name, "intent", i, None) for i, _ in m.intents] + [(name, "stage", i, p) for i, p, _ in m.stages] + [(name, "action", a[0], a[1]) for a in m.actions]
        return pd.DataFrame(out, columns=["domain", "level", "node_id", "parent_id"])

    return rows.groupBy("domain").applyInPandas(run, NODE)


def stream(rows: DataFrame, max_intents: int = MAX_INTENTS) -> DataFrame:
    """The same over a stream of ``episodes``; a row of task_id ``reset`` empties the memory of its domain."""

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory = Memory(json.loads(state.get[0]) if state.exists else None)
        out = []
        for r in _rows(pd.concat(list(pdfs))):
            if r["task_id"] == "reset":
                memory = Memory()
            else:
                out += merge(memory, [r], max_intents)
        state.update((json.dumps(memory.state()),))
        yield pd.DataFrame(out, columns=NAMES)

    return rows.groupBy("domain").applyInPandasWithState(run, TRACE, "state string", "append", GroupStateTimeout.NoTimeout)


def save(trace: DataFrame, memory: DataFrame, folder: str) -> None:
    """Trace, failed episodes, metrics and what is kept, a folder a domain each."""
    trace = cut(trace)
    trace.write.mode("overwrite").partitionBy("domain").json(f"{folder}/online_memory_trace")
    trace.where("reason = 'failed'").write.mode("overwrite").partitionBy("domain").json(f"{folder}/failed_traces")
    ok = F.col("reason") != "failed"
    metrics = trace.groupBy("domain").agg(F.count("*").alias("num_tasks"), F.sum(ok.cast("int")).alias("success_count"), F.sum(F.col("inserted").cast("int")).alias("inserted"))
    metrics.write.mode("overwrite").json(f"{folder}/metrics")
    memory.write.mode("overwrite").partitionBy("domain").json(f"{folder}/memory")
