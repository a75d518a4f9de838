"""Online memory: a stream of finished episodes a domain, kept when they succeeded, pass the gate and are new.

``fold`` is the update of one domain's state by episodes in order.  The batch
form (``replayed``) runs it over a table; the streaming form (``stream``) runs the same
function as a stateful operator, so both give the same trace.  State is
bounded by ``max_intents`` a domain (first in, first out, protected ids stay).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import table

# fixed values: parts of the quality score and thresholds
QUALITY = {"intent": 0.20, "stages": 0.25, "actions": 0.25, "transfer": 0.30}
PROBLEM, DUPLICATE_COST = 0.18, 0.15
LEAST_QUALITY, DUPLICATE, MAX_INTENTS = 0.45, 0.92, 500
TRACE = "domain string, stream_index long, task_id string, inserted boolean, reason string, quality double, duplicate_of string, before int, after int, evicted int"
NAMES = [c.split()[0] for c in TRACE.split(", ")]


def words(text: str | None) -> frozenset[str]:
    return frozenset((text or "").lower().split())


def similarity(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def quality(n_steps: int, problems: int, duplicate: bool) -> float:
    """Score of an episode: its parts, less for problems a step and for a near duplicate."""
    if not n_steps:
        return 0.0
    q = QUALITY["intent"] + QUALITY["stages"] + QUALITY["actions"] + QUALITY["transfer"] * max(0.0, 1.0 - PROBLEM * problems / n_steps)
    return round(max(0.0, min(1.0, q - DUPLICATE_COST * duplicate)), 9)


def fold(state: list[list[str]], rows: list[dict], max_intents: int = MAX_INTENTS, protected: frozenset = frozenset()) -> list[tuple]:
    """Updates ``state`` ([id, text] in order of insertion) by episodes in order; returns a trace row for each."""
    out = []
    sets = [words(t) for _, t in state]
    for r in rows:
        before, dup, reason, q, evicted, own = len(state), None, "", 0.0, 0, words(r["instruction"])
        if not r["success"]:
            reason = "failed"
        elif not r["n_steps"]:
            reason = "empty"
        else:
            dup = next((i for (i, _), s in zip(state, sets, strict=True) if similarity(own, s) >= DUPLICATE), None)
            q = quality(int(r["n_steps"]), int(r["problems"]), dup is not None)
            if q < LEAST_QUALITY:
                reason = "low quality"
            elif dup is not None and q < LEAST_QUALITY + 0.20:
                reason = "near duplicate"
            else:
                reason = "merged" if dup is not None else "inserted"
                if dup is None:
                    state.append([r["task_id"], r["instruction"] or ""])
                    sets.append(own)
                over = len(state) - max_intents
                for k in [k for k, (i, _) in enumerate(state) if i not in protected][: max(0, over)][::-1]:
                    del state[k], sets[k]
                    evicted += 1
        out.append((r["domain"], int(r["stream_index"]), r["task_id"], reason in ("merged", "inserted"), reason, q, dup, before, len(state), evicted))
    return out


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First arrivals of traces in stream order: domain, stream_index, task_id, instruction, success, n_steps, problems.

    A problem is a step without a target role, or one that types without an argument.
    """
    from ..operators.nested import json_steps

    at = F.coalesce("loaded_at", F.lit("9999-12-31").cast("timestamp_ntz"))
    t = table(spark, sf_dir, "episode_traces").where(F.col("task_id").isNotNull())
    t = t.groupBy("task_id").agg(F.min(F.struct(at.alias("at"), "domain", "instruction", "success", "trajectory")).alias("r")).select("task_id", "r.*")
    get = lambda s, p: F.try_variant_get(s, p, "string")
    steps = F.coalesce(json_steps(F.col("trajectory")), F.array())
    bad = F.filter(steps, lambda s: F.coalesce(get(s["step"], "$.target.role"), get(s["step"], "$.target[0].role")).isNull() | ((F.coalesce(get(s["step"], "$.operation"), get(s["step"], "$.action")) == "type") & get(s["step"], "$.argument").isNull()))
    t = t.select(F.coalesce("domain", F.lit("unknown")).alias("domain"), "at", "task_id", "instruction", F.coalesce("success", F.lit(False)).alias("success"), F.size(steps).alias("n_steps"), F.size(bad).alias("problems"))
    w = W.partitionBy("domain").orderBy("at", "task_id")
    return t.withColumn("stream_index", F.row_number().over(w).cast("long")).drop("at")


def replayed(rows: DataFrame, max_intents: int = MAX_INTENTS) -> DataFrame:
    """Trace of every episode: one ordered fold a domain, as the recurrence demands; rows carry no trajectories."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values("stream_index").to_dict("records")
        return pd.DataFrame(fold([], ordered, max_intents), columns=NAMES)

    return rows.groupBy("domain").applyInPandas(run, TRACE)


def stream(rows: DataFrame, max_intents: int = MAX_INTENTS) -> DataFrame:
    """The same over a stream of ``rows``: state a domain as JSON; rows of a micro-batch are sorted, order across batches is that of arrival."""

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else []
        rows = pd.concat(list(pdfs)).sort_values("stream_index").to_dict("records")
        out = fold(kept, rows, max_intents)
        state.update((json.dumps(kept),))
        yield pd.DataFrame(out, columns=NAMES)

    return rows.groupBy("domain").applyInPandasWithState(run, TRACE, "state string", "append", GroupStateTimeout.NoTimeout)


def prefix_counts(rows: DataFrame) -> DataFrame:
    """Episodes that succeeded before each position of a domain's stream, and a check that none comes from later.

    Sums run by blocks of 1000 positions first, so one large domain is not one task.
    """
    b = rows.withColumn("block", F.floor((F.col("stream_index") - 1) / 1000)).withColumn("s", F.col("success").cast("int"))
    sums = b.groupBy("domain", "block").agg(F.sum("s").alias("t"))
    sums = sums.withColumn("base", F.coalesce(F.sum("t").over(W.partitionBy("domain").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("t")
    w = W.partitionBy("domain", "block").orderBy("stream_index").rowsBetween(W.unboundedPreceding, -1)
    out = b.withColumn("within", F.coalesce(F.sum("s").over(w), F.lit(0))).join(sums, ["domain", "block"])
    n = F.col("base") + F.col("within")
    return out.select("domain", "stream_index", "task_id", n.alias("before"), (n + F.col("s")).alias("after"), (n < F.col("stream_index")).alias("no_leak"))


def event_windows(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events by type in tumbling windows with a watermark; works on a table and on a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


def gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes by domain and outcome of the insertion gate."""
    return replayed(episodes(spark, sf_dir)).groupBy("domain", "reason").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("quality"))

