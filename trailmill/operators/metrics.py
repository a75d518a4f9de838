"""Evaluation metrics: success rates with intervals, weighted means, step metrics, token F1, cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

Z = 1.96


def wilson(successes: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Score interval of a share; null without trials."""
    n = F.nullif(n, F.lit(0))
    p = successes / n
    denom = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / denom
    delta = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / denom
    return centre - delta, centre + delta


def success_rates(log: DataFrame) -> DataFrame:
    """method, domain, n, successes, rate, avg_steps of a task log, with one row a method over all domains (domain null).

    One shuffle: the total is a second level over the grouped rows.
    """
    per = log.groupBy("method", "domain").agg(F.count("*").alias("n"), F.sum(F.coalesce("success", F.lit(False)).cast("int")).alias("successes"), F.sum("num_steps").alias("steps"))
    total = per.groupBy("method").agg(F.sum("n").alias("n"), F.sum("successes").alias("successes"), F.sum("steps").alias("steps")).withColumn("domain", F.lit(None).cast("string"))
    both = per.unionByName(total)
    low, high = wilson(F.col("successes"), F.col("n"))
    pct = lambda c: F.round(100.0 * c, 6)
    return both.select("method", "domain", "n", "successes", pct(F.col("successes") / F.col("n")).alias("task_sr"), F.round(F.col("steps") / F.col("n"), 6).alias("avg_steps"), pct(low).alias("low"), pct(high).alias("high"))


def weighted(scores: DataFrame, counts: DataFrame) -> DataFrame:
    """Mean score a method, weighted by the counts of its domains; ``missing`` counts domains without a count."""
    x = scores.join(counts, "domain", "left")
    return x.groupBy("method").agg(
        F.round(F.sum(F.col("n") * F.col("score")) / F.nullif(F.sum("n"), F.lit(0)), 6).alias("weighted_sr"), F.sum(F.col("n").isNull().cast("int")).alias("missing")
    )


def table_recompute(scores: DataFrame, counts: DataFrame) -> DataFrame:
    """From rounded percentages: estimated successes and approximate interval a method."""
    x = scores.join(counts, "domain").groupBy("method").agg(F.bround(F.sum(F.col("n") * F.col("score") / 100.0), 0).cast("bigint").alias("successes"), F.sum("n").alias("n"))
    low, high = wilson(F.col("successes"), F.col("n"))
    return x.select("method", "successes", "n", F.round(100 * low, 4).alias("low"), F.round(100 * high, 4).alias("high"))


def token_f1(pred: Column, gold: Column) -> Column:
    """F1 of two multisets of words: both empty 1, one empty 0."""
    words = lambda c: F.regexp_extract_all(F.lower(X.blank(c)), F.lit("([a-z0-9_]+)"), F.lit(1))
    p, g = words(pred), words(gold)
    count = lambda a, t: F.size(F.filter(a, lambda x: x == t))
    common = F.aggregate(F.array_distinct(p), F.lit(0), lambda s, t: s + F.least(count(p, t), count(g, t)))
    precision, recall = common / F.size(p), common / F.size(g)
    return F.when((F.size(p) == 0) & (F.size(g) == 0), 1.0).when((F.size(p) == 0) | (F.size(g) == 0) | (common == 0), 0.0).otherwise(2 * precision * recall / (precision + recall))


def step_metrics_percent(rows: DataFrame) -> DataFrame:
    """Percentages over steps (element_ok, operation_ok, value_ok, f1) and over tasks whose steps are all right."""
    ok = F.col("element_ok") & F.col("operation_ok") & F.col("value_ok")
    per = rows.withColumn("ok", ok).groupBy("task_id").agg(
        F.count("*").alias("n"), F.min("ok").alias("all_ok"), *[F.sum(F.col(c).cast("double")).alias(c) for c in ("element_ok", "operation_ok", "value_ok", "ok", "f1")]
    )
    pct = lambda c: F.round(100.0 * F.sum(c) / F.sum("n"), 6)
    return per.agg(
        F.sum("n").alias("num_steps"), F.count("*").alias("num_tasks"), pct("element_ok").alias("element_accuracy"), pct("operation_ok").alias("operation_accuracy"),
        pct("value_ok").alias("value_accuracy"), pct("f1").alias("action_f1"), pct("ok").alias("step_success_rate"), F.round(100.0 * F.avg(F.col("all_ok").cast("int")), 6).alias("task_success_rate"),
    )


def construction_calls(stages: Column, steps: Column, repairs: Column) -> Column:
    """Model calls to build one episode."""
    return 2 + stages + steps + repairs


def cost_usd(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """Price a million tokens each way, eight places; null where a count is null."""
    return F.round(tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out, 8)


def step_metrics_records(rows: DataFrame) -> DataFrame:
    """Shares over steps and tasks of records (task_id, gold ids, pred id, operations, values), the F1 of a step being the mean of its three marks.

    Without gold elements a step is right without a prediction; a gold value
    that is null or empty asks for nothing; others count without outer spaces.
    """
    gold = F.coalesce("gold", F.array().cast("array<string>"))
    element = F.when(F.size(gold) > 0, F.coalesce(F.array_contains(gold, F.col("pred")), F.lit(False))).otherwise(F.col("pred").isNull())
    operation = F.lower(X.blank(F.col("operation_gold"))) == F.lower(X.blank(F.col("operation_pred")))
    value = (F.length(X.blank(F.col("value_gold"))) == 0) | (F.trim("value_gold") == F.trim(X.blank(F.col("value_pred"))))
    marks = [c.cast("int") for c in (element, operation, F.coalesce(value, F.lit(False)))]
    x = rows.select("task_id", *[m.alias(n) for m, n in zip(marks, "eov", strict=True)]).withColumn("ok", F.least("e", "o", "v"))
    per = x.groupBy("task_id").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in "eov"], F.sum("ok").alias("oks"), F.min("ok").alias("all_ok"))
    share = lambda c: F.round(F.try_divide(F.sum(c), F.sum("n")), 6)
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("num_steps"), F.count("*").alias("num_tasks"), share("e").alias("element_accuracy"), share("o").alias("operation_accuracy"), share("v").alias("value_accuracy"),
        share((F.col("e") + F.col("o") + F.col("v")) / 3.0).alias("action_f1"), share("oks").alias("step_success_rate"), F.round(F.avg("all_ok"), 6).alias("task_success_rate"),
    )


def run_metrics(log: DataFrame, success_only: bool = True) -> DataFrame:
    """domain, num_tasks, success_count, task_success_rate (percent), avg_steps and inserted, the tasks that go into memory: with steps, and successful unless ``success_only`` is off."""
    ok = F.coalesce("success", F.lit(False))
    keep = (F.col("num_steps") > 0) & (ok if success_only else F.lit(True))
    g = log.groupBy("domain").agg(F.count("*").alias("num_tasks"), F.sum(ok.cast("int")).alias("success_count"), F.sum("num_steps").alias("steps"), F.sum(keep.cast("int")).alias("inserted"))
    rate = F.round(100.0 * F.col("success_count") / F.col("num_tasks"), 6)
    return g.select("domain", "num_tasks", "success_count", rate.alias("task_success_rate"), F.round(F.col("steps") / F.col("num_tasks"), 6).alias("avg_steps"), "inserted")


def checked_table(table: DataFrame, required: set[str], key: str, name: str) -> DataFrame:
    """``table`` with all ``required`` columns and a row whose ``key`` is ``name``; raises ValueError where one is missing."""
    if missing := sorted(required - set(table.columns)):
        raise ValueError(f"missing columns: {missing}")
    if table.where(F.col(key) == name).isEmpty():
        raise ValueError(f"no row with {key} = {name}")
    return table
