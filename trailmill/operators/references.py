"""References to records that do not exist: signed counts a key, from change deltas.

Every parent row is two deltas of existence (+1 when it is loaded, -1 when it
is deleted) and every child is a delta of reference at its first arrival.  A
child is an orphan if the running sum of existence of its key is zero at that
time.

The running sum is taken in two levels so that a hot key is not one task: sums
by key and hour run over the hours of a key, and within an hour over its deltas.
``apply_deltas`` keeps the same counts as a stored state, a batch of changes at
a time; keys with positive references and zero existence are the current
orphans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import table

NEVER = "9999-12-31 00:00:00"
#: child table, its id, its reference, parent table, key of the parent
RELATIONS = (
    ("stages", "stage_id", "parent_intent_id", "intents", "intent_id"),
    ("actions", "action_id", "parent_stage_id", "stages", "stage_id"),
)


def clean_key(c: Column) -> Column:
    """Keys are equal apart from case and outer white space; blank is null."""
    k = F.lower(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", ""))
    return F.when(F.length(k) > 0, k)


def parent_deltas(parents: DataFrame, key: str) -> DataFrame:
    """key, at, exists (+1 or -1), first (load time).

    A row deleted no later than it is loaded never stands but has its key; a
    null load time counts as never loaded.
    """
    at = F.coalesce(F.col("loaded_at"), F.lit(NEVER).cast("timestamp_ntz"))
    stands = F.col("deleted_at").isNull() | (F.col("deleted_at") > at)
    born = F.struct(at.alias("at"), F.when(stands, 1).otherwise(0).alias("exists"))
    died = F.when(stands & F.col("deleted_at").isNotNull(), F.struct(F.col("deleted_at").alias("at"), F.lit(-1).alias("exists")))
    rows = parents.select(clean_key(F.col(key)).alias("key"), at.alias("first"), F.explode(F.array_compact(F.array(born, died))).alias("d"))
    return rows.where(F.col("key").isNotNull()).select("key", "first", "d.at", "d.exists")


def first_children(children: DataFrame, child_id: str, reference: str) -> DataFrame:
    """child_id, key and time of the first arrival; null ids, null times and blank references are left out."""
    first = F.min(F.struct("loaded_at", clean_key(F.col(reference)).alias("key"))).alias("f")
    rows = children.where(F.col(child_id).isNotNull() & F.col("loaded_at").isNotNull())
    rows = rows.groupBy(F.col(child_id).alias("child_id")).agg(first)
    return rows.select("child_id", F.col("f.key").alias("key"), F.col("f.loaded_at").alias("at")).where(F.col("key").isNotNull())


def orphans(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Of ``children`` (child_id, key, at) those whose key does not stand at ``at``, with ``reason``.

    ``parents``: parent_deltas.  Two shuffles: of all deltas by key and hour,
    and of the sums by key.
    """
    hour = F.date_trunc("hour", "at").alias("hour")
    none = F.lit(None)
    refs = children.select("key", hour, "at", F.lit(0).alias("exists"), none.cast("timestamp_ntz").alias("first"), "child_id")
    exist = parents.select("key", hour, "at", "exists", "first", none.cast("string").alias("child_id"))
    events = refs.unionByName(exist)
    sums = events.groupBy("key", "hour").agg(F.sum("exists").alias("s"), F.min("first").alias("first"), F.max(F.col("child_id").isNotNull()).alias("asked"))
    hours = W.partitionBy("key").orderBy("hour").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("key", "hour", "asked", F.coalesce(F.sum("s").over(hours), F.lit(0)).alias("before"), F.min("first").over(W.partitionBy("key")).alias("first_ever"))
    sums = sums.where("asked").drop("asked")
    within = W.partitionBy("key", "hour").orderBy("at").rangeBetween(W.unboundedPreceding, 0)
    running = events.withColumn("since", F.sum("exists").over(within)).where(F.col("child_id").isNotNull())
    # stands at the time: existence before the hour plus that of the hour up to and with the time
    out = running.drop("first").join(sums, ["key", "hour"]).where(F.col("before") + F.col("since") <= 0)
    reason = F.when(F.col("first_ever").isNull(), "missing").when(F.col("first_ever") > F.col("at"), "late").otherwise("deleted")
    return out.select("child_id", "key", "at", reason.alias("reason"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p4_found: child_table, child_id, reason and month of every orphan of both relations."""
    parts = []
    for child, child_id, reference, parent, key in RELATIONS:
        c = first_children(table(spark, sf_dir, child).select(child_id, reference, "loaded_at"), child_id, reference)
        p = parent_deltas(table(spark, sf_dir, parent).select(key, "loaded_at", "deleted_at"), key)
        parts.append(orphans(c, p).select(F.lit(child).alias("child_table"), "child_id", "reason", F.date_format("at", "yyyy-MM").alias("period")))
    return parts[0].unionByName(parts[1])


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans by table, month and reason."""
    return found(spark, sf_dir).groupBy("child_table", "period", "reason").agg(F.count("*").alias("orphans"))


def apply_deltas(state: DataFrame | None, deltas: DataFrame) -> DataFrame:
    """State (key, refs, exists) after a batch of signed ``deltas`` (key, refs, exists); settled keys are dropped."""
    rows = deltas.select(clean_key(F.col("key")).alias("key"), "refs", "exists").where(F.col("key").isNotNull())
    both = rows if state is None else state.select("key", "refs", "exists").unionByName(rows)
    out = both.groupBy("key").agg(F.sum("refs").alias("refs"), F.sum("exists").alias("exists"))
    return out.where((F.col("refs") != 0) | (F.col("exists") != 0))


def current_orphans(state: DataFrame) -> DataFrame:
    """Keys with positive references and no existence."""
    return state.where((F.col("refs") > 0) & (F.col("exists") <= 0)).select("key", "refs")


def current_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p4_current: keys referred to that do not exist once all changes are in, with the number of references.

    A parent row counts as existing until deleted; the state is fed in two
    batches, existence first.
    """
    out = []
    for child, child_id, reference, parent, key in RELATIONS:
        p = parent_deltas(table(spark, sf_dir, parent).select(key, "loaded_at", "deleted_at"), key)
        state = apply_deltas(None, p.select("key", F.lit(0).alias("refs"), "exists"))
        c = first_children(table(spark, sf_dir, child).select(child_id, reference, "loaded_at"), child_id, reference)
        state = apply_deltas(state, c.select("key", F.lit(1).alias("refs"), F.lit(0).alias("exists")))
        out.append(current_orphans(state).select(F.lit(child).alias("child_table"), "key", "refs"))
    return out[0].unionByName(out[1])
