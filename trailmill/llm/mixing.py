"""Mixing sources to target shares in tokens, by entropy balancing.

Rates r of the documents minimise the entropy of the mixture relative to the
corpus, ``sum r_i log r_i - r_i`` over the documents, under the constraints
``sum over a source of n_i r_i = T_source`` (n_i tokens of document i) and
``r_i <= max_repeats``.  The convex dual has one multiplier a source, and the
solution is the exponentially tilted rate ``r_i = min(max_repeats, exp(lambda_source * n_i))``.

Each Newton iteration sums the tokens at the present rates and their slope
over all documents, for all sources and mixtures at once; documents of equal
size have equal rates and are counted together first.  The step is taken on
the logarithm of the sum; beside it some more places in the bracket are summed
in the same pass, which keeps the iterations few where sizes differ much.  They
end when every source is met within half a token; if they do not, an error is
raised.

Rates are rounded into copies: every document gets the whole part of its
rate, and one more copy with the chance of the rest, by a hash; the threshold of
that hash is set so that the tokens of the source are met as nearly as its
documents allow.  It is found by two histograms of the hash and a running sum
over one of their 2^20 cells; then one document of the size still missing (or
too much) is turned.

Unless ``total`` is given, a mixture is as large as the caps allow with all
shares met; the source that sets the limit then has the rate ``max_repeats``.
Sources that hold no tokens, have weight 0 or are not listed take no part; the
weights of the others are brought to a sum of 1.  Names of sources are equal
apart from case and outer spaces; null names and documents without tokens take
no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut, table
from .tokens import TOKENIZERS, encoded

MOST_STEPS = 60
FULL = 1e300  # the multiplier of a source that is taken as often as the cap allows


def source_name(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def token_sizes(spark: SparkSession, sf_dir: str, path: str = TOKENIZERS) -> DataFrame:
    """doc_id, source and n_tokens of the documents that have a source; written once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", source_name(F.col("source")).alias("source"), "text")
    docs = docs.where(F.col("source").isNotNull() & F.col("text").isNotNull())
    return cut(encoded(docs, path, count_only=True).where(F.col("n_tokens") > 0))


def constraints(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """mix_name, source, cap, have (tokens), documents, share, want (tokens)."""
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("have"), F.count("*").alias("documents"))
    t = targets.select("mix_name", source_name(F.col("source")).alias("source"), "weight", "max_repeats").groupBy("mix_name", "source")
    t = t.agg(F.sum("weight").alias("weight"), F.max("max_repeats").alias("cap")).where(F.col("source").isNotNull())
    t = t.join(have, "source", "left").fillna(0, ["have", "documents"]).fillna(0.0, ["weight"])
    counts = (F.col("weight") > 0) & (F.col("have") > 0) & (F.col("cap") > 0)
    mix = W.partitionBy("mix_name")  # a row a source
    t = t.withColumn("live", F.when(counts, F.col("weight")).otherwise(0.0))
    t = t.withColumn("share", F.coalesce(F.try_divide("live", F.sum("live").over(mix)), F.lit(0.0)))
    feasible = F.min(F.when(F.col("share") > 0, F.col("cap") * F.col("have") / F.col("share"))).over(mix)
    t = t.withColumn("want", F.col("share") * (F.lit(float(total)) if total is not None else feasible))
    return t.select("mix_name", "source", "cap", "have", "documents", "share", F.coalesce("want", F.lit(0.0)).alias("want"))


def rate(n: Column, lam: Column, unit: Column, cap: Column) -> Column:
    """The tilted rate of a document of ``n`` tokens; ``lam`` counts for ``unit`` tokens."""
    return F.exp(F.least(F.log(cap.cast("double")), lam * n / unit))


def rates(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """``constraints`` with the multiplier ``lam`` for ``unit`` tokens, and ``rate``, the mean rate of a token.

    The rows of the targets come to the driver, not those of the documents.
    """
    want = cut(constraints(sizes, targets, total))
    spark = sizes.sparkSession
    hist = cut(sizes.groupBy("source", "n_tokens").agg(F.count("*").alias("d")))
    state = []
    for r in want.where((F.col("share") > 0) & (F.col("want") > 0)).collect():
        full = r["want"] >= r["cap"] * r["have"] * (1 - 1e-12)
        state.append({**r.asDict(), "unit": r["have"] / r["documents"], "lam": FULL if full else 0.0, "lo": -math.inf, "hi": math.inf, "met": full})
    open_ = [s for s in state if not s["met"]]
    for _ in range(MOST_STEPS):
        if not open_:
            break
        tries = [(i, lam, s["source"], s["unit"], s["cap"]) for i, s in enumerate(open_) for lam in _tries(s)]
        now = spark.createDataFrame(tries, "i int, lam double, source string, unit double, cap int")
        r = rate(F.col("n_tokens"), F.col("lam"), F.col("unit"), F.col("cap"))
        mass = F.col("d") * F.col("n_tokens") * r
        slope = F.when(r < F.col("cap"), mass * F.col("n_tokens") / F.col("unit")).otherwise(0.0)
        sums = hist.join(F.broadcast(now), "source").groupBy("i", "lam").agg(F.sum(mass).alias("mass"), F.sum(slope).alias("slope"))
        for row in sums.collect():  # some rows a source
            _seen(open_[row["i"]], row["lam"], row["mass"], row["slope"])
        open_ = [s for s in open_ if not s["met"]]
    if open_:
        raise RuntimeError(f"rates of {len(open_)} sources are not met after {MOST_STEPS} steps")
    solved = spark.createDataFrame([(s["mix_name"], s["source"], s["lam"], s["unit"]) for s in state], "mix_name string, source string, lam double, unit double")
    mean = F.when(F.col("lam").isNotNull(), F.least("cap", F.col("want") / F.col("have"))).otherwise(0.0)
    return want.join(F.broadcast(solved), ["mix_name", "source"], "left").withColumn("rate", mean)


def _tries(s: dict) -> list[float]:
    """Where to sum next: the Newton step on log mass = log want from the nearest sum so far, and places around or in the bracket."""
    lam, lo, hi = s["lam"], s["lo"], s["hi"]
    step = math.log(s["want"] / s["mass"]) * s["mass"] / s["slope"] if s.get("slope") and s["mass"] > 0 else 0.0
    new = [lam + step] if lo < lam + step < hi else []
    if math.isinf(lo) or math.isinf(hi):
        wide = [4.0**k for k in range(-3, 12)]
        return sorted({*new, lam, *[lam + w for w in wide if lam + w < hi], *[lam - w for w in wide if lam - w > lo]})
    return sorted({*new, *[lo + (hi - lo) * k / 16 for k in range(1, 16)], *[x for k in (-1e-3, 1e-3) if lo < (x := lam + step * (1 + k)) < hi]})


def _seen(s: dict, lam: float, mass: float, slope: float) -> None:
    """Takes in the sum at one place: bracket, nearest place, and whether the source is met there."""
    off = abs(mass - s["want"])
    if "off" not in s or off < s["off"]:
        s |= {"off": off, "lam": lam, "mass": mass, "slope": slope}
    if mass < s["want"]:
        s["lo"] = max(s["lo"], lam)
    else:
        s["hi"] = min(s["hi"], lam)
    s["met"] = s["off"] <= max(0.5, 1e-9 * s["want"])


def copies(sizes: DataFrame, solved: DataFrame) -> DataFrame:
    """mix_name, doc_id, source, n_tokens, rate, copies (>= 1)."""
    key = ["mix_name", "source"]
    s = solved.where(F.col("rate") > 0).select(*key, "lam", "unit", "cap", F.least("want", F.col("cap") * F.col("have")).alias("goal"))
    d = sizes.join(F.broadcast(s), "source")
    d = d.withColumn("rate", rate(F.col("n_tokens"), F.col("lam"), F.col("unit"), F.col("cap")))
    d = d.withColumn("base", F.least(F.col("cap"), F.floor(F.col("rate") + 1e-9).cast("int"))).withColumn("rest", F.greatest(F.lit(0.0), F.col("rate") - F.col("base")))
    u = F.pmod(F.xxhash64("doc_id", "mix_name"), F.lit(2**28)) + 0.5
    # below 2^28 with the chance of the rest; documents at the cap get no further copy
    place = F.when(F.col("base") < F.col("cap"), F.least(F.lit(2**30 - 1), F.floor(u / F.greatest("rest", F.lit(1e-9)))).cast("long"))
    d = cut(d.select(*key, "doc_id", "n_tokens", "rate", "base", "goal", place.alias("u")))
    base = d.groupBy(*key).agg(F.sum(F.col("base") * F.col("n_tokens")).alias("sure"), F.sum(F.when(F.col("u").isNotNull(), F.col("n_tokens")).otherwise(0)).alias("room"))
    d = d.join(F.broadcast(base), key).withColumn("extra", F.greatest(F.lit(0.0), F.least(F.col("room"), F.col("goal") - F.col("sure"))))
    d = d.withColumn("c1", F.shiftright("u", 20)).withColumn("c2", F.shiftright("u", 10))

    def stop(rows: DataFrame, cell: str, left: str) -> DataFrame:
        """The cell in which the running sum passes what is left, and what is left there."""
        sums = rows.where(F.col(cell).isNotNull()).groupBy(*key, cell, left).agg(F.sum("n_tokens").alias("t"))
        w = W.partitionBy(*key).orderBy(cell).rowsBetween(W.unboundedPreceding, 0)
        sums = sums.withColumn("through", F.sum("t").over(w))
        hit = sums.where((F.col("through") > F.col(left)) & (F.col("through") - F.col("t") <= F.col(left)))
        return hit.select(*key, F.col(cell).alias(f"{cell}_stop"), (F.col(left) - (F.col("through") - F.col("t"))).alias(f"{cell}_left"))

    at1 = cut(stop(d, "c1", "extra"))
    inner = d.join(at1, key).where(F.col("c1") == F.col("c1_stop"))
    at2 = cut(stop(inner, "c2", "c1_left"))
    last = d.join(at2, key).where(F.col("c2") == F.col("c2_stop"))
    w = W.partitionBy(*key).orderBy("u", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    last = last.withColumn("through", F.sum("n_tokens").over(w))
    nearest = F.col("through") - F.col("n_tokens") / 2 <= F.col("c2_left")
    ids = last.where(nearest).select("mix_name", "doc_id", F.lit(True).alias("tail"))
    out = d.join(at2, key, "left").join(ids, ["mix_name", "doc_id"], "left")
    # without a stop all documents with room get one more (something is left over), or none (nothing is)
    more = F.when(F.col("c2_stop").isNull(), F.col("extra") >= F.col("room") - 0.5).otherwise(
        (F.col("c2") < F.col("c2_stop")) | F.coalesce("tail", F.lit(False))
    )
    more = F.coalesce(more & F.col("u").isNotNull(), F.lit(False))
    out = cut(out.select(*key, "doc_id", "n_tokens", "rate", "base", "u", "extra", more.alias("more")))
    # where the stop fell on a long document, one of the size that is missing is added, or one too much taken out
    taken = F.sum(F.when(F.col("more"), F.col("n_tokens")).otherwise(0))
    off = out.groupBy(*key).agg((F.first("extra") - taken).alias("off")).where(F.abs("off") >= 1)
    miss = F.abs(F.abs("off") - F.col("n_tokens"))
    best = out.join(off, key).where(F.col("u").isNotNull() & (F.col("more") != (F.col("off") > 0)) & (miss < F.abs("off")))
    best = best.groupBy(*key).agg(F.min(F.struct(miss.alias("miss"), "doc_id")).alias("b"))
    out = out.join(best.select(*key, F.col("b.doc_id").alias("doc_id"), F.lit(True).alias("turn")), [*key, "doc_id"], "left")
    more = F.col("more") != F.coalesce("turn", F.lit(False))
    out = out.withColumn("copies", (F.col("base") + more.cast("int")).cast("int")).where(F.col("copies") > 0)
    return out.select("mix_name", "doc_id", "source", "n_tokens", "rate", "copies")


def mix(spark: SparkSession, sf_dir: str, total: float | None = None, path: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """(copies of documents, solved rates) of every mixture in ``mix_targets``."""
    sizes = token_sizes(spark, sf_dir, path)
    solved = cut(rates(sizes, table(spark, sf_dir, "mix_targets"), total))
    return copies(sizes, solved), solved


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p7_mix: how often each document stands in each mixture."""
    return mix(spark, sf_dir)[0]


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p7_shares: target and actual share in tokens of every listed source."""
    chosen, solved = mix(spark, sf_dir)
    got = chosen.groupBy("mix_name", "source").agg(
        F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"),
        F.max("copies").alias("most_copies"),
    )
    out = solved.select("mix_name", "source", "cap", F.col("share").alias("target_share"), "rate").join(got, ["mix_name", "source"], "left")
    out = out.fillna(0, ["documents", "copies", "tokens", "most_copies"])
    actual = F.col("tokens") / F.sum("tokens").over(W.partitionBy("mix_name"))
    return out.withColumn("actual_share", F.coalesce(actual, F.lit(0.0)))
