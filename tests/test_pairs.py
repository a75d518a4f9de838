"""Pairs of descriptors against brute force, in blocks small and large."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from trailmill.operators import maintenance as M

WORDS = [f"w{i}" for i in range(14)]


def test_descriptor_pairs_equal_brute_force(spark):
    rnd = random.Random(7)
    names = list(M.SIMILARITY_WEIGHTS)
    rows = []
    for i in range(330):
        base = random.Random(rnd.randrange(25))
        text = lambda k, b=base: " ".join(b.sample(WORDS, k))
        r = {n: None if base.random() < 0.35 else text(6) for n in names}
        r["role"] = base.choice([None, "", "button", "Link", "x"])
        for n in names:
            if rnd.random() < 0.12:
                r[n] = rnd.choice([None, "", "!?", text(5), "w1 w2"])
        whole = " ".join(x for x in (*[r[n] for n in names], rnd.choice(["", "extra", "w3 w4 w5 w6 w7 w8 w9"])) if x)
        rows.append((f"a{i:03d}", "hot" if i < 260 else f"s{i % 9}", *[r[n] for n in names], whole))
    df = spark.createDataFrame(rows, f"id string, block string, {', '.join(f'{n} string' for n in names)}, whole string").cache()
    got = {(r["id_a"], r["id_b"]): r["score"] for r in M.descriptor_pairs(df, ["block"]).collect()}
    a = df.select(*[F.col(c).alias(f"a_{c}") for c in df.columns])
    b = df.select(*[F.col(c).alias(f"b_{c}") for c in df.columns])
    sim = M.descriptor_similarity(lambda f: F.col(f"a_{f}"), lambda f: F.col(f"b_{f}"), F.col("a_whole"), F.col("b_whole"))
    want = a.join(b, (F.col("a_block") == F.col("b_block")) & (F.col("a_id") < F.col("b_id"))).withColumn("score", F.round(sim, 9)).where(F.col("score") >= M.ACTION_SIMILARITY)
    want = {(r["a_id"], r["b_id"]): r["score"] for r in want.select("a_id", "b_id", "score").collect()}
    assert got == want and len(want) > 300


def test_survivors_settle_on_long_chains(spark):
    chain = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(70)], "id_a string, id_b string")
    gone = {(r["id"], r["kept"]) for r in M.survivors(chain).collect()}
    assert gone == {(f"{i:03d}", f"{i - 1:03d}") for i in range(1, 71, 2)}
