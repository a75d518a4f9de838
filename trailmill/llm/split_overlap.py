"""Same or near-same records across splits, by n-gram hashes and containment.

Evaluation records are cut into word n-grams, hashed, and joined with the
n-grams of the training records.  There are three families of n-grams: of the
words in their order, of the sorted canonical tokens (the order of clauses
does not count), and of the sorted values among these (a slip in another word
does not count; only for records with ``VALUES`` of them or more, as fewer are
not telling).  Of each evaluation record only its rarest n-grams look for
partners: a training record with containment >= ``CONTAINMENT`` shares at least
one of the rarest ``n - ceil(CONTAINMENT * n) + 1``, so no pair is lost, and
n-grams that stand in a large share of all rows emit nothing.  For each
candidate pair the containment of the evaluation record in the training record
is computed, and ``goals.score`` decides whether it is the same task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table
from .common import exact_form, first_arrival, lexicon, representatives, worded
from .goals import Lexicon, canonical_words, names, numbers, score

N = 5
CONTAINMENT = 0.8
VALUES = 3
EVALUATION = ("cross_task", "cross_website", "cross_domain")
# fixed values: names of the splits
SPLITS = {
    "train": "train", "training": "train",
    "cross_task": "cross_task", "test_task": "cross_task",
    "cross_website": "cross_website", "test_website": "cross_website",
    "cross_domain": "cross_domain", "test_domain": "cross_domain",
}


def split_name(value: Column) -> Column:
    """Canonical split: trimmed, lower case, spaces and hyphens as underscores, aliases; null as ``unknown``."""
    raw = F.coalesce(F.regexp_replace(value, r"^\s+|\s+$", ""), F.lit(""))
    t = F.translate(F.lower(raw), " -", "__")
    to = F.create_map(*[F.lit(x) for kv in SPLITS.items() for x in kv])
    return F.coalesce(to[t], F.when(t == "", "unknown").otherwise(t))


def grams(tokens: list[str], n: int = N) -> list[int]:
    """Distinct hashes of the word n-grams; a shorter text is one n-gram."""
    parts = [tokens[i : i + n] for i in range(max(1, len(tokens) - n + 1))]
    return sorted({zlib.crc32(" ".join(p).encode()) << 20 | (zlib.adler32(" ".join(p).encode()) & 0xFFFFF) for p in parts})


FAMILIES = ("order", "tokens", "values")
SAME = ("tokens", "values")  # all that two texts of the same task need, whose tokens differ by slips only


def shingled(texts: DataFrame, lex: Lexicon, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """key, side, words, tokens, family and n-gram hashes of the texts (key, side, words) with canonical tokens; a row a family."""
    common, usual, context = lex.common, lex.usual, lex.context

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = Lexicon(common, usual, context)
        for pdf in batches:
            rows = []
            for key, side, ws in pdf.itertuples(index=False):
                tokens = canonical_words(ws.split(" "), lex)
                if not tokens:
                    continue
                if "order" in families:
                    rows.append((key, side, ws, tokens, "order", grams(["order:", *ws.split(" ")])))
                rows.append((key, side, ws, tokens, "tokens", grams(tokens)))
                # a word near a known one may be a slip of it; what a number counts may be one, too
                values = numbers(tokens) + names(tokens, lex)
                if len(values) >= VALUES:
                    rows.append((key, side, ws, tokens, "values", grams(["values:", *values])))
            yield pd.DataFrame(rows, columns=["key", "side", "words", "tokens", "family", "grams"])

    schema = "key string, side string, words string, tokens array<string>, family string, grams array<long>"
    return texts.select("key", "side", "words").mapInPandas(run, schema)


def candidates(docs: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(eval, train, family, containment) of ``docs`` (key, side, family, grams) with containment >= ``containment``."""
    train = docs.where(F.col("side") == "train").select(F.col("key").alias("train"), "family", F.col("grams").alias("train_grams"))
    test = docs.where(F.col("side") == "eval").select(F.col("key").alias("eval"), "family", "grams")
    wanted = test.select("eval", "family", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    seen = train.select("train", "family", F.explode("train_grams").alias("gram"))
    df = seen.groupBy("family", "gram").agg(F.count("*").alias("df"))
    # rarest first; an n-gram that no training record holds counts 0
    ranked = wanted.join(df, ["family", "gram"], "left").groupBy("eval", "family", "n").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram"))).alias("g")
    )
    need = F.col("n") - F.ceil(F.col("n") * containment).cast("int") + 1
    probe = ranked.select("eval", "family", F.explode(F.slice("g", 1, need)).alias("g")).where("g.df > 0").select("eval", "family", "g.gram")
    pairs = probe.join(seen, ["family", "gram"]).select("eval", "train", "family").distinct()
    both = pairs.join(test, ["eval", "family"]).join(train, ["train", "family"])
    share = F.size(F.array_intersect("grams", "train_grams")) / F.size("grams")
    return both.select("eval", "train", "family", share.alias("containment")).where(F.col("containment") >= containment)


def scored(pairs: DataFrame, docs: DataFrame, lex: Lexicon) -> DataFrame:
    """``pairs`` with ``score``: how alike two texts of the same task are, 0 for other tasks."""
    common, usual, context = lex.common, lex.usual, lex.context
    text = docs.where(F.col("family") == "tokens").select("key", "words", "tokens")
    of = lambda s: text.select(F.col("key").alias(s), F.col("words").alias(f"{s}_words"), F.col("tokens").alias(f"{s}_tokens"))
    both = pairs.join(of("eval"), "eval").join(of("train"), "train")
    both = both.withColumn("equal", F.col("eval_tokens") == F.col("train_tokens")).drop("eval_tokens", "train_tokens")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = Lexicon(common, usual, context)
        for pdf in batches:
            yield pdf[["eval", "train", "containment"]].assign(score=[score(a, b, lex) for a, b in zip(pdf["eval_words"], pdf["train_words"], strict=True)])

    schema = "eval string, train string, containment double, score double"
    other = both.where(~F.col("equal")).select("eval", "train", "containment", "eval_words", "train_words").mapInPandas(run, schema)
    return both.where("equal").select("eval", "train", "containment", F.lit(1.0).alias("score")).unionByName(other)


def overlaps(spark: SparkSession, sf_dir: str, families: tuple[str, ...] = FAMILIES) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): near-same pairs of an evaluation and a training text, and the records that stand for each text.

    Copies are grouped first and pairs are those of representatives (``eval``,
    ``train``): their greatest containment in a family of n-grams, and
    ``score``, over 0 for the same task.  Null and blank texts, null keys and
    other splits take no part.
    """
    rows = table(spark, sf_dir, "tasks").select("task_id", "loaded_at", "instruction", "split", "source")
    rows = first_arrival(rows, "task_id", ["instruction", "split", "source"]).withColumn("split", split_name(F.col("split")))
    side = F.when(F.col("split") == "train", "train").when(F.col("split").isin(*EVALUATION), "eval")
    rows = rows.withColumn("side", side).where(F.col("side").isNotNull())
    rows = rows.withColumn("form", exact_form(F.col("instruction"))).where(F.length("form") > 0)
    rows = rows.withColumn("form", F.xxhash64("form", F.reverse("form")))
    rows = cut(representatives(rows, ["side", "form"], ["task_id"]).withColumn("rep", F.col("rep.task_id")))
    reps = rows.where(F.col("rep") == F.col("task_id"))
    texts = cut(worded(reps.select(F.col("task_id").alias("key"), "side", F.col("instruction").alias("text")), "text"))
    lex = lexicon(texts)
    docs = cut(shingled(texts, lex, families))
    pairs = candidates(docs).groupBy("eval", "train").agg(F.max("containment").alias("containment"))
    return scored(pairs, docs, lex), rows


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p2_found: the pairs of the same task, smaller id first."""
    pairs, rows = overlaps(spark, sf_dir, SAME)
    of = lambda s: rows.where(F.col("side") == s).select(F.col("rep").alias(s), F.col("task_id").alias(f"{s}_id"))
    p = pairs.where("score > 0").select("eval", "train").join(of("eval"), "eval").join(of("train"), "train").where("eval_id != train_id")
    return p.select(F.least("eval_id", "train_id").alias("task_id_a"), F.greatest("eval_id", "train_id").alias("task_id_b"))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p2_report: by evaluation split and source, records that stand in the training split, exactly or almost, and pairs.

    ``pairs`` are those of the same task (copies counted, not expanded),
    ``near_pairs`` further ones with a containment of ``CONTAINMENT`` or more
    that ask for something else, ``eval_records`` the evaluation records with
    the same task in training, ``containment`` the mean over ``pairs``.
    """
    pairs, rows = overlaps(spark, sf_dir)
    train = rows.where("side = 'train'").groupBy(F.col("rep").alias("train")).agg(F.count("*").alias("copies"))
    same = F.col("score") > 0
    by_eval = pairs.join(train, "train").groupBy("eval").agg(
        F.sum(F.when(same, F.col("copies")).otherwise(0)).alias("same"), F.sum(F.when(same, 0).otherwise(F.col("copies"))).alias("near"),
        F.sum(F.when(same, F.col("copies") * F.col("containment")).otherwise(0.0)).alias("weight"),
    )
    evals = rows.where("side = 'eval'").groupBy(F.col("rep").alias("eval"), "split", "source").agg(F.count("*").alias("records"))
    out = by_eval.join(evals, "eval").groupBy("split", "source").agg(
        F.sum(F.col("same") * F.col("records")).alias("pairs"), F.sum(F.col("near") * F.col("records")).alias("near_pairs"),
        F.sum(F.when(F.col("same") > 0, F.col("records")).otherwise(0)).alias("eval_records"), F.sum(F.col("weight") * F.col("records")).alias("weight"),
    )
    return out.select("split", "source", "pairs", "near_pairs", "eval_records", F.try_divide("weight", "pairs").alias("containment"))
