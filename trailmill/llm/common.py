"""First arrivals, groups of exact copies and the lexicon: shared by the goal operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .goals import END, NAME, START, VALUE, Lexicon, base_words, words

LATE = "9999-12-31 00:00:00"
SALTS = 16


def exact_form(text: Column) -> Column:
    """Cheap built-in form for grouping exact copies: case and white space do not count."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\s ​﻿]+", " "))


def first_arrival(rows: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """The first row of each key by ``loaded_at`` (null loads last, ties by value); null keys are left out.

    One map-side combined aggregation: a key redelivered any number of times
    is one row a partition before the shuffle.
    """
    at = F.coalesce(F.col("loaded_at").cast("timestamp"), F.lit(LATE).cast("timestamp"))
    first = F.min(F.struct(at.alias("_at"), *[F.col(c) for c in cols])).alias("_first")
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(first).select(key, *[F.col(f"_first.{c}") for c in cols])


def representatives(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``rep``: the least ``order`` struct of the rows equal in ``by``.

    A hot group is split over ``SALTS`` partial groups; only the partial
    results, at most ``SALTS`` a group, meet in one window.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
    part = salted.groupBy(*by, "_salt").agg(F.min(F.struct(*order)).alias("_least"))
    whole = part.groupBy(*by).agg(F.min("_least").alias("rep"), F.collect_set("_salt").alias("_salts"))
    whole = whole.withColumn("_salt", F.explode("_salts")).drop("_salts")
    return salted.join(whole, [*by, "_salt"]).drop("_salt")


def worded(texts: DataFrame, col: str) -> DataFrame:
    """``texts`` with ``words``: the words of ``col`` in one form, joined by spaces; without a word the row is left out."""
    keep = [c for c in texts.columns if c != col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*keep).schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [words(t) for t in pdf[col]]
            at = [i for i, w in enumerate(found) if w]
            yield pdf.iloc[at][keep].assign(words=[" ".join(found[i]) for i in at])

    return texts.select(*keep, col).mapInPandas(run, f"{schema}, words string")


def lexicon(texts: DataFrame, share: float = 0.006, least: int = 5, usual: float = 0.001, context: float = 0.0005) -> Lexicon:
    """The words of a corpus (``words``), counted over all of it, and the places they stand in.

    Common are those in at least ``share`` of all texts, usual those in
    ``usual`` of them; of a word and its neighbours those are kept that occur
    in ``context`` of all texts.  What comes to the driver has a bound: words
    a text / ``context`` entries.
    """
    n = texts.count()
    ws = F.split("words", " ")
    counts = texts.select(F.explode(F.array_distinct(ws)).alias("word")).where(F.col("word").rlike("^[a-z]{2,}$")).groupBy("word").count()
    rows = counts.where(F.col("count") >= max(least - 1, int(usual * n))).collect()
    common = {r["word"]: r["count"] for r in rows if r["count"] >= max(least, int(share * n))}
    known = sorted(base_words() | common.keys())
    kind = F.transform(ws, lambda w: F.when(w.rlike("^[#0-9]"), VALUE).when(w.isin(known), w).otherwise(NAME))
    kind = F.concat(F.array(F.lit(START)), kind, F.array(F.lit(END)))
    three = F.transform(F.sequence(F.lit(0), F.size("k") - 3), lambda i: F.struct(*[F.col("k")[i + j].alias(c) for j, c in enumerate("abc")]))
    found = texts.select(kind.alias("k")).select(F.explode(three).alias("t")).groupBy("t.a", "t.b", "t.c").count()
    places: dict[str, dict[str, int]] = {}
    for r in found.where(F.col("count") >= max(3, int(context * n))).collect():
        places.setdefault(f"{r['a']} {r['c']}", {})[r["b"]] = r["count"]
    return Lexicon(common, frozenset(r["word"] for r in rows) - common.keys(), places)
