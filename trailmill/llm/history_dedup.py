"""New batches against all history: graph index shards of the goals accepted so far.

1. First arrivals; groups of exact copies become one row each.
2. Each text gets its words, its canonical tokens (``goals``) and, from these, a vector.
3. The index has a number of parts that is stored with it, and the part of a
   goal follows from the goal alone: from its numbers, dates and amounts,
   which the same task shares.  A goal with fewer than two of them also goes
   by its names, and stands in two parts, those of its two names with the
   least hashes: one word that is no name on either side cannot part a pair.
4. A part is a list of shards, one a segment of the history, each a navigable
   small-world graph.  A batch (``Index.add``) becomes a new shard of each part
   it touches and is searched in the shards before, with a beam widened until
   it meets exhaustive search on a probe.  What the search brings is re-ranked
   by ``goals.score``, the exact decision on a pair.
5. Every ``COMPACT_EVERY`` batches (``Index.compact``), in parts with more than
   ``MAX_SHARDS`` shards the newer ones are merged; where the index has outgrown
   its parts, they are doubled.
6. Links join records to classes; the first record of a class is the accepted
   one, and every other is a case.

The shards are a table in the shared folder: a batch reads those of the parts
it touches and appends its own; records behind the shards are not read again,
and the lexicon is that of the first segment, so that forms do not shift.
"""

from __future__ import annotations

import hashlib
import json
import pickle
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut, shared_folder, table
from .common import exact_form, first_arrival, lexicon, representatives, worded
from .goals import Lexicon, canonical_words, names, numbers, score
from .graph import SmallWorld

DIM = 48
PARTITION_ROWS = 4096
SHARD_POINTS = 1 << 15
MAX_SHARDS = 4
COMPACT_EVERY = 12
LAST_BATCH = 2**31 - 1
NEAR = 0.6
LINKS = "kind string, batch int, key string, to_batch int, to_key string"
SHARDS = "kind string, since int, upto int, slot int, points long, graph binary, part int"
STORED = SHARDS + ", batch int, key string, to_batch int, to_key string"  # a shard, or a link found within one
POINTS = "kind string, batch int, key string, words string, tokens string, worth long, route long"


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(",")]


def vectors(tokens: list[str], known: dict[str, int]) -> np.ndarray:
    """Unit sums of a fixed random direction a token; values weigh more than common words."""
    ids: dict[str, int] = {}
    split = [t.split(" ") for t in tokens]
    flat = np.fromiter((ids.setdefault(t, len(ids)) for ts in split for t in ts), np.int64)
    bits = b"".join(hashlib.blake2b(t.encode(), digest_size=DIM // 8).digest() for t in ids)
    table = np.unpackbits(np.frombuffer(bits, np.uint8)).reshape(len(ids), DIM).astype(np.float32) * 2 - 1
    table *= np.array([0.4 if t in known else 1.0 for t in ids], np.float32)[:, None]
    sizes = np.array([len(ts) for ts in split])
    x = np.add.reduceat(table[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _hashes(texts: list[str]) -> np.ndarray:
    return np.fromiter((int.from_bytes(hashlib.blake2b(t.encode(), digest_size=7).digest()) for t in texts), np.int64)


class Shard:
    """A graph with the records behind its points, in the order of batch and key."""

    def __init__(self, rows: pd.DataFrame, known: dict[str, int]) -> None:
        tokens = rows["tokens"].tolist()
        self._fill(rows["batch"].to_numpy(np.int64), rows["key"].tolist(), rows["words"].tolist(), rows["route"].to_numpy(np.int64), _hashes(tokens), rows["worth"].to_numpy(np.int64))
        self.x = vectors(tokens, known)

    def _fill(self, batch: np.ndarray, key: list[str], words: list[str], route: np.ndarray, same: np.ndarray, worth: np.ndarray) -> None:
        self.batch, self.key, self.words, self.route, self.same, self.worth = batch, key, words, route, same, worth
        self.graph = SmallWorld(DIM)
        self.beam = 0

    @classmethod
    def of(cls, shards: list[Shard], at: list[np.ndarray] | None = None) -> Shard:
        """The points of some shards (those at ``at``), not yet inserted."""
        at = at or [np.arange(len(s.batch)) for s in shards]
        out = cls.__new__(cls)
        join = lambda f: np.concatenate([getattr(s, f)[i] for s, i in zip(shards, at, strict=True)])
        pick = lambda f: [getattr(s, f)[j] for s, i in zip(shards, at, strict=True) for j in i.tolist()]
        out._fill(join("batch"), pick("key"), pick("words"), join("route"), join("same"), join("worth"))
        out.x = join("x")
        return out

    def insert(self) -> list[tuple[np.ndarray, np.ndarray]]:
        found = self.graph.add(self.x)
        self.beam = self.graph.tuned_beam()
        return found

    def build(self, lex: Lexicon) -> list[tuple[int, int]]:
        """Inserts the points; (point, the first point before it that is the same task)."""
        out, at = [], 0
        for ids, sims in self.insert():
            out += self.links(self, np.arange(at, at + len(ids)), ids, sims, lex)
            at += len(ids)
        return out

    def links(self, q: Shard, rows: np.ndarray, ids: np.ndarray, sims: np.ndarray, lex: Lexicon) -> list[tuple[int, int]]:
        """Exact re-ranking: (row of ``q``, the first of the points found for it that is the same task)."""
        out = []
        there = sims > -1.5
        equal = there & (self.same[ids] == q.same[rows, None])
        near = there & ~equal & (sims > NEAR) & (self.worth[ids] == q.worth[rows, None])
        for i in np.flatnonzero((equal | near).any(1)):
            hits = ids[i, equal[i]].tolist()
            row = int(rows[i])
            hits += [j for j in ids[i, near[i]].tolist() if score(q.words[row], self.words[j], lex) > 0]
            if hits:
                out.append((row, min(hits, key=lambda j: (self.batch[j], self.key[j]))))
        return out

    def search(self, q: Shard, lex: Lexicon, rows: np.ndarray) -> list[tuple[int, int]]:
        """Links of the rows ``rows`` of ``q`` to points of this shard."""
        out = []
        for k in range(0, len(rows), 256):
            part = rows[k : k + 256]
            out += self.links(q, part, *self.graph.search(q.x[part], self.beam), lex)
        return out

    def stored(self) -> bytes:
        g = self.graph
        return pickle.dumps((self.batch.astype(np.int32), self.key, self.words, self.route, self.same, self.worth, g.x.astype(np.float16), g.links, g.fill.astype(np.int8), self.beam))

    @classmethod
    def load(cls, data: bytes) -> Shard:
        s = cls.__new__(cls)
        batch, key, words, route, same, worth, x, links, fill, beam = pickle.loads(data)
        s._fill(batch.astype(np.int64), key, words, route, same, worth)
        s.x = s.graph.x = x.astype(np.float32)
        s.graph.links, s.graph.fill, s.beam = links, fill.astype(np.int32), beam
        return s


def tokenised(texts: DataFrame, words: Lexicon) -> DataFrame:
    """``POINTS``, one row a route of each text (kind, batch, key, words) with canonical tokens.

    ``worth`` is the hash of its values: numbers, and names that are no slip of a known word.
    """
    common, usual, context = words.common, words.usual, words.context

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = Lexicon(common, usual, context)
        for pdf in batches:
            rows = []
            for kind, batch, key, ws in pdf.itertuples(index=False):
                tokens = canonical_words(ws.split(" "), lex)
                if tokens:
                    worth = zlib.crc32(" ".join([*numbers(tokens), *names(tokens, lex)]).encode())
                    rows += [(kind, batch, key, ws, " ".join(tokens), worth, r) for r in routes(kind, tokens, lex.known)]
            yield pd.DataFrame(rows, columns=_columns(POINTS))

    return texts.select("kind", "batch", "key", "words").mapInPandas(run, POINTS)


def routes(kind: str, tokens: list[str], known: dict[str, int]) -> set[int]:
    """Hashes that two goals of the same task have at least one of in common."""
    values = [kind, *numbers(tokens)]
    parts = [values]
    if len(values) < 3:
        unknown = {t.removeprefix("from:") for t in tokens if t[0].isalpha()} - known.keys()
        parts = [[*values, n] for n in sorted(unknown, key=lambda n: zlib.crc32(n.encode()))[:2]] or parts
    return {zlib.crc32(" ".join(p).encode()) for p in parts}


class Index:
    """The shards of all accepted records in a folder; ``add`` takes new batches."""

    def __init__(self, spark: SparkSession, folder: str, words: Lexicon, parts: int, generation: int = 0, segments: int = 0, merged: bool = False) -> None:
        self.spark, self.folder, self.words = spark, folder, words
        self.parts, self.generation, self.segments, self.merged = parts, generation, segments, merged

    @classmethod
    def create(cls, spark: SparkSession, folder: str, words: Lexicon, rows: int, partition_rows: int = PARTITION_ROWS) -> Index:
        """An empty index for a history of about ``rows`` records."""
        parts = 1
        while parts * partition_rows < rows:
            parts *= 2
        out = cls(spark, folder, words, parts)
        out._save()
        return out

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Index:
        states = [json.loads(r[0]) for r in spark.read.text(f"{folder}/state/*").collect()]
        s = max(states, key=lambda s: s["version"])
        words = Lexicon(s["common"], frozenset(s["usual"]), s["context"])
        return cls(spark, folder, words, s["parts"], s["generation"], s["segments"], s["merged"])

    def _save(self) -> None:
        version = 2 * (self.segments + 1000000 * self.generation) + self.merged
        state = {"version": version, "parts": self.parts, "generation": self.generation, "segments": self.segments, "merged": self.merged}
        state |= {"common": self.words.common, "usual": sorted(self.words.usual), "context": self.words.context}
        path = f"{self.folder}/state/{version}"
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    def _path(self) -> str:
        return f"{self.folder}/shards/{self.generation}"

    def shards(self) -> DataFrame:
        """All live shards: those that no merged shard covers."""
        if not self.segments:
            return self.spark.createDataFrame([], SHARDS)
        every = self.spark.read.schema(STORED).parquet(self._path()).where("points > 0").select(*_columns(SHARDS))
        if not self.merged:
            return every
        w = W.partitionBy("kind", "part").orderBy("since", F.desc("upto")).rowsBetween(W.unboundedPreceding, -1)
        keys = every.select("kind", "part", "since", "upto").distinct()  # without the graphs
        live = keys.withColumn("_over", F.max("upto").over(w)).where(F.coalesce(F.col("_over") < F.col("upto"), F.lit(True))).drop("_over")
        return every.join(live, ["kind", "part", "since", "upto"], "left_semi")

    def add(self, points: DataFrame, shard_points: int = SHARD_POINTS) -> DataFrame:
        """Batches of new records (``tokenised``, written to a table) against the index and one another; the links found.

        Each batch becomes a segment.  The rows of a part in one batch make
        one shard, or several (``slot``) where they are more than
        ``shard_points``, and the shards of a part are searched in groups of
        about as many points, so that no task holds more than one group.
        """
        points = points.withColumn("part", F.pmod("route", F.lit(self.parts)).cast("int"))
        sizes = points.groupBy("kind", "part", "batch").agg(F.count("*").alias("n"))
        most = {r["batch"]: r["n"] for r in sizes.groupBy("batch").agg(F.max("n").alias("n")).collect()}  # a row a batch
        if not most:
            return self.spark.createDataFrame([], LINKS)
        first = self.segments
        number = F.array_position(F.array(*[F.lit(b) for b in sorted(most)]), F.col("batch")).cast("int") + (first - 1)
        slot = F.lit(0)
        if hot := max(most.values()) > shard_points:
            split = sizes.where(F.col("n") > shard_points).select("kind", "part", "batch", F.ceil(F.col("n") / shard_points).cast("int").alias("slots"))
            points = points.join(split, ["kind", "part", "batch"], "left")
            slot = F.when(F.col("slots").isNotNull(), F.pmod(F.xxhash64("key"), "slots").cast("int")).otherwise(0)
        points = points.select(*_columns(POINTS), "part", number.alias("segment"), slot.alias("slot"))
        # one task a part (and slot), so that a part gets one file a call
        new = points.repartition("part", "slot").groupBy("kind", "part", "segment", "slot").applyInPandas(_build(self.words), STORED)
        new.write.mode("append").partitionBy("part").parquet(self._path())
        self.segments += len(most)
        self._save()
        written = self.spark.read.schema(STORED).parquet(self._path()).where(F.col("since") >= first)
        out = cut(written.where("to_key is not null").select(*_columns(LINKS)))
        if first or hot or len(most) > 1:
            out = out.unionByName(cut(self._search(points, hot, shard_points)))
        return out

    def _search(self, points: DataFrame, hot: bool, shard_points: int) -> DataFrame:
        """Links to the shards before, and to those of the own segment in slots before the own."""
        shards = self.shards().join(points.select("kind", "part").distinct(), ["kind", "part"], "left_semi")
        right = points.where((F.col("segment") > 0) | (F.col("slot") > 0)).withColumnRenamed("slot", "q_slot")
        sums = shards.groupBy("kind", "part").agg(F.sum("points").alias("n"))
        if not hot and (sums.agg(F.max("n")).first()[0] or 0) <= shard_points:
            key = ["kind", "part"]
            return shards.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_meet(self.words), LINKS)
        w = W.partitionBy("kind", "part").orderBy("since", "upto", "slot").rowsBetween(W.unboundedPreceding, -1)
        group = F.floor(F.coalesce(F.sum("points").over(w), F.lit(0)) / shard_points).cast("int").alias("group")
        groups = cut(shards.select("kind", "part", "since", "upto", "slot", "points").select("*", group).drop("points"))
        heads = groups.groupBy("kind", "part", "group").agg(F.min("since").alias("first"))
        slots = right.select("kind", "part", (F.col("q_slot") + 0).alias("of_slot")).distinct()
        left = shards.join(groups, ["kind", "part", "since", "upto", "slot"]).join(slots, ["kind", "part"]).withColumnRenamed("of_slot", "q_slot")
        right = right.join(heads, ["kind", "part"]).where((F.col("first") < F.col("segment")) | ((F.col("first") == F.col("segment")) & (F.col("q_slot") > 0)))
        key = ["kind", "part", "group", "q_slot"]
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_meet(self.words), LINKS)

    def compact(self, max_shards: int = MAX_SHARDS, shard_points: int = SHARD_POINTS, partition_rows: int = PARTITION_ROWS) -> None:
        """Merges shards of parts that have more than ``max_shards``, and doubles the parts once they are twice too large."""
        live = self.shards()
        rows = live.agg(F.sum("points")).first()[0] or 0
        if rows > 4 * partition_rows * self.parts:
            return self._double(live, rows, partition_rows)
        keys = live.select("kind", "part", "since", "upto", "slot", "points")
        many = keys.groupBy("kind", "part").agg(F.count("*").alias("shards"), F.max("slot").alias("slots")).where((F.col("shards") > max_shards) & (F.col("slots") == 0))
        newest = W.partitionBy("kind", "part").orderBy(F.desc("upto")).rowsBetween(W.unboundedPreceding, 0)
        small = keys.join(many, ["kind", "part"]).withColumn("_sum", F.sum("points").over(newest)).withColumn("_n", F.row_number().over(newest))
        # the newest, while they are small together; the oldest, largest ones stay as they are
        small = small.where((F.col("_sum") <= shard_points) & (F.col("_n") <= F.col("shards") - max_shards // 2))
        small = live.join(small.select("kind", "part", "since", "upto", "slot"), ["kind", "part", "since", "upto", "slot"], "left_semi")
        small = cut(small)  # what is merged is read before it is written to the same table
        small.groupBy("kind", "part").applyInPandas(_merge, SHARDS).write.mode("append").partitionBy("part").parquet(self._path())
        self.merged = True
        self._save()

    def _double(self, live: DataFrame, rows: int, partition_rows: int) -> None:
        """All shards split by the routes of their points, into a new generation of the table."""
        parts = self.parts
        while parts * partition_rows < rows:
            parts *= 2
        out = live.mapInPandas(_resplit(parts), SHARDS)
        self.generation, self.parts, self.merged = self.generation + 1, parts, False
        out.write.mode("overwrite").partitionBy("part").parquet(self._path())
        self._save()


def _lexicon(words: Lexicon):
    common, usual, context = words.common, words.usual, words.context
    made: list[Lexicon] = []

    def get() -> Lexicon:
        if not made:
            made.append(Lexicon(common, usual, context))
        return made[0]

    return get


def _build(words: Lexicon):
    get = _lexicon(words)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        kind, part, segment, slot = key
        lex = get()
        s = Shard(pdf.sort_values(["batch", "key"], kind="stable"), lex.known)
        links = s.build(lex)
        where = (kind, segment, segment, slot)
        out = [(*where, len(pdf), s.stored(), part, None, None, None, None)]
        out += [(*where, 0, None, part, int(s.batch[i]), s.key[i], int(s.batch[j]), s.key[j]) for i, j in links]
        return pd.DataFrame(out, columns=_columns(STORED)).astype({"batch": "Int32", "to_batch": "Int32"})

    return run


def _meet(words: Lexicon):
    get = _lexicon(words)

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            lex = get()
            right = right.sort_values(["segment", "batch", "key"], kind="stable")
            q = Shard(right, lex.known)
            segment, slot = right["segment"].to_numpy(), right["q_slot"].to_numpy()
            for upto, of_slot, graph in zip(left["upto"], left["slot"], left["graph"], strict=True):
                rows = np.flatnonzero((segment > upto) | ((segment == upto) & (slot > of_slot)))
                if len(rows):
                    s = Shard.load(graph)
                    out += [(key[0], int(q.batch[i]), q.key[i], int(s.batch[j]), s.key[j]) for i, j in s.search(q, lex, rows)]
        return pd.DataFrame(out, columns=_columns(LINKS))

    return run


def _row(kind: str, part: int, since: int, upto: int, slot: int, s: Shard) -> tuple:
    s.insert()
    return kind, since, upto, slot, len(s.batch), s.stored(), part


def _merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """One shard in place of those of a part; none where there is only one."""
    rows = []
    if len(pdf) > 1:
        whole = Shard.of([Shard.load(g) for g in pdf.sort_values("since")["graph"]])
        rows.append(_row(key[0], key[1], int(pdf["since"].min()), int(pdf["upto"].max()), 0, whole))
    return pd.DataFrame(rows, columns=_columns(SHARDS))


def _resplit(parts: int):
    """Each shard cut up by the parts its points go to now."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for kind, since, upto, slot, graph in pdf[["kind", "since", "upto", "slot", "graph"]].itertuples(index=False):
                old = Shard.load(graph)
                to = old.route % parts
                out = [_row(kind, p, since, upto, slot, Shard.of([old], [np.flatnonzero(to == p)])) for p in np.unique(to).tolist()]
                yield pd.DataFrame(out, columns=_columns(SHARDS))

    return run


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, key, batch and text of the first arrival of every intent and trace."""
    cols = ["batch_no", "text"]
    parts = []
    for kind, name, key, text in (
        ("intent", "intents", "intent_id", "canonical_intent"),
        ("trace", "episode_traces", "task_id", "instruction"),
    ):
        rows = table(spark, sf_dir, name).select(key, "loaded_at", "batch_no", F.col(text).alias("text"))
        parts.append(first_arrival(rows, key, cols).select(F.lit(kind).alias("kind"), F.col(key).alias("key"), *cols))
    both = parts[0].unionByName(parts[1])
    return both.select("kind", "key", F.coalesce("batch_no", F.lit(LAST_BATCH)).cast("int").alias("batch"), "text")


def settled(label: DataFrame, step, key: list[str], value: str, most: int = 200) -> DataFrame:  # noqa: ANN001
    """``step`` of ``label`` (``key``, ``value``) again and again until ``value`` changes nowhere; raises when it does not settle.

    ``step`` returns ``key``, ``value`` and ``was``.  Each round is cut by a checkpoint.
    """
    for _ in range(most):
        new = cut(step(label))
        label = new.select(*key, value)
        if new.where(F.col(value) != F.col("was")).isEmpty():
            return label
    raise RuntimeError(f"not settled after {most} rounds")


def classes(links: DataFrame) -> DataFrame:
    """(kind, batch, key) of every linked record with ``accepted``, the first record of its class.

    Least labels spread over the links and jump to the label of their label;
    the rounds end when nothing changes.  Each round is a shuffle join on the
    links, cut by a checkpoint.
    """
    me, other = F.struct("batch", "key"), F.struct(F.col("to_batch").alias("batch"), F.col("to_key").alias("key"))
    one = links.select("kind", me.alias("a"), other.alias("b"))
    edges = cut(one.unionByName(one.select("kind", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = edges.groupBy("kind", "a").agg(F.min("b").alias("m")).select("kind", "a", F.least("a", "m").alias("m"))

    def step(label: DataFrame) -> DataFrame:
        near = edges.join(label.withColumnRenamed("a", "b"), ["kind", "b"]).groupBy("kind", "a").agg(F.min("m").alias("n"))
        jump = label.select("kind", F.col("a").alias("m"), F.col("m").alias("j"))
        new = label.join(near, ["kind", "a"]).join(jump, ["kind", "m"], "left")
        return new.select("kind", "a", F.least("m", "n", F.coalesce("j", "m")).alias("m"), F.col("m").alias("was"))

    label = settled(cut(label), step, ["kind", "a"], "m")
    return label.select("kind", "a.batch", "a.key", F.col("m").alias("accepted"))


def indexed(spark: SparkSession, points: DataFrame, words: Lexicon, first: Column, rows: int, at_once: int = COMPACT_EVERY) -> DataFrame:
    """The links of all batches: the history first, then the new batches, ``at_once`` of them a call, each with a shard of its own."""
    folder = f"{shared_folder(spark)}/history-index-{uuid.uuid4().hex}"
    index = Index.create(spark, folder, words, rows)
    out = index.add(points.where(first))
    new = sorted(r[0] for r in points.where(~first).select("batch").distinct().collect())  # a row a batch
    for i in range(0, len(new), at_once):
        if i:
            index.compact()
        out = out.unionByName(index.add(points.where(F.col("batch").isin(new[i : i + at_once]))))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)  # the links are written; nothing reads the shards any more
    return out


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p1_found: every record that is the same task as one accepted before, with the accepted one.

    Null, blank and wordless texts are never cases; null keys cannot be
    reported and are left out; a null batch counts as the last.
    """
    rows = arrivals(spark, sf_dir).withColumn("form", exact_form(F.col("text"))).where(F.length("form") > 0)
    rows = cut(representatives(rows.withColumn("form", F.xxhash64("form", F.reverse("form"))), ["kind", "form"], ["batch", "key"]))
    reps = rows.where((F.col("rep.batch") == F.col("batch")) & (F.col("rep.key") == F.col("key")))
    texts = cut(worded(reps.select("kind", "batch", "key", "text"), "text"))
    least = texts.agg(F.min("batch")).first()[0]
    history = F.col("batch") == F.lit(least if least is not None else 0)
    words = lexicon(texts.where(history))
    points = cut(tokenised(texts, words))
    links = indexed(spark, points, words, history, points.where(history).count())
    of = classes(links).select("kind", F.struct("batch", "key").alias("rep"), "accepted")
    # copies under a text follow their representative; without a link it stands for itself
    salt = F.pmod(F.xxhash64("key"), F.lit(16))
    of = of.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    all_rows = rows.withColumn("_salt", salt.cast("int")).join(of, ["kind", "rep", "_salt"], "left")
    first = F.coalesce("accepted", "rep")["key"]
    cases = all_rows.where(first != F.col("key"))
    return cases.select(
        F.col("kind").alias("record_kind"), F.least("key", first).alias("key_a"), F.greatest("key", first).alias("key_b")
    )
