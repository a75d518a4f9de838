"""Languages of documents and their segments, by error-correcting output codes.

Each language has a codeword of ``BITS`` bits, far from all others.  For each
bit a binary classifier over the character n-grams of words predicts its value;
a sentence gets the language whose codeword has the least loss, each bit
weighted by how well its classifier did on sentences held out.  So is the
sharpness of the confidence, a softmax of the losses, chosen.  A small margin over the
second codeword flags a sentence as ambiguous: it then takes the language, of
those the document surely has, that has the least loss.

The classifiers are fitted on the driver on a bounded sample of labelled
documents (``TRAIN_DOCS`` a language, ``TRAIN_SENTENCES`` a document), without
the sentences whose words stand mostly under other labels than their own.
Applying them is a map without a shuffle.

A full sentence ends with a mark and has at least ``MIN_WORDS`` words (Japanese:
``MIN_KANA`` characters) besides quoted labels, codes, addresses and tags.
Documents without one (null, empty, blank, codes only) get no language and are
no cases.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import spread, table

BITS = 24
BUCKETS = 1 << 16
TRAIN_DOCS = 120
TRAIN_SENTENCES = 8
MIN_STEPS = 60
MIN_WORDS = 4
MIN_KANA = 8
SURE = 0.25
KEPT_WORDS = 200_000

# parts that are no language; those of the patterns below are looked for where their marks stand
_NOISE = re.compile(
    r"```.*?```|<\|[^|>]*\|>|<[^<>]{1,400}>|https?://\S+|www\.\S+|&\w+;"
    r"|“[^“”]{0,80}”|„[^„“”]{0,80}[“”]|«[^«»]{0,80}»|‘[^‘’]{0,80}’|「[^「」]{0,60}」|\"[^\"\n]{0,80}\""
    r"|\[\w+\](?:\s*\w+=\d+)?|\{[^{}]*\}|\\[ntr]",
    re.DOTALL,
)
_MAIL = re.compile(r"\S+@\S+\.\S+")
_CODE = re.compile(r"\b\w*__\w*\b")
_CALL = re.compile(r"\w+\('[^']*'\)")
_END = re.compile(r"(?<=[.!?])(?![\w.!?])|(?<=[。！？])")
_WORD = re.compile(r"\w+")
_KANA = 8
SURE = 0.25
KEPT_WORDS = 200_000

# parts that are no language; those of the patterns below are looked for where their marks stand
_NOISE = re.compile(
    r"```.*?```|<\|[^|>]*\|>|<[^<>]{1,400}>|https?://\S+|www\.\S+|&\w+;"
    r"|“[^“”]{0,80}”|„[^„“”]{0,80}[“”]|«[^«»]{0,80}»|‘[^‘’]{0,80}’|「[^「」]{0,60}」|\"[^\"\n]{0,80}\""
    r"|\[\w+\](?:\s*\w+=\d+)?|\{[^{}]*\}|\\[ntr]",
    re.DOTALL,
)
_MAIL = re.compile(r"\S+@\S+\.\S+")
_CODE = re.compile(r"\b\w*__\w*\b")
_CALL = re.compile(r"\w+\('[^']*'\)")
_END = re.compile(r"(?<=[.!?])(?![\w.!?])|(?<=[。！？])")
_WORD = re.compile(r"[^\W\d_]+")
_KANA = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")


def sentences(text: str | None) -> list[list[str]]:
    """The words of each full sentence (for Japanese: its characters)."""
    if not text or not text.strip():
        return []
    if "@" in text:
        text = _MAIL.sub(" ", text)
    if "__" in text:
        text = _CODE.sub(" ", text)
    if "('" in text:
        text = _CALL.sub(" ", text)
    out = []
    for part in _END.split(_NOISE.sub(" ", text)):
        part = part.rstrip()
        if not part or part[-1] not in ".!?。！？":
            continue
        words = []
        for w in _WORD.findall(part.lower()):
            if w.isalpha():
                words.append(w)
            elif "_" in w:  # names of fields are words, codes with digits are not
                words += [x for x in w.split("_") if x.isalpha()] if not any(map(str.isdigit, w)) else []
        kana = _KANA.findall(part)
        if len(kana) >= MIN_KANA:
            out.append(kana)
        elif len(words) >= MIN_WORDS and sum(map(len, words)) >= 3 * MIN_WORDS - 2:
            out.append(words)
    return out


def features(word: str) -> list[int]:
    """Hashes of the 1- to 4-grams of a word between marks, and of the word."""
    w = f"^{word}$"
    grams = {w[i : i + n] for n in (1, 2, 3, 4) for i in range(len(w) - n + 1)} | {w}
    return [zlib.crc32(g.encode()) % BUCKETS for g in grams if g not in "^$"]


def codewords(n: int, bits: int = BITS, seed: int = 5) -> np.ndarray:
    """``n`` codewords of +-1, the best of many random ones by their least distance; every bit splits the languages."""
    rng = np.random.default_rng(seed)
    best, code = -1, np.ones((n, bits))
    for _ in range(400):
        c = rng.integers(0, 2, (n, bits)) * 2 - 1
        same = np.flatnonzero(np.abs(c.sum(0)) == n) if n > 1 else []
        c[rng.integers(0, n, len(same)), same] *= -1
        d = min((int((c[i] != c[j]).sum()) for i in range(n) for j in range(i)), default=bits)
        if d > best:
            best, code = d, c
    return code.astype(np.float32)


class Model:
    """Weights of the bit classifiers, codewords, weights of the bits and the sharpness of confidences."""

    def __init__(self, langs: list[str], weights: np.ndarray, bias: np.ndarray, trust: np.ndarray, sharp: float = 4.0) -> None:
        self.langs, self.w, self.bias, self.trust, self.sharp = langs, weights, bias, trust, sharp
        self.code = codewords(len(langs))
        self._ids: dict[str, int] = {}
        self._sums = np.zeros((1024, weights.shape[1]), np.float32)

    def _words(self, sents: list[list[str]]) -> np.ndarray:
        """Numbers of the words, whose summed weights are kept from block to block."""
        if len(self._ids) > KEPT_WORDS:
            self._ids.clear()
        old = len(self._ids)
        put = self._ids.setdefault
        flat = np.fromiter((put(w, len(self._ids)) for s in sents for w in s), np.int64)
        if len(self._ids) > old:
            new = list(self._ids)[old:] if old else list(self._ids)
            grams = [features(w) for w in new]
            starts = np.concatenate([[0], np.cumsum([len(g) for g in grams])[:-1]])
            if len(self._ids) > len(self._sums):
                grow = np.zeros((max(2 * len(self._sums), len(self._ids)), self._sums.shape[1]), np.float32)
                grow[:old] = self._sums[:old]
                self._sums = grow
            self._sums[old : len(self._ids)] = np.add.reduceat(self.w[np.fromiter((i for g in grams for i in g), np.int64)], starts, axis=0)
        return flat

    def losses(self, sents: list[list[str]]) -> np.ndarray:
        """Loss of each language (columns) for each sentence."""
        flat = self._words(sents)
        sizes = np.array([len(s) for s in sents])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        f = np.clip(np.add.reduceat(self._sums[flat], starts, axis=0) / sizes[:, None] + self.bias, -12, 12)
        one = np.log1p(np.exp(-f)) * self.trust  # loss of a bit that should be 1; of one that should be -1 it is f more
        return (one.sum(1, keepdims=True) + (f * self.trust) @ (self.code < 0).T.astype(np.float32)) / self.trust.sum()

    def predict(self, sents: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, confidence and losses of each sentence."""
        loss = self.losses(sents)
        p = np.exp(-self.sharp * (loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        best = loss.argmin(1)
        return best, p[np.arange(len(best)), best], loss


def calibrated(sents: list[list[str]], labels: np.ndarray, langs: list[str]) -> Model:
    """A model fitted to four fifths of the sentences; weights of the bits and the sharpness of confidences come from the rest.

    Where the rest has too few sentences, both come from all of them.
    """
    held = np.arange(len(sents)) % 5 == 4
    if held.sum() < 10 * len(langs):
        return fit(sents, labels, langs)
    model = fit([s for s, h in zip(sents, held, strict=True) if not h], labels[~held], langs)
    rest, y = [s for s, h in zip(sents, held, strict=True) if h], labels[held]
    flat = model._words(rest)
    sizes = np.array([len(s) for s in rest])
    f = np.add.reduceat(model._sums[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0) / sizes[:, None] + model.bias
    model.trust = _trust(((f * model.code[y]) > 0).mean(0))
    loss = model.losses(rest)
    gap = loss - loss[np.arange(len(y)), y][:, None]
    # the sharpness of the greatest likelihood, from a fixed grid
    model.sharp = float(min(np.geomspace(1.0, 32.0, 16), key=lambda k: np.log(np.exp(-k * gap).sum(1)).mean()))
    return model


def _trust(right: np.ndarray) -> np.ndarray:
    return np.log((right + 0.01) / (1.01 - right)).clip(0.1, 5).astype(np.float32)


def fit(sents: list[list[str]], labels: np.ndarray, langs: list[str], epochs: int = 8, rate: float = 0.5) -> Model:
    """Logistic regression of every bit at once, Adagrad over blocks of sentences."""
    code = codewords(len(langs))
    w, g2, bias = np.zeros((BUCKETS, BITS), np.float32), np.full((BUCKETS, BITS), 1e-4, np.float32), np.zeros(BITS, np.float32)
    memo: dict[str, list[int]] = {}
    per = [np.fromiter((i for x in s for i in (memo.get(x) or memo.setdefault(x, features(x)))), np.int64) for s in sents]
    size = np.array([len(s) for s in sents], np.float32)
    y = code[labels]
    freq = np.bincount(labels, minlength=len(langs)).astype(np.float32)
    weight = (len(labels) / np.maximum(freq, 1) / len(langs))[labels]
    rng = np.random.default_rng(3)
    epochs = max(epochs, -(-MIN_STEPS * 512 // max(1, len(sents))))  # a small sample takes more rounds
    for _ in range(min(epochs, max(MIN_STEPS, 1))):
        order = rng.permutation(len(sents))
        for at in range(0, len(order), 512):
            block = order[at : at + 512]
            ids = np.concatenate([per[i] for i in block])
            lens = np.array([len(per[i]) for i in block])
            owner = np.repeat(np.arange(len(block)), lens)
            starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
            f = np.add.reduceat(w[ids], starts, axis=0) / size[block][:, None] + bias
            err = -y[block] / (1 + np.exp(np.clip(y[block] * f, -30, 30))) * weight[block][:, None] / len(block)
            by = np.argsort(ids, kind="stable")
            sorted_ids = ids[by]
            heads = np.flatnonzero(np.concatenate([[True], sorted_ids[1:] != sorted_ids[:-1]]))
            grad = np.add.reduceat((err / size[block][:, None])[owner[by]], heads, axis=0)
            at_ids = sorted_ids[heads]
            g2[at_ids] += grad**2
            w[at_ids] -= rate * grad / np.sqrt(g2[at_ids])
            bias -= 0.1 * err.sum(0)
    f = np.stack([w[p].sum(0) for p in per]) / size[:, None] + bias if len(per) else np.zeros((0, BITS))
    right = ((f * y) > 0).mean(0) if len(per) else np.ones(BITS)
    return Model(langs, w, bias, _trust(right))


def consistent(sents: list[list[str]], labels: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the sentences whose words stand mostly under their own label.

    Wrong labels and mixed documents put a sentence under labels not its own;
    the share of a word in each label's words still points to its language, as
    most labels are right, where a classifier fitted to all would learn the noise.
    """
    ids: dict[str, int] = {}
    flat = np.fromiter((ids.setdefault(w, len(ids)) for s in sents for w in s), np.int64)
    sizes = np.array([len(s) for s in sents])
    owner = np.repeat(np.arange(len(sents)), sizes)
    counts = np.zeros((len(ids), n))
    np.add.at(counts, (flat, labels[owner]), 1.0)
    share = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * len(ids)))
    share[:, counts.sum(0) == 0] = -np.inf
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return np.flatnonzero(np.add.reduceat(share[flat], starts, axis=0).argmax(1) == labels)


def label_code(docs: DataFrame, labels: DataFrame, col: str = "lang") -> DataFrame:
    """``docs`` with ``label``: the code its ``lang`` names, null where it names none."""
    clean = lambda c: F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    names = labels.select(clean(F.col("label")).alias("_name"), F.col("lang").alias("label")).dropDuplicates(["_name"])
    return docs.withColumn("_name", clean(F.col(col))).join(names, "_name", "left").drop("_name")


def trained(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from the labelled documents; None where no label can be learnt."""
    w = W.partitionBy("label").orderBy(F.xxhash64("doc_id"))
    some = label_code(docs.where(F.length("text") > 20), labels).where(F.col("label").isNotNull())
    some = some.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= TRAIN_DOCS)
    rows = some.select("label", F.substring("text", 1, 6000).alias("text")).collect()
    langs = sorted({r["label"] for r in rows})
    if not langs:
        return None
    pairs = [(s, langs.index(r["label"])) for r in rows for s in sentences(r["text"])[:TRAIN_SENTENCES]]
    if not pairs:
        return None
    sents, y = [s for s, _ in pairs], np.array([i for _, i in pairs])
    keep = consistent(sents, y, len(langs))
    return calibrated([sents[i] for i in keep], y[keep], langs)


SEGMENT = "array<struct<segment: int, lang: string, confidence: double, sentences: int, ambiguous: int>>"


def segmented(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, label and ``segments``: runs of full sentences in one language."""
    share = docs.sparkSession.sparkContext.broadcast((model.langs, model.w, model.bias, model.trust, model.sharp))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(*share.value)
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                split = [sentences(t) for t in part["text"]]
                every = [s for d in split for s in d]
                if every:
                    best, conf, loss = m.predict(every)
                    two = np.partition(loss, 1, axis=1) if loss.shape[1] > 1 else np.c_[loss, loss + 1]
                    sure = (two[:, 1] - two[:, 0]) >= SURE
                out, k = [], 0
                for d in split:
                    n = len(d)
                    if not n:
                        out.append([])
                        continue
                    b, c, s = best[k : k + n].copy(), conf[k : k + n], sure[k : k + n]
                    if s.any() and not s.all():
                        there = np.unique(b[s])
                        b[~s] = there[loss[k : k + n][~s][:, there].argmin(1)]
                    runs = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])).tolist() + [n]
                    out.append(
                        [
                            (i, m.langs[b[x]], float(c[x:y].mean()), y - x, int((~s[x:y]).sum()))
                            for i, (x, y) in enumerate(zip(runs, runs[1:], strict=False))
                        ]
                    )
                    k += n
                yield pd.DataFrame({"doc_id": part["doc_id"], "label": part["label"], "segments": out})

    return docs.select("doc_id", "label", "text").mapInPandas(run, f"doc_id long, label string, segments {SEGMENT}")


def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = table(spark, sf_dir, "lang_labels")
    model = trained(docs, labels)
    labelled = label_code(spread(docs), labels)
    if model is None:
        return labelled.select("doc_id", "label", F.lit(None).cast(SEGMENT).alias("segments"))
    return segmented(labelled, model)


def languages(segments: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(segments, lambda s: s["lang"])))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p8_found: the languages of each document whose label is missing, unknown, wrong or not its only language."""
    langs = languages(F.col("segments"))
    d = _all(spark, sf_dir).select("doc_id", "label", langs.alias("langs")).where(F.size("langs") > 0)
    fine = F.coalesce((F.size("langs") == 1) & (F.col("langs")[0] == F.col("label")), F.lit(False))
    return d.where(~fine).select("doc_id", F.explode("langs").alias("lang_found"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p8_segments: language and confidence of each segment of every document."""
    return _all(spark, sf_dir).select("doc_id", F.inline("segments"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p8_documents: the main language of each document with a confidence; null without a full sentence."""
    total = F.aggregate("segments", F.lit(0), lambda a, s: a + s["sentences"])
    of = lambda x: F.filter("segments", lambda s: s["lang"] == x)
    size = lambda x: F.aggregate(of(x), F.lit(0), lambda a, s: a + s["sentences"])
    sure = lambda x: F.aggregate(of(x), F.lit(0.0), lambda a, s: a + s["sentences"] * s["confidence"])
    each = F.transform(languages(F.col("segments")), lambda x: F.struct(size(x).alias("n"), x.alias("lang"), (sure(x) / total).alias("confidence")))
    d = _all(spark, sf_dir).withColumn("langs", each).withColumn("main", F.array_max("langs"))
    return d.select("doc_id", "label", F.col("main.lang").alias("lang_found"), F.col("main.confidence").alias("confidence"), F.size("langs").alias("n_langs"))
