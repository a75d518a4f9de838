"""Encoding of whole texts with a public tokenizer, as a tree reduction of a monoid.

The tokenizer cuts a text into pretokens and encodes each by itself.  Between
some pairs of characters a pretoken ends whatever stands around them
(``_stable``).  An element of the monoid is

* a fragment without such a place, kept as text, or
* (left fragment, ids between the first and the last such place, right fragment).

The ids inside are final: no text put before or behind can change them.
Joining two elements re-encodes the window that the right fragment of one and
the left fragment of the other form; a window in which no stable place shows
up stays open and grows with the next join.  The empty text is the neutral
element and joining is associative, so halves may be encoded anywhere and in
any grouping.

Empty and null texts give an empty list.  Strings of special tokens in a text
are ordinary text.
"""

from __future__ import annotations

import base64
import itertools
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, table

TOKENIZERS = "/opt/tokenizers"
LEAF = 8192  # characters; longer texts are halved
# fixed value: the pattern of pretokens of this vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _kind(c: str) -> str:
    """White space, letter, number or other, as the pretoken pattern sees a character."""
    if c.isspace():
        return "s"
    k = unicodedata.category(c)[0]
    return k if k in "LN" else "o"


def _stable(a: str, b: str) -> bool:
    """Whether a pretoken ends between ``a`` and ``b`` in every text.

    A pretoken takes white space only as its first character or as nothing
    else, runs hold letters, numbers or others only, and a contraction starts
    with an apostrophe and holds letters behind it.
    """
    x, y = _kind(a), _kind(b)
    if x == "s" or a in "\x1c\x1d\x1e\x1f" or b in "\x1c\x1d\x1e\x1f":
        return False
    if y == "s":
        return True
    return x != y and x in "LN" and not (x == "L" and y == "L")


class Encoder:
    """The byte-level vocabulary of a public tokenizer, from its file of ranks."""

    def __init__(self, path: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken") -> None:
        import tiktoken

        with open(os.path.join(path, name), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self._t = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def batch(self, texts: list[str]) -> list[list[int]]:
        return [self._t.encode_ordinary(t) for t in texts]

    def decode(self, ids: list[int]) -> str:
        return self._t.decode(ids)

    # --- the monoid ---
    def element(self, text: str) -> tuple:
        """(text,) without a stable place, else (left, ids, right)."""
        first = next((i for i in range(1, len(text)) if _stable(text[i - 1], text[i])), None)
        if first is None:
            return (text,)
        last = next(i for i in range(len(text) - 1, 0, -1) if _stable(text[i - 1], text[i]))
        return (text[:first], self.batch([text[first:last]])[0] if last > first else [], text[last:])

    def join(self, a: tuple, b: tuple) -> tuple:
        """Encoding of the concatenation: only the window at the border is encoded again."""
        if len(a) == 1 and len(b) == 1:
            return self.element(a[0] + b[0])
        window = self.element((a[0] if len(a) == 1 else a[2]) + b[0])
        if len(window) == 1:  # still open: grows into the next join
            if len(a) == 1:
                return (window[0], b[1], b[2])
            return (a[0], a[1], window[0]) if len(b) == 1 else (a[0], a[1] + self.batch(window)[0] + b[1], b[2])
        left, ids, right = window
        if len(a) == 1:
            return (left, ids + self.batch([right])[0] + b[1], b[2])
        ids = a[1] + self.batch([left])[0] + ids
        return (a[0], ids, right) if len(b) == 1 else (a[0], ids + self.batch([right])[0] + b[1], b[2])

    def close(self, a: tuple) -> list[int]:
        """The ids once nothing more stands on either side."""
        if len(a) == 1:
            return self.batch([a[0]])[0] if a[0] else []
        left, right = self.batch([a[0], a[2]])
        return left + a[1] + right

    def tree(self, text: str, leaf: int = LEAF) -> tuple:
        if len(text) <= leaf:
            return self.element(text)
        half = len(text) // 2
        return self.join(self.tree(text[:half], leaf), self.tree(text[half:], leaf))

    def encode(self, text: str | None, leaf: int = LEAF) -> list[int]:
        if not text:
            return []
        return self.batch([text])[0] if len(text) <= leaf else self.close(self.tree(text, leaf))


def encoded(docs: DataFrame, path: str = TOKENIZERS, leaf: int = LEAF, count_only: bool = False) -> DataFrame:
    """``docs`` (doc_id, text, others kept) with ``ids``, or with their number ``n_tokens``.

    A map over Arrow batches, without a shuffle.  A text up to ``leaf``
    characters is the one leaf of its tree.
    """
    keep = [c for c in docs.columns if c != "text"]
    out = "n_tokens" if count_only else "ids"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids = [encoder.encode(t, leaf) for t in part.column(len(keep)).to_pylist()]
                sizes = np.fromiter(map(len, ids), np.int32, len(ids))
                if count_only:
                    made = pa.array(sizes)
                else:
                    flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(sizes.sum()))
                    made = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], made], [*keep, out])

    return spread(docs.select(*keep, "text")).mapInArrow(run, f"{schema}, {out} {'int' if count_only else 'array<int>'}")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p6_ids: doc_id and ids of every document."""
    return encoded(table(spark, sf_dir, "documents").select("doc_id", "text"))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, empty documents and tokens by label and memory level."""
    docs = table(spark, sf_dir, "documents").select("memory_level", "text")
    n = encoded(docs, count_only=True)
    return n.groupBy("memory_level").agg(
        F.count("*").alias("documents"), F.sum((F.col("n_tokens") == 0).cast("int")).alias("empty"), F.sum("n_tokens").alias("tokens")
    )
