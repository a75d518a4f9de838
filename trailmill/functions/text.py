"""Text functions as Column expressions: token sets, similarities, normal forms.

Six token definitions stay apart because their users do: ``token_set``
(retrieval and conditions), ``space_tokens`` (near duplicates of records),
``word_tokens`` (descriptors), ``evidence_tokens`` (steps), and the two keys
``normal_text`` and ``normal_key``.  All are built-ins; of the compatibility
normal form, which the engine lacks, ``normal_text`` takes what becomes one
ASCII character and the Latin ligatures; marks are not composed.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words and pairs that the scores depend on
STOP_WORDS = "a an and are as at be by for from in is it of on or that the to with".split()
LAYOUT_WORDS = "area box container content div element footer header layout main nav panel section span wrapper".split()
CONTRADICTIONS = {
    "visible": ("hidden", "invisible", "missing", "absent"),
    "enabled": ("disabled", "inactive"),
    "open": ("closed",),
    "opened": ("closed",),
    "selected": ("unselected", "deselected"),
    "checked": ("unchecked",),
    "available": ("unavailable",),
    "success": ("error", "failed", "failure"),
    "completed": ("incomplete", "pending"),
    "logged-in": ("logged-out",),
    "logged": ("logged-out",),
}
PUNCTUATION = "!\"#$%&'()*+,.;<=>?@[\\]^`{}~"
TOKEN = "[a-z0-9]+(?:[-_/:][a-z0-9]+)*"


# characters whose compatibility form is one ASCII character (full width, superscripts, letter-like ...), by rule
COMPATIBLE = {c: n.lower() for c in map(chr, range(0x80, 0xFFFF)) if len(n := unicodedata.normalize("NFKC", c)) == 1 and n.isascii()}
LIGATURES = {c: unicodedata.normalize("NFKC", c) for c in map(chr, range(0xFB00, 0xFB07))}
FROM = PUNCTUATION + "".join(COMPATIBLE)
TO = " " * len(PUNCTUATION) + "".join(" " if n in PUNCTUATION else n for n in COMPATIBLE.values())


def blank(c: Column) -> Column:
    """Null as an empty text."""
    return F.coalesce(c, F.lit(""))


def collapse(c: Column) -> Column:
    """White space of any kind as one space, trimmed."""
    return F.trim(F.regexp_replace(blank(c), r"(?U)\s+", " "))


def clean(c: Column, limit: int) -> Column:
    return F.substring(collapse(c), 1, limit)


def normal_text(c: Column) -> Column:
    """Lower case, compatible ASCII characters in place of their variants, punctuation but ``-_/:|`` as spaces, collapsed."""
    t = F.lower(blank(c))
    for one, several in LIGATURES.items():
        t = F.replace(t, F.lit(one), F.lit(several))
    return collapse(F.translate(t, FROM, TO))


def normal_key(c: Column) -> Column:
    """Collapsed lower case with only word characters and ``:/.-``."""
    return collapse(F.regexp_replace(F.lower(collapse(c)), r"(?U)[^\w\s:/.-]+", " "))


def token_set(c: Column) -> Column:
    """Distinct tokens with singulars and parts at separators, without stop and layout words; null gives none."""
    tokens = F.regexp_extract_all(normal_text(c), F.lit(f"({TOKEN})"), F.lit(1))
    parts = F.flatten(F.transform(tokens, lambda t: F.concat(F.array(t), *[F.split(t, s) for s in "-_/:"])))

    def singular(t: Column) -> Column:
        plural = (F.length(t) > 3) & t.endswith("s") & ~t.endswith("ss")
        return F.when(plural, F.array(t, t.substr(F.lit(1), F.length(t) - 1))).otherwise(F.array(t))

    every = F.array_distinct(F.flatten(F.transform(parts, singular)))
    return F.array_except(every, F.array(*[F.lit(w) for w in ["", *STOP_WORDS, *LAYOUT_WORDS]]))


def space_tokens(c: Column) -> Column:
    """Distinct lower-case words between white space."""
    return F.array_distinct(F.filter(F.split(collapse(F.lower(blank(c))), " "), lambda t: t != ""))


def word_tokens(c: Column) -> Column:
    """Distinct runs of word characters, dots and hyphens longer than one."""
    return F.array_distinct(F.filter(F.regexp_extract_all(normal_key(c), F.lit(r"(?U)([\w.-]+)"), F.lit(1)), lambda t: F.length(t) > 1))


def evidence_tokens(c: Column) -> Column:
    """Distinct ASCII runs with ``_./-`` longer than one."""
    return F.array_distinct(F.filter(F.regexp_extract_all(normal_key(c), F.lit("([a-z0-9_./-]+)"), F.lit(1)), lambda t: F.length(t) > 1))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Shared part of the union of two arrays without repeats; empty on one side gives 0, on both ``both_empty``."""
    n = F.size(a) + F.size(b)
    # the intersection is named once, as it is the dear part
    share = F.get(F.transform(F.array(F.size(F.array_intersect(a, b))), lambda i: i / (n - i)), F.lit(0))
    return F.when(n == 0, F.lit(both_empty)).otherwise(share)


def set_cosine(a: Column, b: Column) -> Column:
    """Cosine of 0/1 vectors; 0 where a set is empty."""
    n = F.size(a) * F.size(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.sqrt(n.cast("double")))


def overlap(a: Column, b: Column) -> Column:
    """Overlap of a condition's and an observation's token sets."""
    return jaccard(a, b, both_empty=1.0)


def plain_text(c: Column) -> Column:
    """``normal_text`` with hyphens as spaces."""
    return F.replace(normal_text(c), F.lit("-"), F.lit(" "))


def contradiction(cond: Column, obs: Column, tokens: Column, seen: Column) -> Column:
    """Share of the condition's tokens contradicted by the observation, at most 1.

    ``cond`` and ``obs`` are ``plain_text``, ``tokens`` and ``seen`` the token sets of the two.
    """
    hits = []
    for word, opposites in CONTRADICTIONS.items():
        plain = word.replace("-", " ")
        there = F.array_contains(tokens, word) | F.contains(cond, F.lit(plain))
        for opposite in opposites:
            against = F.array_contains(seen, opposite) | F.contains(obs, F.lit(opposite.replace("-", " "))) | F.contains(obs, F.lit(f"not {plain}"))
            hits.append((there & against).cast("int"))
    total = sum(hits[1:], hits[0])
    return F.least(F.lit(1.0), total / F.greatest(F.lit(1), F.size(tokens)))


def contains_any(text: Column, words: list[str]) -> Column:
    hit = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        hit = hit | F.contains(text, F.lit(w))
    return hit
