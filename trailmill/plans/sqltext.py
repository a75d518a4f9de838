"""SQL snippets for the text functions, written for DuckDB."""

from __future__ import annotations

from ..functions import text as T

WS = "[ \\t\\n\\v\\f\\r\\x85\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(ws: list[str] | tuple[str, ...]) -> str:
    return "[" + ", ".join(q(w) for w in ws) + "]"


def collapse(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{WS}', ' ', 'g'))"


def normal_text(x: str) -> str:
    t = f"lower(coalesce({x}, ''))"
    for one, several in T.LIGATURES.items():
        t = f"replace({t}, '{one}', '{several}')"
    return collapse(f"translate({t}, {q(T.FROM)}, {q(T.TO)})")


def normal_key(x: str) -> str:
    return collapse(f"regexp_replace(lower({collapse(x)}), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s:/.-]+', ' ', 'g')")


def token_set(x: str) -> str:
    t = f"regexp_extract_all({normal_text(x)}, '{T.TOKEN}')"
    parts = f"flatten(list_transform({t}, lambda t: [t] || string_split(t, '-') || string_split(t, '_') || string_split(t, '/') || string_split(t, ':')))"
    every = f"flatten(list_transform({parts}, lambda p: case when length(p) > 3 and p like '%s' and p not like '%ss' then [p, left(p, length(p) - 1)] else [p] end))"
    drop = words(["", *T.STOP_WORDS, *T.LAYOUT_WORDS])
    return f"list_filter(list_distinct({every}), lambda p: not list_contains({drop}, p))"


def space_tokens(x: str) -> str:
    return f"list_distinct(list_filter(string_split({collapse(f'lower(coalesce({x}, {q(str())}))')}, ' '), lambda t: t <> ''))"


def word_tokens(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all({normal_key(x)}, '[\\p{{L}}\\p{{M}}\\p{{N}}_.-]+'), lambda t: length(t) > 1))"


def evidence_tokens(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all({normal_key(x)}, '[a-z0-9_./-]+'), lambda t: length(t) > 1))"


def shared(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def jaccard(a: str, b: str, both_empty: float = 0.0) -> str:
    return f"(case when len({a}) + len({b}) = 0 then {both_empty} else {shared(a, b)}::double / (len({a}) + len({b}) - {shared(a, b)}) end)"


def set_cosine(a: str, b: str) -> str:
    return f"(case when len({a}) * len({b}) = 0 then 0.0 else {shared(a, b)} / sqrt((len({a}) * len({b}))::double) end)"


def contradiction(c: str, o: str, tc: str, to: str) -> str:
    cond, obs = f"replace({normal_text(c)}, '-', ' ')", f"replace({normal_text(o)}, '-', ' ')"
    hits = []
    for word, opposites in T.CONTRADICTIONS.items():
        plain = word.replace("-", " ")
        there = f"(list_contains({tc}, '{word}') or contains({cond}, '{plain}'))"
        for op in opposites:
            against = f"(list_contains({to}, '{op}') or contains({obs}, '{op.replace('-', ' ')}') or contains({obs}, 'not {plain}'))"
            hits.append(f"({there} and {against})::int")
    return f"least(1.0, ({' + '.join(hits)})::double / greatest(1, len({tc})))"


def contains_any(x: str, ws: list[str]) -> str:
    return "(" + " or ".join(f"contains({x}, {q(w)})" for w in ws) + ")"


def first_group(x: str, groups: dict[str, list[str]], default: str) -> str:
    cases = " ".join(f"when {contains_any(x, ws)} then {q(n)}" for n, ws in groups.items())
    return f"(case {cases} else {q(default)} end)"
