"""Canonical form of a recorded goal: which action, with which values.

Two goals are the same task when they ask for the same action with the same
values.  ``canonical`` turns a text into a set of tokens in which everything
that does not count has been removed: case, accents, invisible characters,
punctuation, ways of writing dates, times, numbers and amounts, articles,
polite and framing words, everyday synonyms, and (with a ``Lexicon``) slips of
spelling in words that are no values, put right by the words around them.  Numbers stay bound to the noun they
count and names stay bound to ``from`` / ``to``, so exchanged values differ.

``score`` decides a pair: it is the share of canonical tokens in common, 0
unless the two are the same task once the slips of each are put right to
words of the other.

Null, empty and blank texts have no canonical form (``None``) and are never
the same as anything.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass, field

# --- fixed values: words of English that carry no value in a request ---------
MONTHS = (
    "january february march april may june july august september october november december"
).split()
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    " fifteen sixteen seventeen eighteen nineteen twenty"
).split()
STOP_WORDS = frozenset(
    """a an the and or of for in on at by with is are be as it its them this that these those to
    from please kindly can could would you i we me my our need want like help user request goal
    task thanks thank cheers asap okay ok hi hello hey possible if all just now so then there
    id d ll re s t will shall should do does today instruction agent here try let us soon
    quickly right away when go also too per each every some any which whose who what where how
    have has had been was were make sure must might may after before during while into onto""".split()
)
FRAMING = re.compile(
    r"\((?:as discussed|as before|thanks|please)\)|\bas (?:discussed|soon as possible)\b|\bif possible\b"
    r"|\bthat is all\b|\bthat's all\b|\bfor me\b|\bthank you\b|\bmany thanks\b|\bwould like(?: you)? to\b"
    r"|\b(?:my goal|user request|goal|task|request|instruction)\s*:|\b(?:(?:small|quick|little|big) )?favou?r\s*:"
)
PHRASES = (  # everyday ways of saying the same thing; the first that fits at a place counts
    (r"(?:least expensive|least costly|lowest priced|lowest price)", "cheapest"),
    (r"(?:no|not) (?:less|fewer|lower) than|(?:no|not) (?:under|below)|a minimum of|minimum|or more", "least"),
    (r"(?:no|not) (?:more|greater|higher) than|(?:no|not) (?:over|above|exceeding)|a maximum of|maximum|up to|or less", "most"),
    (r"(?:less|lower|cheaper|fewer) than|under|below", "under"),
    (r"(?:more|greater|higher) than|over|above", "over"),
    (r"(?:open|go to|navigate to|visit|in|on|at)(?: the)? forum", "forum"),
    (r"(?:look|search|looking|searching) for", "find"),
    (r"form(?= #| from)", ""),
    (r"(?:sort|sorting|sorted|order|ordering|ordered) by", "sort"),
)
SYNONYMS = {
    "book": "reserve", "hire": "rent", "persons": "people", "person": "people", "basket": "cart", "trolley": "cart",
    "purchase": "buy", "display": "show", "give": "assign", "allocate": "assign", "pick": "choose", "select": "choose",
    "get": "buy", "guests": "people", "guest": "people", "passengers": "people", "passenger": "people",
    "travellers": "people", "travelers": "people", "adults": "people", "ticket": "tickets", "day": "days",
    "answer": "reply", "respond": "reply", "deliver": "ship", "send": "ship", "locate": "find", "departing": "leaving",
    "flights": "flight", "put": "add", "tagged": "labelled", "labeled": "labelled", "authored": "written",
}
DROPPED = frozenset("written made posted leaving starting about regarding concerning change costing forum".split())
OTHER_WORDS = frozenset(
    "look search looking searching visit last list over above below minimum maximum no not less more than most least forum sort lowest priced price expensive costly favour favor small".split()
)
# ------------------------------------------------------------------------------

_ZERO_WIDTH = re.compile("[​-‏⁠﻿­]")
_MONTH = {m: i for i, m in enumerate(MONTHS, 1)} | {m[:3]: i for i, m in enumerate(MONTHS, 1)} | {"sept": 9}
_NUMBER = {w: str(i) for i, w in enumerate(NUMBER_WORDS)}
_M = "|".join(sorted(_MONTH, key=len, reverse=True))
_TIME = re.compile(r"\b(\d{1,2})(?:[:.](\d{2}))?\s*([ap])\.?\s?m\b\.?|\b([01]?\d|2[0-3])[:](\d{2})\b")
_DATE = re.compile(
    rf"\b(?:({_M})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?|(?:the\s+)?(\d{{1,2}})(?:st|nd|rd|th)?\s+(?:of\s+)?({_M}))\b(?![:.]?\d)"
)
_ISO = re.compile(r"\b\d{4}-(\d{2})-(\d{2})\b")
_MONEY = re.compile(
    r"(?:\$|\busd|\beur|€|£|\bus\$)\s*(\d[\d,]*(?:\.\d+)?)|(\d[\d,]*(?:\.\d+)?)\s*(?:us\s+)?(?:dollars?|usd|bucks|\$)"
)
_NUM_WORD = re.compile(r"\b(" + "|".join(_NUMBER) + r")\b")
_PHRASE = re.compile(r"(?<!\S)(?:" + "|".join(f"({p})" for p, _ in PHRASES) + r")(?!\S)")
_TOKEN = re.compile(r"[a-z0-9#]+(?:\.\d+)?")


def plain(text: str) -> str:
    """Lower case, without accents and invisible characters, white space collapsed."""
    if text.isascii():
        return " ".join(text.lower().split())
    t = unicodedata.normalize("NFKD", text)
    t = "".join(c for c in t if not unicodedata.combining(c)).lower()
    return " ".join(_ZERO_WIDTH.sub("", t).split())


def _time(m: re.Match) -> str:
    if m[3]:
        h = int(m[1]) % 12 + (12 if m[3] == "p" else 0)
        return f" #t{h:02d}{m[2] or '00'} "
    return f" #t{int(m[4]):02d}{m[5]} "


def _amount(x: str) -> str:
    x = x.replace(",", "")
    return x.rstrip("0").rstrip(".") if "." in x else x


def words(text: str | None) -> list[str] | None:
    """Tokens in order, with dates, times, amounts and numbers in one form."""
    if text is None:
        return None
    t = plain(text)
    t = FRAMING.sub(" ", t)
    t = _NUM_WORD.sub(lambda m: _NUMBER[m[1]], t.replace("-", " "))
    t = _TIME.sub(_time, t)
    t = _ISO.sub(lambda m: f" #d{m[1]}{m[2]} ", t)
    t = _DATE.sub(lambda m: f" #d{_MONTH[m[1] or m[4]]:02d}{int(m[2] or m[3]):02d} ", t)
    t = _MONEY.sub(lambda m: f" #m{_amount(m[1] or m[2])} ", t)
    t = re.sub(r"(?<=\d),(?=\d{3}\b)", "", t)
    t = re.sub(r"\bnoon\b|\bmidday\b", " #t1200 ", t)
    return _TOKEN.findall(t) or None


NAME, VALUE, START, END = "_", "#", "^", "$"  # classes of words that are not known, and the ends of a text


@dataclass
class Lexicon:
    """The words of all goals that are no values: what slips are put right to.

    ``common`` maps a word to the number of texts that hold it; it is counted
    over a whole corpus and only words over a share of all texts stay, so
    its size has a bound (1 / share words per position of a text).  ``usual``
    are less common words that are too frequent for slips: they stay as they are.
    ``context`` maps the classes of the words before and behind a place to the
    words that stand there, with their counts.
    """

    common: dict[str, int] = field(default_factory=dict)
    usual: frozenset[str] = frozenset()
    context: dict[str, dict[str, int]] = field(default_factory=dict)
    _memo: dict[str, dict[str, int]] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        self.known = dict.fromkeys(base_words(), 1) | self.common
        self._deletes: dict[str, list[str]] = {}
        for w in self.known:
            if len(w) > 2:
                for k in _deleted(w, 2 if len(w) > 3 else 1):
                    self._deletes.setdefault(k, []).append(w)

    def near(self, w: str) -> dict[str, int]:
        """The known words one slip away from ``w``, or two where both are longer than three, with the number of slips."""
        if (hit := self._memo.get(w)) is None:
            there = {c for k in _deleted(w, 2 if len(w) > 3 else 1) for c in self._deletes.get(k, ())}
            hit = {c: d for c in there if c != w and (d := slips(w, c)) <= (2 if min(len(c), len(w)) > 3 else 1)}
            if len(self._memo) < 500_000:
                self._memo[w] = hit
        return hit

    def kind(self, w: str) -> str:
        """The word itself if it is known, else its class."""
        if w in self.known:
            return w
        return VALUE if w[0] == "#" or w[0].isdigit() else NAME

    def right(self, w: str, before: str = "", behind: str = "") -> str:
        """The word meant by ``w`` between words of these classes.

        A word that is not known becomes the near one that stands there at
        least twice as often as names do, else the most common one a single
        slip away.  A known one becomes another only where it hardly ever
        stands and the other, a single slip away, mostly does.
        """
        if len(w) < 3 or w[0].isdigit() or w[0] == "#" or w in self.usual or not (near := self.near(w)):
            return w
        there = self.context.get(f"{before} {behind}", {})
        if w in self.known:
            best = max((c for c, d in near.items() if d == 1), key=lambda c: (there.get(c, 0), c), default=None)
            return best if best and there.get(best, 0) >= 50 * max(1, there.get(w, 0)) else w
        fit = [c for c in near if there.get(c, 0) >= 2 * there.get(NAME, 0) and c in there]
        if fit:
            return min(fit, key=lambda c: (near[c], -there[c], c))
        one = [c for c, d in near.items() if d == 1]
        return max(one, key=lambda c: (c[0] == w[0], self.known[c], c)) if one else w

    def corrected(self, ws: list[str]) -> list[str]:
        """The words with slips put right, from the left."""
        out: list[str] = []
        before = START
        for i, w in enumerate(ws):
            w = self.right(w, before, self.kind(ws[i + 1]) if i + 1 < len(ws) else END)
            out.append(w)
            before = self.kind(w)
        return out


def base_words() -> set[str]:
    """The words that the rules above name."""
    return STOP_WORDS | OTHER_WORDS | DROPPED | set(SYNONYMS) | set(SYNONYMS.values()) | set(MONTHS) | set(NUMBER_WORDS)


def _deleted(w: str, n: int) -> set[str]:
    """``w`` and what stays of it without up to ``n`` letters."""
    out = last = {w}
    for _ in range(n):
        last = {x[:i] + x[i + 1 :] for x in last for i in range(len(x))}
        out = out | last
    return out


def slips(a: str, b: str, most: int = 2) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between two words; ``most + 1`` if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


def canonical(text: str | None, lexicon: Lexicon | None = None) -> list[str] | None:
    """Sorted canonical tokens of a goal; None for null, blank or wordless texts."""
    ws = words(text)
    return None if ws is None else canonical_words(ws, lexicon)


def canonical_words(ws: list[str], lexicon: Lexicon | None = None) -> list[str] | None:
    """Sorted canonical tokens of the words of a goal."""
    t = " ".join(ws)
    if lexicon is not None:
        fixed = " ".join(lexicon.corrected(ws))
        if fixed != t:  # a slip put right may complete a phrase
            t = _NUM_WORD.sub(lambda m: _NUMBER[m[1]], FRAMING.sub(" ", fixed))
    ws = _PHRASE.sub(lambda m: PHRASES[m.lastindex - 1][1], t).split()
    starts: set[int] = set()
    for i, w in enumerate(ws):  # from A to B: the values that prepositions tell apart
        if w == "from":
            for j in range(i + 2, min(i + 5, len(ws) - 1)):
                if ws[j] == "to" and ws[j + 1] not in STOP_WORDS:
                    starts.update(range(i + 1, j))
                    break
    out: set[str] = set()
    for i, w in enumerate(ws):
        w = SYNONYMS.get(w, w)
        if w in STOP_WORDS or w in DROPPED:
            continue
        if w[0] == "#":
            out.add(w)
        elif w[0].isdigit():
            nxt = SYNONYMS.get(ws[i + 1], ws[i + 1]) if i + 1 < len(ws) else ""
            if not nxt or nxt in STOP_WORDS or not nxt[0].isalpha():
                nxt = SYNONYMS.get(ws[i - 1], ws[i - 1]) if i else ""
            out.add(f"{_amount(w)}:{nxt}")
        elif len(w) > 2:
            out.add("from:" + w if i in starts else w)
    return sorted(out) or None


def numbers(tokens: Iterable[str]) -> list[str]:
    """The numbers, dates, times and amounts, without what they count: equal for the same task."""
    return sorted(t.partition(":")[0] for t in tokens if t[0] == "#" or t[0].isdigit())


def names(tokens: Iterable[str], lexicon: Lexicon) -> list[str]:
    """The tokens that are neither numbers nor known words, nor may be slips of one: equal for the same task."""
    return [t for t in tokens if t[0].isalpha() and t not in lexicon.known and not lexicon.near(t.removeprefix("from:"))]


def score(a: str, b: str, lexicon: Lexicon, least: float = 0.6) -> float:
    """How alike two goals (their words, joined by spaces) are if they are the same task, else 0.

    The share is that of the canonical tokens in common (twice their number
    over the sum of both).  Tokens that differ must come from slips: each
    word that is not known and stands in one text only is put right to the
    nearest known word of the other text, and then all tokens must be equal.
    """
    one, two = a.split(), b.split()
    x, y = canonical_words(one, lexicon) or [], canonical_words(two, lexicon) or []
    if x == y:
        return 1.0
    alike = 2 * len(set(x) & set(y)) / (len(x) + len(y))
    if alike < least or numbers(x) != numbers(y):
        return 0.0
    one_right, two_right = _towards(one, two, lexicon), _towards(two, one, lexicon)
    if one_right == one and two_right == two:
        return 0.0
    return alike if canonical_words(one_right, lexicon) == canonical_words(two_right, lexicon) else 0.0


def _towards(ws: list[str], other: list[str], lexicon: Lexicon) -> list[str]:
    """``ws`` with words that are not known put right to the nearest known word that only ``other`` has."""
    mine, out = set(ws), []
    theirs = (set(other) | set(lexicon.corrected(other))) - mine
    for w in ws:
        if w[0].isalpha() and len(w) > 2 and w not in lexicon.known and w not in other:
            near = {c: d for c, d in lexicon.near(w).items() if c in theirs}
            if near:
                w = min(near, key=lambda c: (near[c], c))
        out.append(w)
    return out
