from __future__ import annotations

import random
from datetime import datetime as D

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trailmill.llm import history_dedup, language, mixing, split_overlap, tokens
from trailmill.llm.common import lexicon, worded
from trailmill.llm.goals import Lexicon, canonical, numbers, score, slips, words
from trailmill.llm.graph import SmallWorld


def rows(df):
    return sorted(tuple(r) for r in df.collect())


LEX = Lexicon({w: 50 for w in "book hotel pool nights guests night flight economy cheapest find reserve table restaurant".split()})
GOAL = "Book a hotel with a pool in Lake Pöprulk from February 4 at 9:30 pm for 6 nights and 4 guests, at most $1,580 per night."
SAME = [
    "please RESERVE hotel​ with pool in lake-poprulk from Feb 4th at 21:30 for six nights and 4 persons, no more than 1580 dollars per night - thank you",
    "From 4 February at 9.30pm, in Lake Pöprulk book a hotel with a pool for 4 guests and 6 nights, at most USD 1580.00 per night!",
]
OTHER = [
    GOAL.replace("6 nights and 4 guests", "4 nights and 6 guests"), GOAL.replace("February 4", "February 5"), GOAL.replace("Pöprulk", "Poprul"),
    GOAL.replace("9:30 pm", "9:30 am"), GOAL.replace("at most", "at least"), GOAL.replace("1,580", "1,590"), GOAL.replace("pool", "view"),
]


def test_same_and_other_tasks():
    assert canonical(SAME[1].replace("hotel", "hottel"), LEX) == canonical(GOAL, LEX)
    assert canonical(GOAL.replace("pool", "poll"), Lexicon(LEX.common, frozenset({"poll"}))) != canonical(GOAL, LEX)
    for s in SAME:
        assert canonical(s, LEX) == canonical(GOAL, LEX), set(canonical(s, LEX)) ^ set(canonical(GOAL, LEX))
    for o in OTHER:
        assert canonical(o, LEX) != canonical(GOAL, LEX)
    f = "find the cheapest economy flight from {} to {} on May 1"
    assert canonical(f.format("Upper Aaaaa", "Bbbbb"), LEX) != canonical(f.format("Bbbbb", "Upper Aaaaa"), LEX)
    assert canonical(None) is None and canonical(" ​\n") is None and canonical("!?") is None
    assert canonical("word " * 50_000) == ["word"]


def test_graph_recall_against_exhaustive_search():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(150, 32))
    x = (centres[rng.integers(0, 150, 3000)] + 0.35 * rng.normal(size=(3000, 32))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = SmallWorld(32)
    g.add(x)
    beam = g.tuned_beam()
    q = x[:300] + 0.02 * rng.normal(size=(300, 32)).astype(np.float32)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    best = (q @ x.T).argmax(1)
    ids, _ = g.search(q, beam)
    assert (ids == best[:, None]).any(1).mean() >= 0.9
    assert len(g.search(q[:3], 5)[0]) == 3 and SmallWorld(4).search(np.zeros((2, 4), np.float32), 3)[0].shape == (2, 0)


def _intents(goals):
    return [{"intent_id": k, "canonical_intent": t, "batch_no": b, "loaded_at": D(2025, 1, 1 + b)} for k, t, b in goals]


def test_history(spark, folder):
    goals = [("i5", GOAL, 0), ("i3", SAME[0], 1), ("i1", SAME[1], 1), ("i0", OTHER[0], 2), ("i9", OTHER[0].upper(), 2), ("n1", None, 0), ("n2", None, 1), ("b1", "  ", 0), ("b2", "  ", 1)]
    goals += [(f"h{i:03d}", "open the forum Abc", 3) for i in range(9)]  # a third and more of all rows
    again = {"intent_id": "i5", "canonical_intent": "something else", "batch_no": 4, "loaded_at": D(2025, 8, 1)}
    d = folder(extra=True, intents=[*_intents(goals), again], episode_traces=[{"task_id": "i5", "instruction": GOAL, "batch_no": 0, "loaded_at": D(2025, 1, 1)}])
    want = [("intent", "i3", "i5"), ("intent", "i1", "i5"), ("intent", "i0", "i9")] + [("intent", "h000", f"h{i:03d}") for i in range(1, 9)]
    assert rows(history_dedup.found(spark, d)) == sorted(want)


def test_empty(spark, folder):
    d = folder()
    for q in (history_dedup.found, split_overlap.found, split_overlap.report, tokens.found, tokens.summary, mixing.documents, mixing.shares, language.found, language.documents, language.segments):
        assert q(spark, d).count() == 0


def _points(spark, texts, lex=LEX):
    """Points of (batch, key, text)."""
    df = spark.createDataFrame([("intent", b, k, t) for b, k, t in texts], "kind string, batch int, key string, text string")
    return history_dedup.tokenised(worded(df, "text"), lex)


def _classes(pairs, keys):
    """The first key of the class of each key."""
    of = {k: k for k in keys}

    def root(k):
        while of[k] != k:
            k = of[k]
        return k

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        of[y] = x
    return {k: root(k) for k in keys}


def _pairs(links):
    return {(r["key"], r["to_key"]) for r in links.collect()}


def _name(rnd):
    return "".join(rnd.choice("bcdfghjklmnpqrstvwxz") + rnd.choice("aeiou") for _ in range(5))


@pytest.mark.parametrize("rest", ["in {} for 6 nights from May 4", "in {} and near {}"])
def test_batches_one_by_one_meet_their_history(spark, tmp_path, rest):
    """Each batch partitioned by itself, over a doubling of the parts, merged shards, slots, and an index opened anew."""
    rnd = random.Random(11)
    names = [[_name(rnd) for _ in range(rest.count("{}"))] for _ in range(400)]
    goal = lambda n, verb="Book": f"{verb} a room {rest.format(*n)}"
    batches = [[goal(n) for n in names[:40]], [goal(n, "please reserve") for n in rnd.sample(names[:40], 10)], [goal(n) for n in names[40:]]]
    batches += [[goal(n, "Could you bokk") for n in rnd.sample(names, 40)] for _ in range(2)]
    texts = [(b, f"{b}-{i:04d}", t) for b, ts in enumerate(batches) for i, t in enumerate(ts)]
    links = set()
    index = history_dedup.Index.create(spark, str(tmp_path / "index"), LEX, 40, partition_rows=32)
    for b in range(len(batches)):
        index = history_dedup.Index.open(spark, str(tmp_path / "index"))
        links |= _pairs(index.add(_points(spark, [t for t in texts if t[0] == b]), shard_points=24))
        index.compact(max_shards=2, shard_points=64, partition_rows=32)
    assert index.parts > 2 and index.generation
    by_task = {}
    for _, k, t in texts:
        by_task.setdefault(tuple(canonical(t, LEX)), []).append(k)
    want = _classes({(k, ks[0]) for ks in by_task.values() for k in ks}, [t[1] for t in texts])
    got = _classes(links, [t[1] for t in texts])
    assert got == want and len(set(want.values())) == 400


def test_search_of_real_goals_meets_exhaustive_scoring(spark):
    """Recall of the walked graph, tuned on goals, against scoring every pair of equal numbers."""
    df = history_dedup.arrivals(spark, "/root/testdata/sf0.01").where("text is not null")
    texts = worded(df, "text").cache()
    lex = lexicon(texts)
    rows = history_dedup.tokenised(texts, lex).dropDuplicates(["kind", "batch", "key"]).where("kind = 'intent'").toPandas()
    rows = rows.sort_values(["batch", "key"], kind="stable")
    shard = history_dedup.Shard(rows, lex.known)
    links = {(shard.key[i], shard.key[j]) for i, j in shard.build(lex)}
    assert shard.graph.walked(shard.beam)
    values = [" ".join(numbers(t.split(" "))) for t in rows["tokens"]]
    by = {}
    for i, v in enumerate(values):
        by.setdefault(v, []).append(i)
    want = {(shard.key[i], shard.key[j]) for ids in by.values() for i in ids for j in ids if j < i and score(shard.words[i], shard.words[j], lex) > 0}
    got, true = _classes(links, shard.key), _classes(want, shard.key)
    cases = [k for k in shard.key if true[k] != k]
    assert len(cases) > 50 and sum(got[k] != k for k in cases) >= 0.95 * len(cases) and links <= want


def test_score_needs_equal_values():
    lex = Lexicon(LEX.common)
    ws = lambda t: " ".join(words(t))
    assert history_dedup.score(ws(GOAL), ws(GOAL.replace("guests", "guesstts")), lex) > 0.6
    assert history_dedup.score(ws(GOAL), ws(GOAL.replace("hotel", "hootell")), Lexicon()) == 0
    for o in OTHER:
        assert history_dedup.score(ws(GOAL), ws(o), lex) == 0
    assert history_dedup.score(ws("show xyzzya"), ws("show xyzzyb"), lex) == 0


def test_slips_go_by_the_words_around_them():
    places = {"^ #": {"starting": 90, "sorting": 1}, "the _": {"forum": 80}, "at #": {"least": 80}}
    lex = Lexicon({"starting": 100, "sorting": 100, "forum": 100, "from": 200}, context=places)
    assert lex.right("storting", "^", "#") == "starting" and lex.right("frum", "the", "_") == "forum" and lex.right("frum") == "from"
    assert lex.right("last", "at", "#") == "least" and lex.right("last", "by", "#") == "last" and lex.right("Zu") == "Zu"
    assert slips("forum", "froum") == 1 and slips("days", "dsis") == 2 and slips("about", "xyzzy") == 3


def test_classes_settle_on_long_chains(spark):
    chain = [("intent", 1, f"{i:03d}", 1, f"{i - 1:03d}") for i in range(1, 120)]
    got = history_dedup.classes(spark.createDataFrame(chain, history_dedup.LINKS)).collect()
    assert len(got) == 120 and {r["accepted"]["key"] for r in got} == {"000"}
    with pytest.raises(RuntimeError):
        step = lambda d: d.select("a", (F.col("v") + 1).alias("v"), F.col("v").alias("was"))
        history_dedup.settled(spark.createDataFrame([(1, 1)], "a int, v int"), step, ["a"], "v", most=3)


def test_splits(spark, folder):
    t = lambda k, text, split, source="s": {"task_id": k, "instruction": text, "split": split, "source": source, "loaded_at": D(2025, 1, 1)}
    d = folder(extra=True, tasks=[
        t("a", GOAL, "Training "), t("b", GOAL.lower(), "train"), t("c", SAME[0], "test-domain"), t("d", SAME[1], "CROSS TASK", None), t("e", OTHER[1], "cross_task"),
        t("f", GOAL, "holdout"), t("g", GOAL, None), t("h", None, "train"), t("i", None, "cross_task"), t("j", "hi", "train"), t("k", "Hi!", "cross_website"), t(None, GOAL, "train"),
    ])
    got = rows(split_overlap.found(spark, d))
    assert set(got) >= {("a", "c"), ("b", "c"), ("a", "d"), ("b", "d")} and not any("e" in p or "f" in p or "g" in p for p in got)
    assert [tuple(r) for r in split_overlap.report(spark, d).where("split = 'cross_domain'").collect()] == [("cross_domain", "s", 2, 0, 1, 1.0)]
    assert [r["near_pairs"] for r in split_overlap.report(spark, d).where("split = 'cross_task' and source = 's'").collect()] in ([], [0], [2])


def test_candidates_lose_no_pair(spark):
    rnd = random.Random(3)
    base = [sorted({f"w{rnd.randrange(60)}" for _ in range(14)}) for _ in range(8)]
    docs = []
    for i in range(160):
        t = list(rnd.choice(base))
        if rnd.random() < 0.5:
            t = sorted(set(t) | {f"x{rnd.randrange(4)}"})
        docs.append((f"d{i}", "train" if i % 3 else "eval", "tokens", split_overlap.grams(t)))
    df = spark.createDataFrame(docs, "key string, side string, family string, grams array<long>")
    got = {(r["eval"], r["train"]) for r in split_overlap.candidates(df).collect()}
    want = {(a[0], b[0]) for a in docs if a[1] == "eval" for b in docs if b[1] == "train" and len(set(a[3]) & set(b[3])) / len(a[3]) >= 0.8}
    assert got == want and want


ENC = tokens.Encoder()


def test_ids_are_those_of_the_other_library():
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    for t in ["", "It's <|endoftext|> 1,5\n\n  a  ", "日本語と é̂ \u200b\x1c\x85", "x" * 9000, " " * 300 + "a", *OTHER]:
        assert ENC.batch([t])[0] == other.encode(t, add_special_tokens=False).ids


PIECE = st.sampled_from(["a", "'s", "'", "ll", " ", "  ", "\n", "1", "é", "日本", "<|endoftext|>", "​", "\x1c", "　", "!?", "²", "́", "�", "😀", "\x85", "_"])


@settings(max_examples=200, deadline=None)
@given(st.lists(PIECE, max_size=14).map("".join), st.integers(1, 6))
def test_tree_equals_whole(text, leaf):
    ids = ENC.encode(text, leaf)
    assert ids == ENC.batch([text])[0] and ENC.decode(ids) == text


@settings(max_examples=100, deadline=None)
@given(*[st.lists(PIECE, max_size=5).map("".join)] * 3)
def test_joining_is_associative(a, b, c):
    x, y, z = map(ENC.element, (a, b, c))
    one, two = ENC.join(ENC.join(x, y), z), ENC.join(x, ENC.join(y, z))
    assert ENC.close(one) == ENC.close(two) == ENC.close(ENC.element(a + b + c))
    assert ENC.close(ENC.join(ENC.element(""), x)) == ENC.close(x)


def _doc(i, text, source="a", lang=None):
    return {"doc_id": i, "text": text, "source": source, "lang": lang}


def test_ids(spark, folder):
    long = "word, 12 " * 30_000
    d = folder(extra=True, documents=[_doc(1, None), _doc(2, ""), _doc(3, "<|endoftext|>"), _doc(4, long), _doc(5, "x" * 20_000)])
    got = {r["doc_id"]: r["ids"] for r in tokens.found(spark, d).collect()}
    assert got[1] == got[2] == [] and 50256 not in got[3] and got[4] == ENC.batch([long])[0] and got[5] == ENC.batch(["x" * 20_000])[0]


def test_mixture_meets_targets(spark, folder):
    rnd = random.Random(2)
    docs = [_doc(i, "word " * rnd.randrange(1, 40), rnd.choice([" Big", "big"]) if i % 3 else "mid ") for i in range(900)]
    docs += [_doc(1000 + i, "tiny text here " * 3, "SMALL") for i in range(5)] + [_doc(2000, "x", None), _doc(2001, None, "big"), _doc(2002, "y", "unlisted"), _doc(2003, "long " * 5000, "big")]
    t = lambda s, w, m: {"mix_name": "m", "source": s, "weight": w, "max_repeats": m}
    d = folder(extra=True, documents=docs, mix_targets=[t("big", 5.0, 1), t("Mid", 4.0, 2), t("small ", 1.0, 3), t("gone", 2.0, 2), t("unlisted", 0.0, 4), t("unlisted", None, 4)])
    share = {r["source"]: r for r in mixing.shares(spark, d).collect()}
    for s in ("big", "mid", "small"):
        assert share[s]["actual_share"] == pytest.approx(share[s]["target_share"], abs=0.01)
    assert share["small"]["most_copies"] == 3 and share["gone"]["tokens"] == 0 and share["unlisted"]["documents"] == 0
    assert all(r["most_copies"] <= r["cap"] for r in share.values())
    sizes = mixing.token_sizes(spark, d)
    capped = mixing.rates(sizes, spark.read.parquet(f"{d}/mix_targets.parquet"), total=1e9).where("share > 0").collect()
    assert all(r["rate"] == pytest.approx(r["cap"]) for r in capped)


DE = ["Die Suche dauert heute leider etwas länger als gestern.", "Der Kalender zeigte den falschen Monat, obwohl niemand klickte.", "Wir haben beide Preise noch einmal sorgfältig verglichen."]
EN = ["The search takes a little longer than it did yesterday.", "The calendar showed the wrong month although nobody clicked.", "We have compared both of the prices carefully once more."]
FR = ["La recherche prend aujourd'hui un peu plus de temps qu'hier.", "Le calendrier affichait le mauvais mois sans aucune raison.", "Nous avons comparé les deux prix encore une fois avec soin."]


def test_languages(spark, folder):
    rnd = random.Random(5)
    docs = [_doc(i, " ".join(rnd.sample(pool, 3)), lang=code) for i, (pool, code) in enumerate([(DE, "de"), (EN, " EN"), (FR, "fr")] * 12)]
    docs += [_doc(100, " ".join(DE), lang="en"), _doc(101, " ".join([*DE, *EN]), lang="de"), _doc(102, FR[0], lang=None), _doc(103, EN[0].upper(), lang="xx")]
    docs += [_doc(104, None, lang="xx"), _doc(105, " ", lang=None), _doc(106, "a[1] = b[2]; https://x.y/z", lang=None), _doc(107, f"{EN[0]} After the click on “die Suche dauert länger” nothing changed at all.", lang="en")]
    labels = [{"label": k, "lang": v} for k, v in (("de", "de"), ("EN ", "en"), ("fr", "fr"))]
    d = folder(extra=True, documents=docs, lang_labels=labels)
    assert rows(language.found(spark, d)) == [(100, "de"), (101, "de"), (101, "en"), (102, "fr"), (103, "en")]
    seg = [tuple(r) for r in language.segments(spark, d).where("doc_id = 101").select("lang", "sentences").collect()]
    assert seg == [("de", 3), ("en", 3)]


def test_codewords_are_far_apart_and_split_every_bit():
    c = language.codewords(10)
    assert min((c[i] != c[j]).sum() for i in range(10) for j in range(i)) >= 7 and (np.abs(c.sum(0)) < 10).all()


def test_rates_are_tilted_by_size_and_meet_the_dual(spark):
    """Against bisection of the dual, a source at a time: one with more than it needs, one with less, one at its cap."""
    rnd = random.Random(4)
    sizes = [(i, s, int(rnd.lognormvariate(3, 1)) + 1) for i, s in enumerate("a" * 300 + "b" * 40 + "c" * 5)] + [(999, "a", 20_000)]
    df = spark.createDataFrame(sizes, "doc_id long, source string, n_tokens int")
    targets = spark.createDataFrame([("m", s, w, c) for s, w, c in (("A ", 1.0, 3), ("b", 2.0, 4), ("c", 0.1, 2))], "mix_name string, source string, weight double, max_repeats int")
    solved = {r["source"]: r for r in mixing.rates(df, targets).collect()}
    for s, r in solved.items():
        ns = [n for _, x, n in sizes if x == s]
        lo, hi = -1e3, 1e3
        for _ in range(200):
            mid = (lo + hi) / 2
            if sum(n * min(r["cap"], np.exp(min(50, mid * n / r["unit"]))) for n in ns) < r["want"]:
                lo = mid
            else:
                hi = mid
        assert min(r["lam"], 1e3) == pytest.approx(hi, abs=0.03) or r["want"] == pytest.approx(r["cap"] * r["have"])
    got = mixing.copies(df, mixing.rates(df, targets)).collect()
    tilt = {r["n_tokens"]: r["rate"] for r in got if r["source"] == "a"}
    assert len(set(tilt.values())) > 5 and max(r["copies"] for r in got) <= 4
    for s, r in solved.items():
        assert sum(g["copies"] * g["n_tokens"] for g in got if g["source"] == s) == pytest.approx(r["want"], rel=0.01, abs=10)  # five documents meet 213 tokens by 219
