"""Contaminated texts against a plain search, re-parameterised questions, and odd rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import decontaminate as dc

QUESTION = "Today Anna buys 5 apples and 3 pears, then Bob gives Anna 5 more apples for 12 dollars, so how many fruits does she carry home?"


def plain_windows(text):
    """(at, window, slots) of both forms."""
    out = []
    toks = [(m.group(), m.start()) for m in re.finditer(r"[^\W\d_]+|[0-9]+(?:[.,][0-9]+)*", text or "")]
    named = [bool(re.match(r"[A-ZÀ-Þ][a-zß-ÿ]", w)) and a >= 2 and text[a - 1] == " " and bool(re.match(r"[^\W_]|[,;]", text[a - 2])) for w, a in toks]
    words = [w.lower() for w, _ in toks]
    base = ["<num>" if w[0].isdigit() else "<unit>" if w in dc.UNITS and i and words[i - 1][0].isdigit() else w for i, w in enumerate(words)]
    for form in (base, ["<name>" if n else x for n, x in zip(named, base, strict=True)]):
        for i in range(len(form) - dc.WINDOW + 1):
            w = form[i : i + dc.WINDOW]
            if form is not base and "<name>" not in w:
                continue
            if sum(x[0] != "<" for x in w) >= dc.LITERAL:
                out.append((i + 1, tuple(w), [words[i + k] for k, x in enumerate(w) if x[0] == "<"]))
    return out


def plain(docs, items):
    found = {}
    index = {}
    places = {}
    for item, text in items:
        for at, w, slots in plain_windows(text):
            index.setdefault(w, []).append((item, at, slots))
            places.setdefault(item, set()).add(at)
    for doc, text in docs:
        runs = {}
        for at, w, slots in plain_windows(text):
            for item, q, mine in index.get(w, ()):
                run = runs.setdefault((item, at - q), (set(), set()))
                run[0].add(q)
                run[1].update(zip(mine, slots, strict=True))
        for (item, _), (hits, pairs) in runs.items():
            if len(hits) >= min(len(places[item]), dc.NEEDED) and len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs):
                found.setdefault((doc, item), []).append((len(hits), any(a != b for a, b in pairs)))
    return sorted((d, i, len(x), max(n for n, _ in x), max(n for n, _ in x) / len(places[i]), all(c for _, c in x)) for (d, i), x in found.items())


def rows(df):
    return sorted(tuple(r) for r in df.select("doc_id", "item_id", "occurrences", "windows", "share", "changed").collect())


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, QUESTION, "x"), (2, "short one", "x"), (3, None, "x"), (None, "1 2 3 4 5 6 7 8 9 10", "x")], "item_id long, text string, doc_id string")


def test_reparameterised(spark, items):
    other = QUESTION.replace("Anna", "Zoe").replace("5", "70").replace("12", "99.50")
    odd = QUESTION.replace("gives Anna 5", "gives Anna 6")
    texts = [(1, QUESTION), (2, other), (3, QUESTION.upper()), (4, "Well. " + other + " End. " + QUESTION), (5, odd), (6, None), (7, ""), (8, "1 2 3 4 5 6 7 8 9 10"), (9, QUESTION[:40]), (9, QUESTION), (9, QUESTION), (10, "clean words " * 5000)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, hash int")
    got = rows(dc.contaminated(docs, items))
    assert {1: False, 2: True, 3: False, 4: False, 9: False}.items() <= {r[0]: r[5] for r in got}.items()
    assert got == plain(list(dict.fromkeys(texts)), [(r.item_id, r.text) for r in items.collect() if r.text])
    kept = dc.clean(docs, items)
    assert kept.columns == docs.columns and {8, 6, 7, 10} <= {r.doc_id for r in kept.collect()}
    assert not {1, 2, 3, 4} & {r.doc_id for r in kept.collect()} and kept.where("doc_id = 9").count() == 1
    assert dc.contaminated(docs.limit(0), items).count() == 0 and dc.contaminated(docs, items.limit(0)).count() == 0


def test_without_broadcast(spark, items, monkeypatch):
    docs = spark.createDataFrame([(1, QUESTION), (2, "nothing here")], "doc_id long, text string")
    want = rows(dc.contaminated(docs, items))
    monkeypatch.setattr(dc, "BROADCAST_WINDOWS", 0)
    assert rows(dc.contaminated(docs, items)) == want and len(want) == 1


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_whole_table(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = rows(dc.contaminated(docs, bench))
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    whole = docs.crossJoin(bench.select("item_id", F.col("text").alias("q"))).where("contains(text, q)").select("doc_id", "item_id").collect()
    assert {(r.doc_id, r.item_id) for r in whole} <= {r[:2] for r in got} and whole


def held(spark, question, *texts):
    """Of each text: whether it has a row, and whether it stays."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, question)], "item_id long, text string")
    found, kept = {r.doc_id for r in dc.contaminated(docs, items).collect()}, {r.doc_id for r in dc.clean(docs, items).collect()}
    return [(i in found, i in kept) for i in range(len(texts))]


def test_values_that_meet_or_part(spark):
    q = "On every farm beside the river they keep 3 cows and 5 goats, which eat 5 bales of hay before the long winter ends in the valley."
    merged = q.replace("3 cows", "4 cows").replace("5", "4")
    parted = q.replace("5 bales", "6 bales")
    got = held(spark, q, merged, parted, "On every farm they keep cows.")
    assert got[0] == (True, False) and not got[1][1] and got[2] == (False, True)


def test_one_edited_word(spark):
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru") for b in ("ben", "dor", "fis", "gul", "ham")]
    for n in (8, 10, 15, 18):
        q = words[:n]
        edits = [" ".join(q[:k] + ["zzz"] + q[k + 1 :]) for k in (0, n // 2, n - 1)] + [" ".join(q[:k] + ["zzz"] + q[k:]) for k in (1, n // 2)]
        assert held(spark, " ".join(q), *edits, " ".join(q[: n // 2]), " ".join(reversed(q))) == [(True, False)] * 5 + [(False, True)] * 2, n


def test_questions_below_the_window(spark):
    assert held(spark, "What is 7 times 8?", "He asks: what is 7 times 8? Then goes.", "what is 7 times 9", "what is seven") == [(True, False), (True, False), (False, True)]
    assert held(spark, "7 + 8 = 15", "so 7 + 8 = 15 it is", "so 6 + 8 = 14 it is") == [(True, False), (False, True)]


def test_gate_changes_no_row(spark, monkeypatch):
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru") for b in ("ben", "dor", "fis", "gul", "ham")]
    items = spark.createDataFrame([(i, " ".join(words[i : i + n]), "x") for i, n in enumerate((3, 5, 8, 9, 10, 14, 15))] + [(90, "7 + 8 = 15", "x"), (91, "Is 3 of 4 more", "x")], "item_id long, text string, words string")
    texts = [" ".join(words), " ".join(words[1:5] + ["zzz"] + words[6:]), " ".join(words[::-1]), "so is 5 of 6 more", "7 + 8 = 15", "nothing", None, " ".join(words[2:10]).title()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    gated = {k: rows(dc.contaminated(docs, items.where(k))) for k in ("true", "item_id < 90", "item_id = 91")}
    assert dc._short_gate(dc._question_forms(items.where("item_id < 90"))) is not None and dc._short_gate(dc._question_forms(items.where("item_id = 90"))) is None
    monkeypatch.setattr(dc, "GATED", -1)
    assert gated == {k: rows(dc.contaminated(docs, items.where(k))) for k in gated} and len(gated["true"]) > 8


def test_gate_with_numbers_around_its_words(spark, monkeypatch):
    """Telling words that few windows have do not hide an edited question."""
    q = "ab cd ef 11 12 13 longwordxx 14 15 16 longwordyy 17 18 gh ij kl mn"
    edited = q.replace("longwordxx", "other").replace("longwordyy", "another")
    for limit in (dc.GATED, -1):
        monkeypatch.setattr(dc, "GATED", limit)
        assert held(spark, q, q, edited, "ab cd ef gh") == [(True, False), (True, False), (False, True)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_gate_at_random(spark, monkeypatch, seed):
    """Random short questions with numbers, units and names, edited at random: the same rows with the gate and without."""
    rng = random.Random(seed)
    words = ["ka", "lo", "mi", "ruben", "dor", "fisher", "gul", "3", "14", "15.5", "km", "Anna", "Bob", "the", "of"]
    questions = [" ".join(rng.choice(words) for _ in range(rng.randrange(2, 19))) for _ in range(25)]
    texts = []
    for q in questions:
        for _ in range(6):
            t = q.split()
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = rng.choice([*words, "zzz", "99"])
            texts.append(" ".join([rng.choice(words) for _ in range(rng.randrange(3))] + t + [rng.choice(words) for _ in range(rng.randrange(3))]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    some = [questions[k : k + 5] for k in range(0, 25, 5)]  # a question without telling words takes the gate from its group only
    gated = 0
    for group in some:
        items = spark.createDataFrame([(i % 4, q) for i, q in enumerate(group)], "item_id long, text string")
        gated += dc._short_gate(dc._question_forms(items)) is not None
        with monkeypatch.context() as m:
            got = rows(dc.contaminated(docs, items))
            m.setattr(dc, "GATED", -1)
            assert got == rows(dc.contaminated(docs, items)) and got
    assert gated
