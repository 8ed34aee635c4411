"""State, fusion, spans and sources on small cases."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import text as tx
from ledgerline.functions import values as vl
from ledgerline.operators import decide, fusion, knowledge, relations, similarity
from ledgerline.sources import ingest, xlsx


def test_confidence_rises_only_with_newer_months(spark):
    batch = lambda *p: spark.createDataFrame([("a", x) for x in p], "k string, period string")
    state = knowledge.learn(None, batch("2026-05", "2026-05"), ["k"])
    assert [(r.seen, r.confidence) for r in state.collect()] == [(2, 0.2)]
    state = knowledge.learn(state, batch("2026-06"), ["k"])
    assert [(r.seen, r.confidence, r.last_period) for r in state.collect()] == [(3, 0.44, "2026-06")]
    state = knowledge.learn(state, batch("2026-04", "unknown"), ["k"])
    assert [(r.seen, r.confidence, r.last_period) for r in state.collect()] == [(5, 0.44, "2026-06")]
    first = knowledge.learn(knowledge.learn(None, batch("unknown"), ["k"]), batch("2026-01"), ["k"])
    assert [(r.confidence, r.last_period) for r in first.collect()] == [(0.44, "2026-01")]


def test_decay(spark):
    row = spark.range(1).select(F.round(vl.decayed(F.array(F.lit(False))), 4).alias("a"), F.round(vl.decayed(F.array(F.lit(True))), 4).alias("b")).first()
    assert (row.a, row.b) == (0.14, 0.44)


def test_money_and_dates(spark):
    cases = {"1.234.567": 1234567.0, "1,234.50": 1234.5, "1.234,5": 1234.5, "(500)": -500.0, "12 000 VND": 12000.0, "": 0.0, "1.23,45": None, "abc": None, "7,5": 7.5, "'42": 42.0, "-1.000": -1000.0}
    got = {r.c: r.v for r in spark.createDataFrame([(c,) for c in cases], "c string").select("c", vl.parse_money(F.col("c")).alias("v")).collect()}
    assert got == cases
    dates = {"01/02/2026 10:20:30": "2026-02-01T10:20:30", "1-2": "1-2", "05.06.2026": "2026-06-05T00:00:00", "31/02/2026": "31/02/2026", "07/08/26": "2026-08-07T00:00:00"}
    got = {r.c: r.v for r in spark.createDataFrame([(c,) for c in dates], "c string").select("c", vl.date_text(F.col("c")).alias("v")).collect()}
    assert got == dates


def test_label_cells(spark):
    cases = {"1234,005678": ["001234", "005678"], "001234005678": None, "12.0": ["000012"], "": None, "5 5": ["000005"]}
    got = {r.c: r.v for r in spark.createDataFrame([(c,) for c in cases], "c string").select("c", tx.confirmed_ids(F.col("c")).alias("v")).collect()}
    assert got == cases


def test_metrics_are_null_without_denominators(spark):
    m = vl.ratio_metrics(F.lit(0), F.lit(0), F.lit(1))
    row = spark.range(1).select(*(c.alias(k) for k, c in m.items())).first()
    assert (row.precision, row.recall, row.f1) == (None, 0.0, None)


def plain_fusion(channels, customers, limit):
    score = {}
    for c, ids in channels.items():
        for rank, p in enumerate(dict.fromkeys(ids), 1):
            score[p] = score.get(p, 0) + fusion.CHANNEL_WEIGHTS[c] / (60 + rank)
    held = []
    for c in fusion.RESERVED:
        seen = []
        for p in channels.get(c, []):
            if customers[p] not in seen and len(seen) < max(1, limit // 5):
                seen.append(customers[p])
                held += [p] if p not in held else []
    held = held[:limit]
    taken, first, later = {}, [], []
    for p in held:
        taken[customers[p]] = taken.get(customers[p], 0) + 1
    for p in sorted(score, key=lambda p: (-round(score[p], 9), p)):
        if p not in held:
            if taken.get(customers[p], 0) < fusion.PER_CUSTOMER:
                taken[customers[p]] = taken.get(customers[p], 0) + 1
                first.append(p)
            else:
                later.append(p)
    return (held + first + later)[:limit]


@pytest.mark.parametrize("seed", range(4))
def test_fusion_against_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    customers = {p: f"c{rng.randrange(6)}" for p in range(30)}
    channels = {c: rng.sample(range(30), rng.randrange(1, 15)) for c in rng.sample(list(fusion.CHANNEL_WEIGHTS), 6)}
    rows = [(1, c, p, customers[p], i) for c, ids in channels.items() for i, p in enumerate(ids)]
    hits = spark.createDataFrame(rows, "query_id int, channel string, pattern_id long, customer_id string, position int")
    got = [r.pattern_id for r in fusion.select_diverse(hits, 12).orderBy("place").collect()]
    assert got == plain_fusion(channels, customers, 12)


@pytest.mark.parametrize("seed", range(4))
def test_fusion_of_lists_is_that_of_rows(spark, seed):
    rng = random.Random(seed)
    customers = {p: f"c{rng.randrange(6)}" for p in range(30)}
    names = rng.sample(list(fusion.CHANNEL_WEIGHTS), 5)
    rows = [(q, c, p, customers[p], i) for q in range(5) for c in names[q % 2 :] for i, p in enumerate(rng.sample(range(30), rng.randrange(1, 15)), 1)]
    hits = spark.createDataFrame(rows, "query_id int, channel string, pattern_id long, customer_id string, rank int")
    lists = hits.select("query_id").distinct()
    for c in names:
        lists = lists.join(fusion.ranked_lists(hits.where(F.col("channel") == c), ["query_id"], c), "query_id", "left")
    hits = hits.withColumnRenamed("rank", "position")
    got = lambda df: sorted(map(tuple, df.collect()))
    assert got(fusion.fuse_lists(lists, "query_id", names)) == got(fusion.fuse(hits))
    for limit in (3, 12):
        assert got(fusion.diverse_lists(lists, "query_id", names, limit)) == got(fusion.select_diverse(hits, limit))

    # a task never meets the hits of several queries: no shuffle, sort or window is left in the fusion of lists
    lists.write.mode("overwrite").parquet(path := tempfile.mkdtemp())
    plan = fusion.diverse_lists(spark.read.parquet(path), "query_id", names, 12)._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Exchange", "Window", "Sort "))


def test_spans(spark):
    rng = random.Random(5)
    spans = [(i, a := rng.randrange(200), a + rng.randrange(0, 40)) for i in range(80)]
    left = spark.createDataFrame(spans[:40], "i int, a long, b long")
    right = spark.createDataFrame([(i, c, d) for i, c, d in spans[40:]], "j int, c long, d long")
    got = sorted((r.i, r.j) for r in relations.overlap_join(left, right, ("a", "b"), ("c", "d"), 16).collect())
    assert got == sorted((i, j) for i, a, b in spans[:40] for j, c, d in spans[40:] if a < b and c < d and a < d and b > c)


def test_nearest_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    want = [tuple(r) for r in similarity.nearest(df, df, "id", "v", 3).orderBy("query_id", "rank").collect()]
    monkeypatch.setattr(similarity, "QUERY_BLOCK", 7)
    assert [tuple(r) for r in similarity.nearest(df, df, "id", "v", 3).orderBy("query_id", "rank").collect()] == want
    assert len(want) == 180


def test_cascade(spark):
    known = spark.createDataFrame([(1, "KH 000001 a", "X", 5000.0, "000001"), (2, "HD 77", "X", 5000.0, "000002"), (3, "HD 88", "X", 5000.0, "000001"), (4, "HD 88", "Y", 5000.0, "000003")], "txn_id int, raw string, channel string, amount double, cid string")
    asks = [(1, "KH 000001 a", "X", 5000.0), (2, "KH 000001 b", "X", 5000.0), (3, "KH 000009 b", "X", 5000.0), (4, "HD 77", "Y", 5000.0), (5, "HD 88", "Z", 5000.0), (6, "KH 000001 a", "X", 0.0), (7, "hello", "X", 5000.0)]
    got = {r.txn_id: (r.rule, r.decision, r.customer_id) for r in decide.cascade(spark.createDataFrame(asks, "txn_id int, raw string, channel string, amount double"), known).collect()}
    assert got == {
        1: ("memory", "auto_accept", "000001"), 2: ("id", "auto_accept", "000001"), 3: ("id_unknown", "manual_check", None), 4: ("contract", "auto_accept", "000002"),
        5: ("contract_shared", "manual_check", None), 6: ("not_credit", "reject", None), 7: ("nothing", "manual_check", None),
    }
    row = spark.range(1).select(decide.cap_competing(F.lit(0.95), F.lit(0.9)).alias("a"), decide.cap_competing(F.lit(0.95), F.lit(0.5)).alias("b")).first()
    assert (row.a, row.b) == (0.89, 0.95)


def test_layouts():
    roles, doubtful = ingest.header_roles({"A": "Ngày", "C": "IDKH", "D": "Tên khách hàng", "G": "LỆNH GỐC NGÂN HÀNG", "H": "Kênh"})
    assert roles == {"date": "A", "customer_id": "C", "customer_name": "D", "raw": "G", "payer": "H"} and not doubtful
    assert ingest.layout(roles) == "confirmed" and ingest.layout({"raw": "I", "debit": "D"}) == "raw" and ingest.layout({"raw": "I"}) is None
    assert ingest.header_roles({"A": "IDKH", "B": "IDKH"})[1] == ["customer_id"]


def test_workbook(tmp_path):
    path = str(tmp_path / "b.xlsx")
    xlsx.write_workbook(path, {"one & two": [["00123", "", "é <x>"]], "empty": []})
    (name, part), (other, _) = xlsx.sheets(path)
    assert (name, other) == ("one & two", "empty")
    assert list(xlsx.rows(path, part)) == [(1, {"A": "00123", "C": "é <x>"})]


def test_hard_negatives(spark):
    rows = [
        (1, 1, "t", "A", "B", ["B"], None),  # A is wrong
        (1, 2, "t", "A", "B", ["B"], None),  # the same entry and choice again
        (2, 3, "t", "A", None, [], []),  # rejected
        (3, 4, "u", "A", "B", ["A", "B"], None),  # both are named
        (4, 5, "u", "A", "B", [], ["A", "B", "C"]),  # both were paid before
        (5, 6, "v", "A", "B", ["A"], ["A"]),  # one name only
        (6, 7, "v", "C", "A", None, None),  # lifts v, A and turns C down
        (7, 8, "w", "A", "A", [], []),  # confirmed as proposed
        (8, 9, "w", None, "A", [], []),
        (9, 10, "w", "A", None, [], []),  # rejected after it was accepted
        (10, 11, None, "A", None, None, None),
    ]
    schema = "entry_key int, at int, text_key string, proposed string, chosen string, mentioned array<string>, allocation array<string>"
    reviews = spark.createDataFrame(rows, schema)
    got = {(r.text_key, r.customer_id, r["count"]) for r in knowledge.hard_negatives(reviews).collect()}
    assert got == {("t", "A", 2), ("v", "C", 1), ("w", "A", 1), (None, "A", 1)}
    assert knowledge.hard_negatives(reviews.limit(0)).count() == 0


def test_undo(spark):
    log = [(1, "a", None, "x", True, False), (2, "a", "x", "y", True, False), (3, "b", "o", "p", False, False), (4, "c", "o", "p", True, True), (5, "d", "o", "p", True, False), (6, "e", None, "n", True, False), (7, "f", "gone", None, True, False)]
    changes = spark.createDataFrame(log, "change_id int, entity string, before string, after string, reversible boolean, reverted boolean")
    current = spark.createDataFrame([("a", "y"), ("b", "p"), ("c", "p"), ("d", "edited"), ("e", "n"), ("g", "kept")], "entity string, value string")
    undone = knowledge.undo(changes, current, changes)
    assert {r.change_id: r.outcome for r in undone.collect()} == {1: "newer", 2: "undone", 3: "fixed", 4: "fixed", 5: "changed", 6: "undone", 7: "undone"}
    assert dict(map(tuple, knowledge.after_undo(current, undone).collect())) == {"a": "x", "b": "p", "c": "p", "d": "edited", "f": "gone", "g": "kept"}
    assert knowledge.undo(changes, current, changes.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_segmented_runs(spark, seed):
    rng = random.Random(seed)
    rows, n = [], 0
    for key, size in (("hot", 300), ("b", 1), (None, 40), ("c", 60)):
        for _ in range(size):
            rows.append((key, n, rng.choice(["x", "x", "x", "y", None])))
            n += 1
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "k string, at int, u string")
    want, last = {}, {}
    for k, at, u in rows:
        run, before = last.get(k, (0, object()))
        run += u != before
        last[k] = (run, u)
        want[at] = run
    assert {r["at"]: r.run for r in relations.segmented_runs(df, "k", ["at"], "u").collect()} == want


def test_recall_of_cells(spark):
    """At least nine of ten neighbours of the exact search are found, over all rows of two tables."""
    for sf in ("sf0.001", "sf0.01"):
        e = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
        asked = e.where("vec_id % 10 = 0")
        exact = {(r.query_id, r.vec_id) for r in similarity.nearest(e, asked, "vec_id", "embedding", 5).collect()}
        found = {(r.query_id, r.vec_id) for r in similarity.nearest_in_cells(e, asked, "vec_id", "embedding", 5).collect()}
        print("recall", sf, len(exact & found) / len(exact))
        assert len(exact & found) >= 0.9 * len(exact)


@pytest.mark.parametrize(("seed", "k"), [(1, 3), (2, 1), (3, 50)])
def test_top_scored(spark, seed, k):
    """The same rows as all pairs, though common words are never walked."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    held = {(r, w): rng.randrange(1, 4) for r in range(120) for i, w in enumerate(words) if rng.random() < (0.9 if i < 4 else 0.05)}
    asked = {(q, w) for q in range(8) for w in rng.sample(words, 9)} | {(9, "w0"), (9, "nowhere")}
    total = {}
    for q, w in asked:
        for (r, v), s in held.items():
            if v == w:
                total[q, r] = total.get((q, r), 0) + s
    want = set()
    for q in range(10):
        best = sorted(((-s, r) for (p, r), s in total.items() if p == q))[:k]
        want |= {(q, r, -s, i) for i, (s, r) in enumerate(best, 1)}
    postings = spark.createDataFrame([(r, w, s) for (r, w), s in held.items()], "r long, word string, score long")
    got = similarity.top_scored(spark.createDataFrame(sorted(asked), "q int, word string"), postings, "q", "r", k)
    assert {tuple(r) for r in got.select("q", "r", "score", "rank").collect()} == want


def test_equal_sets_are_matched_once(spark, monkeypatch):
    """Many rows with few sets: pairs are made of the distinct sets, and every row gets them."""
    rng = random.Random(5)
    kinds = [rng.sample("abcdefgh", rng.randrange(1, 6)) for _ in range(8)]
    rows = [(i, rng.sample(k, len(k))) for i in range(80) for k in [rng.choice(kinds)]]
    met, inner = [], similarity._distinct_similarity
    monkeypatch.setattr(similarity, "_distinct_similarity", lambda left, right, *a: met.append((left.count(), right.count())) or inner(left, right, *a))
    left = spark.createDataFrame(rows, "k long, g array<string>")
    got = {(r.k, r.o): r.similarity for r in similarity.set_similarity(left, left.withColumnRenamed("k", "o"), "k", "o", "g", 0.5).collect()}
    jaccard = lambda a, b: len({*a} & {*b}) / len({*a} | {*b})
    assert got == {(k, o): jaccard(a, b) for k, a in rows for o, b in rows if jaccard(a, b) >= 0.5}
    assert max(met[0]) <= len(kinds)
