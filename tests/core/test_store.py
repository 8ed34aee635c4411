"""The versioned store, learning into it, cascades and incremental rebuilds."""

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import learning
from ledgerline.operators.store import Conflict, Store

BATCH = "txn_id long, cid string, channel string, raw string, period string, mode string, name string"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), {"a": ["k"], "b": ["k", "j"]})


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_versions(spark, store):
    a = lambda *r: spark.createDataFrame(list(r), "k int, v string")
    b = lambda *r: spark.createDataFrame(list(r), "k int, j int, v string")
    empty = store.snapshot()
    one = store.commit(empty, {"a": a((1, "x"), (2, "y")), "b": b((1, 1, "p"))}, marks={"s": 3})
    opened = one.table("a")
    two = store.commit(one, {"a": a((2, "z"), (3, None))}, {"b": b((1, 1, ""))})
    assert rows(two.table("a")) == [(1, "x"), (2, "z"), (3, None)] and rows(two.table("b")) == [] and two.mark("s") == 3
    assert rows(opened) == rows(store.snapshot(1).table("a")) == [(1, "x"), (2, "y")] and "a" not in empty
    with pytest.raises(Conflict):
        store.commit(one, {"a": a((9, "late"))})
    assert rows(store.snapshot().table("a")) == rows(two.table("a"))

    fails = F.udf(lambda v: 1 / 0, "string")
    with pytest.raises(Exception):  # noqa: B017
        store.commit(two, {"a": a((5, "new")), "b": b((5, 5, "new")).withColumn("v", fails("v"))})
    assert store.versions() == [1, 2] and rows(store.snapshot().table("a")) == rows(two.table("a"))
    for i in range(12):  # folded on the way
        store.commit(store.snapshot(), {"a": a((i % 3, str(i)))})
    last = store.snapshot()
    assert rows(last.table("a")) == [(0, "9"), (1, "10"), (2, "11"), (3, None)] and len(last.manifest.tables["a"]) < 8
    store.vacuum(2)
    assert len(store.versions()) == 2 and rows(store.snapshot().table("a")) == rows(last.table("a"))


def test_generations(spark, store):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    old = Store(spark, store.path, store.keys)
    old.take_over()
    store.take_over()
    with pytest.raises(Conflict):
        old.commit(old.snapshot(), {"a": a})
    assert "a" in store.commit(store.snapshot(), {"a": a})


def confirmed(spark, *lines):
    return spark.createDataFrame([(i, c, ch, raw, p, "unknown", n) for i, c, ch, raw, p, n in lines], BATCH)


FIRST = [
    (1, "001545", "BIDV", "TT tien nuoc KH:001545 ky 06/2026", "2026-06", "Nguyen Van An"), (2, "002222", "VCB", "TT tien nuoc KH:002222 ky 06/2026", "2026-06", ""),
    (3, "003333", "VCB", "Nguyen Van An tra tien nuoc HD:AB-7788 thang 6/2026", "2026-06", "Nguyen Van An"), (4, "002222", "VCB", "TT tien nuoc KH:002222 ky 07/2026", "2026-07", ""),
]


def test_learning_all_tables(spark, tmp_path):
    store = Store(spark, str(tmp_path / "k"), learning.KEYS)
    before = store.snapshot()
    one = learning.learn(store, confirmed(spark, *FIRST[:3]), {"import": 0})
    assert set(one.manifest.tables) == set(learning.KEYS) - {"negatives", "slot_rules"} and not before.manifest.tables
    two = learning.learn(store, confirmed(spark, *FIRST), {"import": 1})
    assert two.table("receipts").count() == 4
    seen = {r.customer_id: (r.seen, r.last_period, r.confidence) for r in two.table("customers").collect()}
    assert seen == {"001545": (1, "2026-06", 0.2), "002222": (2, "2026-07", 0.44), "003333": (1, "2026-06", 0.2)}
    assert {r.customer_id: r.seen for r in one.table("customers").collect()} == {"001545": 1, "002222": 1, "003333": 1}
    rules = learning.slot_rules(two)
    done = store.commit(two, {"slot_rules": rules, "negatives": spark.createDataFrame([("t", "002222")], "text_key string, customer_id string")})
    text_key = learning.classify.parsed(confirmed(spark, FIRST[1])).first().text_key
    done = store.commit(done, {"negatives": spark.createDataFrame([(text_key, "002222")], "text_key string, customer_id string")})
    late = learning.learn(store, confirmed(spark, (9, *FIRST[1][1:])))
    assert [tuple(r) for r in late.table("negatives").collect()] == [("t", "002222")]  # the confirmed text's negative is lifted
    assert late.table("slot_rules").count() < done.table("slot_rules").count()

    gone = learning.forget(store, spark.createDataFrame([("002222",), ("003333",)], "customer_id string"))
    for name in ("customers", "patterns", "payers", "receipts", "memory", "members"):
        assert {r.customer_id for r in gone.table(name).select("customer_id").collect()} == {"001545"}, name
    patterns = {r.pattern_key for r in gone.table("patterns").collect()}
    assert {r.pattern_key for t in ("slots", "features", "postings") for r in gone.table(t).select("pattern_key").collect()} == patterns
    assert {r.template_key for r in gone.table("templates").collect()} == {r.template_key for r in gone.table("patterns").collect()}


def test_reindex_changes_stale_patterns_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "k"), learning.KEYS)
    base = learning.learn(store, confirmed(spark, *FIRST))
    edited = base.table("patterns").select("pattern_key", "customer_id", "channel", "raw")
    same, n = learning.reindex(store, edited)
    assert n == 0 and same.table("postings").count() == base.table("postings").count()
    new = edited.withColumn("raw", F.when(F.col("customer_id") == "001545", F.lit("TT tien nuoc HD:XY-1 ky 06/2026")).otherwise(F.col("raw"))).where("customer_id <> '003333'")
    done, n = learning.reindex(store, new)
    want = learning.postings_of(new.withColumn("name", F.lit("")))
    key = lambda df: {(r.pattern_key, r.token, r.weight) for r in df.collect()}
    changed = {r.pattern_key for r in new.where("customer_id = '001545'").collect()}
    assert {k for k in key(done.table("postings")) if k[0] in changed} == {k for k in key(want) if k[0] in changed}
    assert n == len([k for k in key(want) if k[0] in changed]) and done.table("patterns").count() == 2
    assert {k[0] for k in key(done.table("postings"))} == {r.pattern_key for r in new.collect()}


def test_cascade_to_a_fixed_point(spark):
    t = {
        "a": spark.createDataFrame([(1,), (2,)], "a int"), "b": spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "b int, a int"), "c": spark.createDataFrame([(1, 1, 7), (1, 1, 7), (2, 2, 8), (3, 3, 8), (4, 3, 9), (5, 2, None)], "c int, b int, s int"),
        "d": spark.createDataFrame([(1, 1), (2, 4)], "d int, c int"), "s": spark.createDataFrame([(7,), (8,), (9,), (10,)], "s int"),
    }
    refs = [("b", ["a"], "a", ["a"]), ("c", ["b"], "b", ["b"]), ("d", ["c"], "c", ["c"])]
    got = learning.cascade(t, {"a": t["a"].where("a = 1")}, refs, [("s", ["s"], "c", ["s"])])
    assert {k: rows(v) for k, v in got.items()} == {"a": [(1,)], "b": [(1, 1), (2, 1)], "c": [(1, 1, 7), (1, 1, 7), (2, 2, 8), (5, 2, None)], "d": [(1, 1)], "s": [(7,)]}
