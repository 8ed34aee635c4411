"""Stateful learning, imports that are killed, and progress counters."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import knowledge, learning
from ledgerline.operators.store import Store
from ledgerline.streaming import keyed, progress, recovery

SCHEMA = "k string, period string"


def files(spark, path, batches, schema=SCHEMA):
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(path)


def plain(batches):
    state = {}
    for batch in batches:
        for k, p in sorted(batch, key=lambda r: r[1]):
            seen, advances, last, months = state.get(k, (0, None, "unknown", set()))
            newer = p != "unknown" and (last == "unknown" or p > last)
            advances = 0 if advances is None else advances + newer
            state[k] = (seen + 1, advances, p if newer else last, months | {p})
    return {k: (s, a, last, len(m), round(1 - 0.8 * 0.7**a, 9)) for k, (s, a, last, m) in state.items()}


def shuffled(seed):
    rng = random.Random(seed)
    months = ["unknown", *(f"2026-{m:02d}" for m in range(1, 13))]
    return [[(f"k{rng.randrange(6)}", rng.choice(months)) for _ in range(rng.randrange(1, 40))] for _ in range(4)]


def got(df):
    return {r.k: (r.seen, r.advances, r.last_period, r.months, r.confidence) for r in df.collect()}


def test_keyed_state_survives_a_kill(spark, tmp_path):
    batches = shuffled(1)
    files(spark, str(tmp_path / "in"), batches)
    calls = []

    def dies(number):
        calls.append(number)
        if calls.count(2) == 1 and number == 2:
            raise RuntimeError("killed")

    args = (spark, str(tmp_path / "in"), SCHEMA, ["k"], str(tmp_path / "state"))
    with pytest.raises(Exception, match="killed"):
        keyed.learn_stream(*args, before_commit=dies)
    assert got(keyed.learn_stream(*args, before_commit=dies)) == plain(batches) and calls == [0, 1, 2, 2, 3]
    state = None
    for b in batches:
        state = knowledge.learn(state, spark.createDataFrame(b, SCHEMA), ["k"])
    assert {r.k: (r.seen, r.advances, r.last_period) for r in state.collect()} == {k: v[:3] for k, v in plain(batches).items()}


def test_dormant_keys(spark, tmp_path):
    files(spark, str(tmp_path / "in"), [[("a", "2026-01"), ("b", "2026-01")], [("b", "2026-02")], [("b", "2026-03")]])
    end = {r.k: (r.seen, r.months, r.dormant) for r in keyed.learn_stream(spark, str(tmp_path / "in"), SCHEMA, ["k"], str(tmp_path / "state"), dormant_ms=1).collect()}
    assert end["a"] == (1, 0, True) and end["b"][0] == 3


class Calls:
    """A value state that counts the calls out of the worker."""

    def __init__(self):
        self.held, self.calls = None, 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.held

    def update(self, value):
        self.calls += 1
        self.held = value


def test_a_key_costs_two_calls_whatever_its_months():
    state, learner, batches = Calls(), keyed.Learner(["k"]), shuffled(2)
    learner.init(state)
    for b in batches:
        (end,) = learner.handleInputRows(("a",), iter([{"k": "a", "period": p} for _, p in b]), None)
    want = plain([[("a", p) for _, p in b] for b in batches])["a"]
    assert (end.seen, end.advances, end.last_period, end.months) == want[:4] and state.calls == 2 * len(batches)


def test_a_batch_of_several_files(spark, tmp_path):
    batches = shuffled(3)
    for b in batches:
        spark.createDataFrame(b, SCHEMA).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        end = keyed.learn_stream(spark, str(tmp_path / "in"), SCHEMA, ["k"], str(tmp_path / "state"), files_per_batch=None)
    assert got(end) == plain(batches)


BATCH = "txn_id long, cid string, channel string, raw string, period string, mode string"


class Dies(Exception):
    pass


@pytest.mark.parametrize("at", ["before the intent", "after the intent", "after the tables", "after the commit"])
def test_killed_imports_apply_each_batch_once(spark, tmp_path, monkeypatch, at):
    lines = [(i, f"{i % 4:06d}", "VCB", f"TT tien nuoc KH:{i % 4:06d} ky 0{1 + i // 4}/2026", f"2026-0{1 + i // 4}", "unknown") for i in range(12)]
    files(spark, str(tmp_path / "in"), [lines[:4], lines[2:8], lines[8:]], BATCH)
    open_ = lambda: recovery.Importer(Store(spark, str(tmp_path / "store"), {"customers": ["cid"], "receipts": ["txn_id"]}), "bank", simple)
    args = (str(tmp_path / "in"), BATCH, str(tmp_path / "checkpoint"))

    def simple(base, batch):
        fresh = knowledge.unseen(batch, base.table("receipts") if "receipts" in base else None, "txn_id")
        old = base.table("customers") if "customers" in base else None
        return {"customers": knowledge.learn(old, fresh.select("cid", "period"), ["cid"]), "receipts": fresh.select("txn_id")}, {}

    first, died = open_(), []

    def once(f, when, where):
        def g(*args, **kw):
            if not died and when(*args):
                if where == "after":
                    f(*args, **kw)
                died.append(True)
                raise Dies("killed")
            return f(*args, **kw)

        return g

    second = lambda *a: a[-1] == 1
    if at == "before the intent":
        first.take = once(first.take, second, "before")
    elif at == "after the intent":
        first._apply = once(first._apply, second, "before")
    elif at == "after the tables":
        first.store.publish = once(first.store.publish, lambda m: m.marks.get("bank") == 1, "before")
    else:
        first.take = once(first.take, second, "after")
    with pytest.raises(Exception, match="killed"):
        recovery.run(first, *args)
    again = open_()
    assert again.pending() == ([1] if at in ("after the intent", "after the tables") else [])
    end = recovery.run(again, *args)
    assert sorted(r.txn_id for r in end.table("receipts").collect()) == list(range(12)) and end.mark("bank") == 2
    assert {r.cid: (r.seen, r.last_period) for r in end.table("customers").collect()} == {f"{i:06d}": (3, "2026-03") for i in range(4)}
    assert not again.pending() and not again._numbers()
    with pytest.raises(Exception, match="superseded"):
        first.store.commit(first.store.snapshot(), {"receipts": end.table("receipts")})
    assert sorted(r.txn_id for r in recovery.run(open_(), *args).table("receipts").collect()) == list(range(12))


def test_import_into_all_tables(spark, tmp_path):
    lines = [(i, f"{i % 3:06d}", "VCB", f"TT tien nuoc KH:{i % 3:06d} ky 0{1 + i // 3}/2026", f"2026-0{1 + i // 3}", "unknown") for i in range(6)]
    files(spark, str(tmp_path / "in"), [lines[:4], lines[3:]], BATCH)
    end = recovery.run(recovery.Importer(Store(spark, str(tmp_path / "store"), learning.KEYS), "bank", learning.learned), str(tmp_path / "in"), BATCH, str(tmp_path / "checkpoint"))
    assert end.table("receipts").count() == 6 and {r.seen for r in end.table("customers").collect()} == {2}


def test_progress_counts(spark, tmp_path):
    rng = random.Random(3)
    made = [(rng.choice(["BIDV", "a.b c", "VCB"]), rng.choice(progress.STATUSES)) for _ in range(200)]
    df = spark.createDataFrame(made, "sheet string, status string").repartition(5)
    want = dict(Counter(made))
    batch = progress.BatchProgress("sheet", ["BIDV", "a.b c", "VCB"])
    batch.observe(df).write.format("noop").mode("overwrite").save()
    assert batch.counts() == want and batch.processed() == 200
    files(spark, str(tmp_path / "in"), [made[:50], made[50:90], made[90:]], "sheet string, status string")
    listener = progress.StreamProgress("import", "sheet", ["BIDV", "a.b c", "VCB"])
    spark.streams.addListener(listener)
    try:
        stream = listener.observe(spark.readStream.schema("sheet string, status string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
        stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        for _ in range(100):
            if listener.ended:
                break
            import time

            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert listener.counts() == want and listener.processed() == 200 and F is not None
