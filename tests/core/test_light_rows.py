"""Rows carry no vectors, texts that repeat are embedded once, and of knowledge only what is asked for is made."""

from pyspark.sql import functions as F

from ledgerline.functions import embedding as em
from ledgerline.functions import narrative as nr
from ledgerline.functions import values as vl
from ledgerline.operators import classify as cl
from ledgerline.operators import learning
from ledgerline.operators.store import Store

ROW = "txn_id long, cid string, channel string, raw string, period string, mode string"
ROWS = [(i, f"{i % 3:06d}", "VCB", f"TT tien nuoc KH {i % 3:06d} ky 0{1 + i % 6}/2020", "2020-01", "unknown") for i in range(12)]


def test_likeness_is_the_cosine(spark):
    texts = ["tt tien nuoc customer id", "TT tien nuoc KH customer id", "khac han", "", None]
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts] * 2, "a string, b string").coalesce(1)
    got = pairs.select("a", "b", em.likeness(F.col("a"), F.col("b")).alias("x"), em.embedding(F.col("a")).alias("v"), em.embedding(F.col("b")).alias("w"))
    rows = got.select("a", "x", "v", vl.cosine(F.col("v"), F.col("w")).alias("y")).collect()
    assert len(rows) == 50 and all(r.x == r.y and r.v == em.embed(r.a) for r in rows)


def test_buckets_of_sparse_vectors(spark):
    v = [0.0] * 20 + [0.5, -0.5, 0.25, None, -0.125]
    got = spark.createDataFrame([(v,), ([0.0] * 3,), ([],)], "v array<float>").select(vl.vector_buckets(F.col("v"), 4).alias("b")).collect()
    assert [r.b for r in got] == [["v:20:1", "v:21:0", "v:22:1"], [], []]
    texts = spark.createDataFrame([("TT tien nuoc KH customer id",), ("x",), ("a b c d e f g h",), ("",), (None,)], "t string")
    both = texts.select(em.buckets(F.col("t")).alias("b"), em.embedding(F.col("t")).alias("v")).select("b", vl.vector_buckets(F.col("v")).alias("w")).collect()
    assert all(r.b == r.w for r in both) and [len(r.b) > 0 for r in both] == [True, True, True, False, False]


def test_parsed_rows_are_light(spark):
    rows = spark.createDataFrame([*ROWS, (99, "000001", "VCB", None, "2020-01", "unknown")], ROW)
    found = cl.parsed(rows, "txn_id")
    assert "vector" not in found.columns and "vector_key" in found.columns
    for r in found.collect():
        assert r.signature == nr.identity_signature(r.raw) and (r.vector_key is None) == (r.raw is None)
    assert set(found.schema["norm"].dataType.fieldNames()) == set(nr._arrow_type().field(i).name for i in range(nr._arrow_type().num_fields))


def test_only_what_is_asked_for_is_made(spark, monkeypatch):
    made, write = [], cl.staged
    monkeypatch.setattr(cl, "staged", lambda df, name: (made.append(name), write(df, name))[1])
    known = cl.build(spark.createDataFrame(ROWS, ROW))
    asked = cl.parsed(spark.createDataFrame([(1, "VCB", "chuyen tien KH 000002")], "query_id int, channel string, raw string"), "query_id")
    assert {r.customer_id for r in cl.recommend(asked, known).collect()} == {"000002"}
    assert set(made) == {"examples", "patterns", "held", "asked-texts", "whole-names"}


def test_recommendations_parse_a_text_once(spark):
    known = cl.build(spark.createDataFrame(ROWS, ROW))
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(raw):
        read.add(1)
        return raw

    asks = spark.createDataFrame([(i, "VCB", f"chuyen tien KH 00000{i}") for i in range(3)], "query_id int, channel string, raw string")
    asked = cl.parsed(asks.withColumn("raw", counted.asNondeterministic()("raw")), "query_id")
    assert sorted((r.query_id, r.customer_id) for r in cl.recommend(asked, known).collect()) == [(i, f"00000{i}") for i in range(3)]
    assert read.value == 3


def test_learned_rows_have_keys_and_no_vectors(spark, tmp_path, monkeypatch):
    written, write = {}, learning.staged
    monkeypatch.setattr(learning, "staged", lambda df, name: written.setdefault(name, write(df, name)))
    store = Store(spark, str(tmp_path / "k"), learning.KEYS)
    upserts, _ = learning.learned(store.snapshot(), spark.createDataFrame(ROWS, ROW))
    assert "pattern_key" in written["learned"].columns and "vector" not in written["learned"].columns
    found = upserts["postings"].collect()
    pairs = {(r.pattern_key, r.token) for r in found}
    assert len(pairs) == len(found) and {t for _, t in pairs if t.startswith("id:")} == {"id:000000", "id:000001", "id:000002"}
    assert {k for k, _ in pairs} == {r.pattern_key for r in written["learned"].collect()}
    assert {k for k, t in pairs if t.startswith("v:")} == {k for k, _ in pairs}
