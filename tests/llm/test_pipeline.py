"""The pipeline against plain loops over its own stages' inputs."""

import hashlib
import zlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from test_decontaminate import plain
from test_simhash import plain_components, plain_fingerprint
from tokenizers import Tokenizer

import corpus_pipeline as cp
from ledgerline.llm import langid, quality
from ledgerline.llm.common import BATCH_BYTES, in_batches, keep_texts

SF = "/root/testdata/sf0.01"


def test_stages_against_plain_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    was = texts(docs)
    model = quality.fit_documents(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    (_, stage), *rest = cp.STAGES
    now = cp.staged(stage(spark, docs, SF), "t0")
    assert now.columns == docs.columns and now.dtypes == docs.dtypes
    assert texts(now) == {i: t for i, t in was.items() if model.score([t], quality.Words())[0] >= quality.CUT}
    good = [i for i in was if labels.get(i) == 1]
    assert sum(i in texts(now) for i in good) > 0.98 * len(good)
    for k, (_, stage) in enumerate(rest):
        was, before = texts(now), now
        now = cp.staged(stage(spark, now, SF), f"t{k + 1}")
        if k == 0:
            lang = langid.fit_documents(before)
            assert texts(now) == {i: t for i, t in was.items() if (p := lang.predict([t])[0])[0] != "und" and p[1] >= cp.LEAST_SCORE}
            assert len(texts(now)) > 0.98 * len(was)
        if k == 1:
            ids = list(was)
            roots = plain_components(ids, [plain_fingerprint(was[i]) for i in ids])
            assert texts(now) == {i: was[i] for i, r in zip(ids, roots, strict=True) if i == r}
        if k == 2:
            bad = {d for d, *_ in plain(list(was.items()), items)}
            assert texts(now) == {i: t for i, t in was.items() if i not in bad} and bad
        if k == 3:
            library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            sha = lambda b: hashlib.sha256(b).hexdigest()
            want = {i: (ids := library.encode(t, add_special_tokens=False).ids) and (len(ids), sha(b"".join(x.to_bytes(4, "little") for x in ids)), sha(t.encode())) for i, t in was.items()}
            assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in now.collect()} == want
    assert sorted(map(tuple, cp.run(spark, SF).collect())) == sorted(map(tuple, now.collect()))


def test_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    schema = docs.schema
    good = docs.where("doc_id = 219").first()
    a, b = [i for i in range(219, 300) if zlib.crc32(str(i).encode()) % 4 != 2][:2]  # rows that may teach
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (a, *good[1:]), (a, *good[1:]), (b, *good[1:])], schema)
    now = odd
    for _, stage in cp.STAGES:
        now = stage(spark, now, SF)
    assert [r.doc_id for r in now.collect()] == [a]
    empty = odd.limit(0)
    for _, stage in cp.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_batches_are_bounded_by_bytes(spark):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    rows = spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 5000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "bytes": [b.nbytes]})

    spark.conf.unset(limit)
    kept = keep_texts(rows, lambda texts: [True] * len(texts))
    assert kept.count() == 2000 and int(spark.conf.get(limit)) == BATCH_BYTES
    got = in_batches(rows, sizes, "n long, bytes long").collect()
    assert sum(r["n"] for r in got) == 2000 and max(r["bytes"] for r in got) < 1.1 * BATCH_BYTES
    spark.conf.set(limit, "1000")
    assert in_batches(rows.limit(3), sizes, "n long, bytes long").count() == 3
    spark.conf.unset(limit)
