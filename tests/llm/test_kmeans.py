"""Clusters against plain rounds over all distances."""

import hashlib
import random

import duckdb
import numpy as np
import pytest

from ledgerline.llm import kmeans

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, clusters=16, rounds=3):
    kept = [(i, [int(np.floor(v * 64)) for v in e]) for i, e in rows if e is not None and len(e) == 64 and all(v is not None and np.isfinite(v) for v in e)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)[:clusters]
    centroids = [q for _, q in first]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        at = [min((far(q, c), k) for k, c in enumerate(centroids)) for _, q in kept]
        if turn < rounds:
            for k in range(len(centroids)):
                mine = [q for (_, q), (_, c) in zip(kept, at, strict=True) if c == k]
                if mine:
                    centroids[k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    total = sum(d for d, _ in at)
    of = lambda k: sum(d for d, c in at if c == k)
    return sorted((str(i), k, d, of(k), total, hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for (i, _), (d, k) in zip(kept, at, strict=True))


def got(df):
    return sorted((str(r[0]), *tuple(r)[1:6]) for r in kmeans.clustered(df).collect())


def blobs(seed, n, ties=False):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, 64)) * 0.3
    x = centres[rng.integers(9, size=n)] + rng.normal(size=(n, 64)) * (0.02 if ties else 0.15)
    return [(int(i), (np.round(v * 8) / 64 if ties else v).tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("seed, n, ties", [(1, 300, False), (2, 200, True), (3, 10, False), (4, 1, False)])
def test_against_plain_rounds(spark, seed, n, ties):
    rows = blobs(seed, n, ties)
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_odd_rows(spark):
    rng = random.Random(5)
    rows = blobs(5, 60) + blobs(5, 20) + [(None, blobs(6, 1)[0][1]), (7, None), (8, []), (9, [0.5] * 63), (10, [0.5] * 65), (11, [None] + [0.5] * 63), (12, [float("nan")] + [0.5] * 63), (13, [float("-inf")] + [0.5] * 63)]
    rows += [(100 + i, [0.25] * 64) for i in range(40)] + [(200, [1e5 if k % 2 else -1e5 for k in range(64)])]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", q int, cluster string")
    assert got(df) == plain(rows)
    assert got(spark.createDataFrame([], SCHEMA)) == [] == got(spark.createDataFrame([(1, None), (2, [1.0])], SCHEMA))
    assert [r["cluster"] for r in kmeans.clustered(spark.createDataFrame([(None, [0.5] * 64)] * 2, SCHEMA)).collect()] == [0, 0]
    huge = kmeans.clustered(spark.createDataFrame([(1, [3e38] * 64), (2, [-3e38] * 64)], SCHEMA)).collect()
    assert [r["distance"] for r in huge] == [0, 0]


def test_bounds_spare_scans(spark, sf_dir):
    """Vectors in clear groups keep their centroid by the bounds alone, and bounds hold at the end."""
    state, centroids = kmeans.cluster(spark.createDataFrame(blobs(7, 400, ties=True), SCHEMA))
    rows = state.collect()
    assert sum(r["scans"] for r in rows) < 3.5 * len(rows)
    for r in rows:
        d = np.sqrt(np.array([kmeans.squared(np.array([r["q"]]), c)[0] for c in centroids], dtype=float))
        assert d[r["cluster"]] <= r["upper"] and np.delete(d, r["cluster"]).min() >= r["lower"]


def test_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = sorted((str(r[0]), *r[1:]) for r in con.execute(kmeans.clustered_sql()).fetchall())
    assert got(spark.read.parquet(f"{sf_dir}/embeddings.parquet")) == want
