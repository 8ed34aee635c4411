"""Centroid clustering by Lloyd's rounds under Hamerly's bounds, in exact integers.

Vectors are turned into integers once. Each vector's row carries, from round to round, its centroid, an upper bound of the
distance to it and a lower bound of the distance to every other one; the rows of a round are written to the shared folder.
When centroids move, the upper bound grows by the drift of the vector's own centroid and the lower one shrinks by the
greatest drift of the others. A vector whose upper bound stays below its lower bound, or below half the way from its centroid
to the next one, keeps its centroid without a scan; the upper bound is tightened by one exact distance before giving up. All
others are ambiguous and get a full scan in integers. Bounds are padded by more than their rounding errors and compared
strictly, so ties always reach the scan, where the smaller centroid wins.

Only centroids and sums per centroid (at most CLUSTERS rows) reach the driver; each task adds up its own vectors first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import remove, spread, written

CLUSTERS, ROUNDS, WIDTH, SCALE = 16, 3, 64, 64
#: Integers are held within these bounds, so that squared distances fit 64 bits (components beyond 2 million are not expected).
MOST = 1 << 27
#: Relative padding of bounds; rounding errors are a thousandth of it.
PAD = 1e-12
_STATE = "vec_id long, q array<int>, cluster int, upper double, lower double, scans int"


def integers(vectors: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, q) of the vectors with exactly ``width`` components, none null or non-finite."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    sound = F.forall(x, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))  # NaN counts as greater than any number
    q = F.transform(x, lambda v: F.floor(F.greatest(F.least(v * scale, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int"))
    return vectors.where(F.coalesce((F.size("embedding") == width) & sound, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), q.alias("q"))


def starts(rows: DataFrame, clusters: int = CLUSTERS) -> np.ndarray:
    """The vectors with the smallest sha256 of ``1:<vec_id>``; equal hashes are taken by their vectors. Null ids are none,
    unless all are null: then the least vector is the only start."""
    key = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    picked = rows.where("vec_id IS NOT NULL").select(key.alias("key"), "q").orderBy("key", "q").limit(clusters).collect()
    if not picked:
        picked = rows.select("q").orderBy("q").limit(1).collect()
    return np.array([r["q"] for r in picked], dtype=np.int64)


def squared(q: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of integers; ``centroid`` is one row, or one for each row."""
    d = q - centroid
    return np.einsum("ij,ij->i", d, d)


def _matrix(q: pa.Array, width: int) -> np.ndarray:
    return q.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(q), width)


class Assigner:
    """Assigns batches of rows to centroids; ``before`` are the centroids that the rows' bounds were made for, if any."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None) -> None:
        self.centroids = centroids
        k = len(centroids)
        apart = np.sqrt(np.array([squared(centroids, c) for c in centroids], dtype=np.float64)) * (1 - PAD)
        apart[np.arange(k), np.arange(k)] = np.inf
        self.half = apart.min(axis=1) / 2
        if before is not None:
            self.drift = np.sqrt(squared(centroids, before).astype(np.float64)) * (1 + PAD)
            others = np.where(np.eye(k, dtype=bool), 0.0, self.drift)
            self.other_drift = others.max(axis=1)
        self.bounded = before is not None

    def scan(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(centroid, upper, lower) by all distances; ties go to the smaller number."""
        distances = np.stack([squared(q, c) for c in self.centroids], axis=1)
        best = distances.argmin(axis=1)
        at = np.arange(len(q))
        nearest = distances[at, best]
        distances[at, best] = np.iinfo(np.int64).max
        second = distances.min(axis=1).astype(np.float64) if len(self.centroids) > 1 else np.full(len(q), np.inf)
        return best, np.sqrt(nearest.astype(np.float64)) * (1 + PAD), np.sqrt(second) * (1 - PAD)

    def assign(self, q: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, scans: np.ndarray) -> tuple[np.ndarray, ...]:
        if not self.bounded:
            return *self.scan(q), scans + 1
        cluster, upper, lower, scans = cluster.copy(), upper + self.drift[cluster], lower - self.other_drift[cluster], scans.copy()
        enough = np.maximum(lower, self.half[cluster])
        open_ = np.flatnonzero(~(upper < enough))
        upper[open_] = np.sqrt(squared(q[open_], self.centroids[cluster[open_]]).astype(np.float64)) * (1 + PAD)
        open_ = open_[~(upper[open_] < enough[open_])]
        if len(open_):
            cluster[open_], upper[open_], lower[open_] = self.scan(q[open_])
            scans[open_] += 1
        return cluster, upper, lower, scans


def _assigned(rows: DataFrame, centroids: np.ndarray, before: np.ndarray | None) -> DataFrame:
    by = Assigner(centroids, before)
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "lower", "scans")] if before is not None else [None, None, None, np.zeros(batch.num_rows, np.int32)]
            cluster, upper, lower, scans = by.assign(_matrix(batch.column("q"), width), *held)
            columns = [batch.column("vec_id"), batch.column("q"), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(scans.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "q", "cluster", "upper", "lower", "scans"])

    return rows.mapInArrow(run, _STATE)


def _moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids of a round's clusters: floor(sum / count) in exact integers; empty ones stay."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            cluster, q = batch.column("cluster").to_numpy(zero_copy_only=False), _matrix(batch.column("q"), width)
            counts += np.bincount(cluster, minlength=k)
            np.add.at(sums, cluster, q)
        yield pa.RecordBatch.from_pydict({"cluster": list(range(k)), "n": counts.tolist(), "sums": sums.tolist()}, schema=pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))

    parts = state.select("cluster", "q").mapInArrow(run, "cluster int, n long, sums array<long>").where("n > 0")
    totals = parts.select("cluster", "n", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in totals.collect():
        out[r["cluster"], r["at"]] = int(r["x"]) // r["n"]
    return out


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """The state (vec_id, q, cluster, upper, lower, scans) after ``rounds`` rounds and one more assignment, and the centroids.

    scans counts a vector's full scans. Rows that repeat are vectors of their own, a null id is kept, but no start; with
    fewer vectors than ``clusters`` each is a start; an empty table has no rows and no centroids. Other columns are ignored.
    """
    rows, path = written(spread(integers(vectors, width, scale)), "integers")
    centroids = starts(rows, clusters)
    if not len(centroids):
        return rows.select("vec_id", "q", F.lit(0).alias("cluster"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"), F.lit(0).alias("scans")).where("false"), centroids
    state, before, old = rows, None, [path]
    for turn in range(rounds + 1):
        state, path = written(_assigned(state, centroids, before), "assigned")
        remove(vectors.sparkSession, *old)
        old = [path]
        if turn < rounds:
            before, centroids = centroids, _moved(state, centroids)
    return state, centroids


def digest(centroid: np.ndarray) -> str:
    """sha256 of a centroid's components as decimal integers joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def _distance(centroids: np.ndarray) -> Column:
    """The squared distance of q to its own centroid; the table of centroids is a literal of at most CLUSTERS rows."""
    own = F.get(F.array(*(F.array(*map(F.lit, c)) for c in centroids.tolist())), F.col("cluster"))
    return F.aggregate(F.zip_with("q", own, lambda a, b: (a.cast("long") - b) * (a.cast("long") - b)), F.lit(0).cast("long"), lambda s, x: s + x)


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, scans) of each kept vector; see ``cluster``.

    Sums that 64 bits cannot hold are null.
    """
    state, centroids = cluster(vectors, clusters, rounds, width, scale)
    spark = vectors.sparkSession
    if not len(centroids):
        return state.select("vec_id", "cluster", *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"), "scans")
    rows = state.select("vec_id", "cluster", _distance(centroids).alias("distance"), "scans")
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    facts = [(c, fits(s), fits(sum(sums.values())), digest(centroids[c])) for c, s in sums.items()]
    if not facts:
        return rows.select("vec_id", "cluster", "distance", *(F.lit(0).cast("long").alias(c) for c in ("cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"), "scans")
    table = F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return rows.join(table, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scans")


def clustered_sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE) -> str:
    """DuckDB SQL for ``clustered``'s rows without scans: plain rounds over all distances."""
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings
            WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {width})""",
        f"""comps AS MATERIALIZED (SELECT rid, vec_id, unnest(range({width})) AS pos, CAST(floor({scale} * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM kept)""",
        f"""first AS (SELECT rid, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c FROM kept WHERE vec_id IS NOT NULL QUALIFY c < {clusters})""",
        "cent0 AS MATERIALIZED (SELECT c, pos, x FROM first JOIN comps USING (rid))",
    ]
    for i in range(rounds + 1):
        parts.append(f"""near{i} AS MATERIALIZED (SELECT rid, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
            SELECT rid, c, sum((v.x - m.x) * (v.x - m.x)) AS d FROM comps v JOIN cent{i} m USING (pos) GROUP BY rid, c) GROUP BY rid)""")
        if i < rounds:
            parts.append(f"""cent{i + 1} AS MATERIALIZED (SELECT c, pos, coalesce((s - ((s % n) + n) % n) // n, x) AS x FROM cent{i} LEFT JOIN (
                SELECT c, pos, sum(x) AS s, count(*) AS n FROM near{i} JOIN comps USING (rid) GROUP BY c, pos) USING (c, pos))""")
    return f"""WITH {", ".join(parts)}
    SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
           CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
    FROM near{rounds} JOIN kept USING (rid) JOIN (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY pos)) AS h FROM cent{rounds} GROUP BY c) USING (c)"""
