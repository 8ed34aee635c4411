"""Similarity search: vectors in blocks, trigrams and words by hash joins."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.postings import top_k, top_k_split
from ledgerline.operators.staging import staged

#: Query vectors that are held at once (a block of them is 4 MB at 64 dimensions in float64).
QUERY_BLOCK = 8192
#: Rows that are scored at once (a block of scores is 16 MB).
ROW_BLOCK = 256


class _Best:
    """The ``k`` best rows of each query so far, by rounded score and then by key."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.scores = np.full((queries, 0), -np.inf)
        self.keys = np.zeros((queries, 0), dtype=np.int64)

    def take(self, scores: np.ndarray, keys: np.ndarray) -> None:
        """``scores`` has a row for each query and a column for each key."""
        scores = np.concatenate([self.scores, scores], axis=1)
        keys = np.concatenate([self.keys, np.broadcast_to(keys, (len(scores), len(keys)))], axis=1)
        if scores.shape[1] > self.k:
            # the k-th best score bounds what can stay; ties at it are settled by key
            bound = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, -self.k]
            width = int((scores >= bound[:, None]).sum(axis=1).max())
            at = np.argpartition(-scores, width - 1, axis=1)[:, :width] if width < scores.shape[1] else np.broadcast_to(np.arange(width), scores.shape)
            scores, keys = np.take_along_axis(scores, at, axis=1), np.take_along_axis(keys, at, axis=1)
        order = np.lexsort((keys, -scores), axis=1)[:, : self.k]
        self.scores, self.keys = np.take_along_axis(scores, order, axis=1), np.take_along_axis(keys, order, axis=1)


def nearest(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(query_id, key, cosine, rank): the ``k`` nearest rows of each query by rounded dot product, ties by id.

    Exact. Queries are taken in blocks of a bounded size (one scan of the rows for each); a task keeps the best rows of a
    block's queries and gives them at its end, so what is shuffled grows with tasks and queries, not with rows.
    """
    ordered = queries.select(F.col(key).alias("query_id"), F.col(vector).alias("v"))
    blocks = max(1, -(-ordered.count() // QUERY_BLOCK))
    found = rows.sparkSession.createDataFrame([], f"query_id long, {key} long, cosine double")
    arrow = pa.schema([("query_id", pa.int64()), (key, pa.int64()), ("cosine", pa.float64())])
    for b in range(blocks):
        part = ordered.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        if not part:
            continue
        ids = np.array([r["query_id"] for r in part])
        matrix = np.array([r["v"] for r in part], dtype=np.float64)

        def run(batches: Iterator[pa.RecordBatch], ids=ids, matrix=matrix) -> Iterator[pa.RecordBatch]:
            best = _Best(len(ids), k + 1)  # one more, since a query may meet itself
            for batch in batches:
                for start in range(0, batch.num_rows, ROW_BLOCK):
                    some = batch.slice(start, ROW_BLOCK)
                    flat = some.column(vector)
                    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(some.num_rows, -1)
                    best.take(np.round(np.clip(matrix @ values.T, 0.0, 1.0), 6), some.column(key).to_numpy(zero_copy_only=False))
            width = best.keys.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, width)), pa.array(best.keys.ravel(), pa.int64()), pa.array(best.scores.ravel())], schema=arrow)

        found = found.unionByName(rows.select(key, vector).where(F.col(vector).isNotNull()).mapInArrow(run, f"query_id long, {key} long, cosine double"))
    return top_k(found.where(F.col("query_id") != F.col(key)), ["query_id"], [F.desc("cosine"), F.col(key)], k)


def cells(rows: DataFrame, key: str, vector: str, count: int, sample: int = 65_536, rounds: int = 8) -> np.ndarray:
    """The centres of ``count`` cells of unit vectors, by a few rounds on a sample: the rows with the least hashes, at most
    ``sample`` of them (the only place that does not see all rows; every row gets a cell)."""
    picked = rows.where(F.col(vector).isNotNull()).select(vector, F.xxhash64(key).alias("_h"), key).orderBy("_h", key).limit(sample).collect()
    x = np.array([r[vector] for r in picked], dtype=np.float64)
    if len(x) <= count:
        return x
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centres = x[:: max(len(x) // count, 1)][:count].copy()
    for _ in range(rounds):
        at = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        held = np.bincount(at, minlength=len(centres)) > 0
        centres[held] = sums[held] / np.maximum(np.linalg.norm(sums[held], axis=1, keepdims=True), 1e-12)
    return centres


def _celled(rows: DataFrame, key: str, vector: str, centres: np.ndarray, most: int) -> DataFrame:
    """(key, vector, cell): each row in its ``most`` nearest cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(vector).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :most]
            at = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(key).take(at), batch.column(vector).take(at), pa.array(near.ravel().astype(np.int32))], names=[key, vector, "cell"])

    kinds = rows.select(key, vector).schema
    return rows.select(key, vector).where(F.col(vector).isNotNull()).mapInArrow(run, f"{key} {kinds[0].dataType.simpleString()}, {vector} {kinds[1].dataType.simpleString()}, cell int")


#: Rows and queries of a cell that one task holds; what is more is dealt out, every part of the rows with every part of the queries.
CELL_ROWS, CELL_QUERIES = 32_768, 8_192


@dataclass
class Cells:
    """An inverted file over vectors: each row lies in the cell of its nearest centre."""

    key: str
    vector: str
    centres: np.ndarray
    held: DataFrame  # key, vector, cell
    sizes: DataFrame  # cell, parts


def cell_index(rows: DataFrame, key: str, vector: str, count: int = 256) -> Cells:
    """An inverted file of ``count`` cells; every row with a vector gets into one."""
    centres = cells(rows, key, vector, count)
    held = staged(_celled(rows, key, vector, centres, 1), "cells") if len(centres) else rows.select(key, vector, F.lit(0).alias("cell")).limit(0)
    return Cells(key, vector, centres, held, held.groupBy("cell").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("parts")))


def search_cells(index: Cells, queries: DataFrame, k: int, probes: int = 96, least: float = 0.0, itself: bool = False) -> DataFrame:
    """(query_id, key, cosine, rank): the ``k`` best rows in the ``probes`` cells nearest to each query, by exact rounded dot
    products from ``least`` on, ties by id; ``itself`` lets in the row that has the query's key.

    Cells and their queries may be of any size: both are dealt out, so a task holds at most about CELL_ROWS rows and
    CELL_QUERIES queries.
    """
    key, vector = index.key, index.vector
    out = f"query_id long, {key} long, cosine double"
    if not len(index.centres):
        return queries.sparkSession.createDataFrame([], out + ", rank int")
    near = _celled(queries, key, vector, index.centres, probes)
    turns = near.groupBy("cell").agg(F.ceil(F.count("*") / CELL_QUERIES).cast("int").alias("turns"))
    # at most a row for each cell
    sizes = F.broadcast(staged(index.sizes.join(turns, "cell"), "cell-sizes"))
    deal = lambda many: F.pmod(F.xxhash64(key), F.col(many)).cast("int")
    each = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
    held = index.held.join(sizes, "cell").withColumn("part", deal("parts")).withColumn("turn", each("turns"))
    asked = near.join(sizes, "cell").withColumn("turn", deal("turns")).withColumn("part", each("parts"))
    most = k if itself else k + 1

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, found, scores = [], [], []
        keys = right.column(key).to_numpy()
        if left.num_rows and right.num_rows:
            matrix = lambda t: t.column(vector).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)
            values, mine = matrix(right), left.column(key).to_numpy()
            for start in range(0, left.num_rows, ROW_BLOCK):
                q = matrix(left.slice(start, ROW_BLOCK))
                best = _Best(len(q), most)
                best.take(np.round(np.clip(q @ values.T, 0.0, 1.0), 6), keys)
                kept = best.scores >= least
                ids.append(np.repeat(mine[start : start + ROW_BLOCK], kept.sum(axis=1)))
                found.append(best.keys[kept])
                scores.append(best.scores[kept])
        join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
        return pa.table({"query_id": join(ids, pa.int64()), key: join(found, pa.int64()), "cosine": join(scores, pa.float64())})

    at = ["cell", "part", "turn"]
    met = asked.select(*at, key, vector).groupBy(*at).cogroup(held.select(*at, key, vector).groupBy(*at)).applyInArrow(meet, out)
    return top_k(met if itself else met.where(F.col("query_id") != F.col(key)), ["query_id"], [F.desc("cosine"), F.col(key)], k)


def nearest_in_cells(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int, count: int = 256, probes: int = 96) -> DataFrame:
    """``nearest`` by an inverted file. It reads a part of the rows for each query, and may miss what lies in other cells (see the
    recall in the README)."""
    return search_cells(cell_index(rows, key, vector, count), queries, k, probes)


def trigrams(c: Column) -> Column:
    """Distinct trigrams of lower-case words, each padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")

    def of(w: Column) -> Column:
        held = F.concat(F.lit("  "), w, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(held) - 2), lambda i: F.substring(held, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words, of)))


def set_similarity(left: DataFrame, right: DataFrame, left_key: str, right_key: str, sets: str, least: float) -> DataFrame:
    """(left_key, right_key, similarity): pairs of sets with a Jaccard similarity of at least ``least``, by joining members.

    Pairs are made only through the rarest members of the left set (prefix filter), then verified on the sets. Rows that hold the
    same set share its pairs: distinct sets are matched, and each row gets the list of its set's, so no member that many rows
    hold fills a task.
    """
    told = lambda rows, key, own: rows.where(F.size(sets) > 0).select(key, F.array_sort(sets).alias(own))
    held, named = told(left, left_key, "_left"), told(right, right_key, "_right")
    each = lambda rows, own: rows.distinct().withColumn(sets, F.col(own))
    pairs = _distinct_similarity(each(held.select("_left"), "_left"), each(named.select("_right"), "_right"), "_left", "_right", sets, least)
    # written first, so that the planner knows their size and sends them to the rows where they are few
    pairs = staged(pairs.join(named, "_right").select("_left", right_key, "similarity"), "set-pairs")
    return held.join(pairs, "_left").select(left_key, right_key, "similarity")


def _distinct_similarity(left: DataFrame, right: DataFrame, left_key: str, right_key: str, sets: str, least: float) -> DataFrame:
    counts = right.select(F.explode(sets).alias("member")).groupBy("member").agg(F.count("*").alias("n"))
    members = left.select(left_key, F.size(sets).alias("size"), F.explode(sets).alias("member")).join(counts, "member", "left")
    need = F.ceil(F.col("size") * least)
    prefix = top_k(members, [left_key], [F.coalesce("n", F.lit(0)), F.col("member")], 1 << 30, "at").where(F.col("at") <= F.col("size") - need + 1)
    probe = right.select(right_key, F.explode(sets).alias("member"))
    pairs = prefix.select(left_key, "member").join(probe, "member").select(left_key, right_key).distinct()
    both = pairs.join(left.select(left_key, F.col(sets).alias("a")), left_key).join(right.select(right_key, F.col(sets).alias("b")), right_key)
    common = F.size(F.array_intersect("a", "b"))
    similarity = common / (F.size("a") + F.size("b") - common)
    return both.select(left_key, right_key, similarity.alias("similarity")).where(F.col("similarity") >= least)


#: Rows that the first look at a query's rarest words should meet, for each row that is asked for.
FIRST_LOOK = 8


def top_scored(asked: DataFrame, postings: DataFrame, query_key: str, key: str, k: int) -> DataFrame:
    """(query_key, key, score, rank): the ``k`` rows with the greatest sums over a query's words, ties by key. Exact.

    ``asked`` has (query_key, word), ``postings`` (key, word, score) with scores above 0, each pair once. A first look at some
    rows that have the rarest words gives a score that the k-th row has at least; the most common words whose greatest scores together stay below
    it cannot bring in a row alone, so only the other words' postings are walked, and a row is completed with the common words
    only if it can still get there. No pair of a query and a row is made through a common word (max-score).
    """
    asked = asked.distinct()
    postings = staged(postings.select(key, "word", "score").join(asked.select("word").distinct(), "word", "left_semi"), "asked-postings")
    most = postings.groupBy("word").agg(F.count("*").alias("rows"), F.max("score").alias("most"))
    words = asked.join(most, "word")
    rare = Window.partitionBy(query_key).orderBy("rows", "word")
    words = words.withColumn("_met", F.coalesce(F.sum("rows").over(rare.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # from the most common word on: what these and all commoner ones give at most
    words = words.withColumn("_reach", F.sum("most").over(rare.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    words = staged(words, "asked-words")
    look = words.where(F.col("_met") < FIRST_LOOK * k).select(query_key, "word").join(postings, "word").groupBy(query_key, key).agg(F.sum("score").alias("score"))
    look = top_k(look, [query_key], [F.desc("score"), F.col(key)], FIRST_LOOK * k).select(query_key, key)
    look = look.join(words.select(query_key, "word"), query_key).join(postings, [key, "word"]).groupBy(query_key, key).agg(F.sum("score").alias("score"))
    sure = top_k(look, [query_key], [F.desc("score"), F.col(key)], k).groupBy(query_key).agg(F.when(F.count("*") == k, F.min("score")).alias("sure"))
    words = words.join(sure, query_key, "left").withColumn("sure", F.coalesce("sure", F.lit(0)))
    walked = F.col("_reach") >= F.col("sure")
    rest = words.where(~walked).groupBy(query_key).agg(F.sum("most").alias("rest"))
    met = words.where(walked).select(query_key, "word", "sure").join(postings, "word").groupBy(query_key, key).agg(F.sum("score").alias("score"), F.max("sure").alias("sure"))
    met = met.join(rest, query_key, "left").where(F.col("score") + F.coalesce("rest", F.lit(0)) >= F.col("sure"))
    more = met.select(query_key, key).join(words.where(~walked).select(query_key, "word"), query_key).join(postings, [key, "word"]).select(query_key, key, "score")
    total = met.select(query_key, key, "score").unionByName(more).groupBy(query_key, key).agg(F.sum("score").alias("score"))
    return top_k_split(total, [query_key], [F.desc("score"), F.col(key)], k, F.col(key))


def word_overlap(queries: DataFrame, rows: DataFrame, query_key: str, key: str, words: str) -> DataFrame:
    """(query_key, key, hits): how many distinct words of a query a row has (an OR query's rank)."""
    q = queries.select(query_key, F.explode(words).alias("word"))
    r = rows.select(key, F.explode(words).alias("word"))
    return q.join(r, "word").groupBy(query_key, key).agg(F.count("*").alias("hits"))
