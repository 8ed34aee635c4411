"""A deterministic hash embedding: words, word pairs and character trigrams in signed buckets, of unit length."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 384
#: Greatest components of a vector that are its buckets.
BUCKETS = 8


def embed(text: str | None) -> list[float]:
    text = re.sub(r"<NUM_\d+>", "<num>", text or "")
    words = text.split()
    parts = [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)), *(text[i : i + 3] for i in range(len(text) - 2))]
    vector = np.zeros(DIMENSIONS, dtype=np.float32)
    if parts:
        digests = [hashlib.blake2b(p.encode(), digest_size=8).digest() for p in parts]
        at = np.array([int.from_bytes(d[:4], "little") % DIMENSIONS for d in digests])
        np.add.at(vector, at, np.array([1.0 if d[4] & 1 else -1.0 for d in digests], dtype=np.float32))
        length = float(np.linalg.norm(vector))
        if length:
            vector /= length
    return vector.tolist()


def _embedded(texts: pa.Array) -> pa.Array:
    held = texts.fill_null("").dictionary_encode()
    found = np.array([embed(t) for t in held.dictionary.to_pylist()], dtype=np.float32).reshape(-1, DIMENSIONS)
    offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * DIMENSIONS)
    return pa.ListArray.from_arrays(offsets, pa.array(found.ravel())).take(held.indices)


def embedding(c: Column) -> Column:
    """The embedding of a text column, by Arrow batches; a text that a batch repeats is embedded once. Declared as not
    deterministic so that the planner never computes it twice."""
    return F.arrow_udf(_embedded, "array<float>").asNondeterministic()(c)


def _bucketed(texts: pa.Array) -> pa.Array:
    held, found = texts.fill_null("").dictionary_encode(), []
    for text in held.dictionary.to_pylist():
        v = np.array(embed(text), dtype=np.float32)
        at = np.lexsort((np.arange(DIMENSIONS), -np.abs(v)))[:BUCKETS]
        found.append([f"v:{i}:{int(v[i] >= 0)}" for i in at if v[i]])
    return pa.array(found, pa.list_(pa.string())).take(held.indices)


def buckets(c: Column) -> Column:
    """``values.vector_buckets`` of a text's embedding, made once for a text that a batch repeats; the vector is not moved."""
    return F.arrow_udf(_bucketed, "array<string>").asNondeterministic()(c)


@lru_cache(maxsize=1 << 12)
def _held(text: str) -> np.ndarray:
    return np.array(embed(text), dtype=np.float32).astype(np.float64)


@lru_cache(maxsize=1 << 15)
def _likeness(a: str, b: str) -> float:
    # summed one by one, as ``values.cosine`` does
    return min(1.0, max(0.0, float(np.add.accumulate(_held(a) * _held(b))[-1])))


def _likenesses(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([_likeness(x or "", y or "") for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


def likeness(a: Column, b: Column) -> Column:
    """The cosine of two texts' embeddings, clipped to 0 and 1. Equal pairs of a worker are compared once, and no vector is
    moved with a row."""
    return F.arrow_udf(_likenesses, "double")(a, b)


def with_cache(rows: DataFrame, text: str, cache: DataFrame | None) -> DataFrame:
    """Adds embedding; only distinct texts that the cache (key, embedding) lacks are computed."""
    keyed = rows.withColumn("key", F.sha2(text, 256))
    wanted = keyed.select("key", text).dropDuplicates(["key"])
    if cache is None:
        return keyed.join(wanted.select("key", embedding(F.col(text)).alias("embedding")), "key", "left").drop("key")
    missing = wanted.join(cache.select("key"), "key", "left_anti")
    known = cache.select("key", "embedding").unionByName(missing.select("key", embedding(F.col(text)).alias("embedding")))
    return keyed.join(known, "key", "left").drop("key")
