"""Fingerprints, links and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from ledgerline.llm import simhash


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(ids, prints):
    parent = list(range(len(ids)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    a = np.array(prints, dtype=np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 3) + i + 1:
            parent[top(j)] = top(i)
    least = {}
    for i, d in enumerate(ids):
        r = top(i)
        least[r] = min(filter(lambda x: x is not None, (least.get(r), d)), default=None)
    return [least[top(i)] for i in range(len(ids))]


def test_fingerprints():
    for t in [None, "", " \n", "One", "a b", "A b C", "É x\x0by z\x1cq w", "the cat sat on the mat " * 50, "x " * 70000, "a b c d"]:
        assert simhash.fingerprint(t) & (1 << 64) - 1 == plain_fingerprint(t), t


@pytest.mark.parametrize("seed, crowd", [(1, simhash.CROWD), (2, simhash.CROWD), (3, 0), (4, 2)])
def test_links_are_whole(spark, monkeypatch, seed, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(seed)
    prints = {0, (1 << 64) - 1}
    for _ in range(40):
        x = rng.getrandbits(64)
        prints.add(x)
        for _ in range(rng.randrange(12)):
            prints.add(x := x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5))))
    for b in (0, 30, 31, 32, 62, 63):  # the unprotected bits and their neighbours
        prints.add(1 << b)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    got = [(r.u, r.v) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()]
    want = [(u, v) for i, u in enumerate(signed) for v in signed[i + 1 :] if ((u ^ v) & (1 << 64) - 1).bit_count() <= 3]
    assert sorted(got) == sorted(want)
    assert len(want) > 20


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(-5, -9), (7, 7)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {-5: -9, -9: -9}


def test_rows(spark):
    rows = [(5, "one two three four"), (3, "one two three four"), (3, "one two three four"), (9, None), (8, ""), (None, "lone text here"), (None, None), (7, "something else entirely and more")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string")
    got = sorted(((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([("5", 3), ("3", 3), ("3", 3), ("9", 8), ("8", 8), ("None", None), ("None", 8), ("7", 7)], key=str)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "7", "8", "None"]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_one_of_each_component(spark):
    lone = [(None, f"text number {i} with its own words {i * 7} {i * 11} and {i * 13}") for i in range(5)]
    rows = lone + lone[:2] + [(1, "first text of an id that comes twice"), (1, "quite another story under this same id"), (2, "quite another story under this same id")]
    docs = spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id long, text string, _id string, _row string")
    kept = [tuple(r) for r in simhash.one_of_each(docs).collect()]
    assert sorted(kept, key=str) == sorted([(*r, "a", "b") for r in lone + rows[7:9]], key=str)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    want = {r.doc_id: (f"{p:016x}", c) for r, p, c in zip(rows, prints, plain_components([r.doc_id for r in rows], prints), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()} == want
