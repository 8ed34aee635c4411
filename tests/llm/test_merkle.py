"""Fingerprints against plain rules, and edits against a plain loop."""

import hashlib
import random
from collections import Counter

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import merkle


def plain(rows):
    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + (1 << 63)) % (1 << 64)
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1])))
    out = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + nxt[:cut]
        a, b = merkle.fingerprint(t), merkle.fingerprint(edited)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, merkle.likeness(a, b), merkle.likeness(a, merkle.fingerprint(nxt))))
    return sorted(out, key=str)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é\n", max_size=40), st.text(alphabet="ab é\n", max_size=40))
def test_equal_roots_mean_equal_texts(a, b):
    assert (merkle.fingerprint(a) == merkle.fingerprint(b)) == (a == b)
    assert 0 <= merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(b)) <= 1
    covered = {i for s, e in merkle.differing(a, b) for i in range(s, e)}
    assert covered <= set(range(len(a.encode())))


def test_likeness_follows_the_edit():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    text = "\n".join(" ".join(word() for _ in range(40)) for _ in range(20))
    for share in (0.05, 0.25, 0.5):
        cut = int(len(text) * share)
        edited = text[:-cut] + " ".join(word() for _ in range(cut // 5))
        near = merkle.likeness(merkle.fingerprint(text), merkle.fingerprint(edited))
        assert abs(near - (1 - share)) < 0.2
        assert all(s >= len(text) - cut - 40 for s, _ in merkle.differing(text, edited))
    middle = text.replace(text[2000:2020], "XXXX YYYY")
    assert all(1900 < s and e < 2150 for s, e in merkle.differing(text, middle))
    assert merkle.differing(text, text) == []


def leaves(text):
    """The pieces of a text, found by a plain loop: cut after the greatest hash around, after line feeds and after 24 bytes;
    with each, whether it is an empty line."""
    b = text.encode()
    word = lambda i: int.from_bytes(bytes(b[j] if j >= 0 else 0 for j in range(i, i - 4, -1)), "little")
    h = [(word(i) * 0x9E3779B1 % (1 << 32)) ^ 0x5BD1E995 for i in range(len(b))]
    out, start = [], 0
    for i in range(len(b)):
        peak = all(h[i] > x for x in [0, *h[max(0, i - 6) : i]]) and all(h[i] >= x for x in h[i + 1 : i + 7])
        if peak or b[i] == 10 or i + 1 == len(b):
            parts = [(k, b[k : min(k + 24, i + 1)]) for k in range(start, i + 1, 24)]
            out += [(p, p == b"\n" and (k == 0 or b[k - 1] == 10)) for k, p in parts]
            start = i + 1
    return out


def dice(a, b):
    x, y = Counter(leaves(a)), Counter(leaves(b))
    return 2 * (x & y).total() / (x.total() + y.total())


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcde é中\n", max_size=300), st.text(alphabet="abcde é中\n", max_size=300))
def test_likeness_is_that_of_the_leaves(a, b):
    if leaves(a) or leaves(b):
        assert merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(b)) == pytest.approx(1.0 if a == b else dice(a, b))


LONG = ["!" * 5000, "w! " * 900, "中文字" * 700, "x" * 100_000, "ab" * 3000, "\n" * 9000, "word " * 40_000, "".join(chr(0x4E00 + i * 7919 % 20000) for i in range(4000))]


@pytest.mark.parametrize("text", LONG)
def test_likeness_of_long_and_even_texts(text):
    cut = len(text) // 4
    near = merkle.likeness(merkle.fingerprint(text), merkle.fingerprint(text[:-cut] + "".join(chr(0x3B1 + i * i % 20) for i in range(cut))))
    assert 0.6 < near < 0.9
    assert merkle.likeness(merkle.fingerprint(text), merkle.fingerprint(text + "!")) > 0.85
    spans = merkle.differing(text, text[:-cut] + "?" * cut)
    assert spans and spans[0][0] >= len(text[:-cut].encode()) - 64 and spans[-1][1] == len(text.encode())
    assert len(merkle.fingerprint(text)) <= 35 + 16 * merkle.LIMIT


def test_texts_do_not_touch_each_other():
    texts = [None, "", "a", "", "\n", *LONG, "", "b" * 30, "line\n\nline\n"]
    assert merkle.fingerprints_of(texts) == [merkle.fingerprint(t) for t in texts]
    assert merkle.fingerprints_of([]) == []


def test_one_id_over_many_ranges():
    ranges = merkle.Ranges([1, 5, 5, 5, 5, 9])
    least, most = -(1 << 63), (1 << 63) - 1
    import numpy as np

    key = np.array([0, 1, 4, 5, 5, 5, 5, 6, 9])
    tie = np.array([most, least, 0, least, -1, 0, most, 3, 3])
    assert ranges.of(key, tie).tolist() == [0, 1, 1, 2, 3, 4, 5, 5, 6]


def test_rows_without_ids_are_split(spark):
    docs = spark.createDataFrame([(None, f"text {i}") for i in range(4000)], "doc_id long, text string")
    sizes = [r.n for r in merkle.with_next(docs).where("NOT last").groupBy("range").count().withColumnRenamed("count", "n").collect()]
    assert len(sizes) > 8 and max(sizes) < 1000


def test_rows(spark):
    rows = [(5, "alpha beta gamma delta " * 5), (1, "x" * 9), (1, "a" * 9), (1, "b" * 9), (9, None), (12, "é" * 40), (None, "first of all"), (None, None), (-4, "one\n\ntwo three four")]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, key string")
    assert sorted(map(tuple, merkle.edited_likeness(docs).collect()), key=str) == plain(rows)
    one = docs.where("doc_id = 5")
    assert [r.near_next for r in merkle.edited_likeness(one).collect()] == [1.0]
    assert merkle.edited_likeness(docs.limit(0)).count() == 0
    assert {r.doc_id: r.fingerprint for r in merkle.fingerprints(one).collect()} == {5: merkle.fingerprint(rows[0][1])}


def test_ids_beyond_doubles(spark):
    rows = [((1 << 62) + i * i, f"text {i} " * (i + 1)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted(map(tuple, merkle.edited_likeness(docs).collect()), key=str) == plain(rows)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = merkle.edited_likeness(docs).collect()
    assert sorted(map(tuple, got), key=str) == plain([(r.doc_id, r.text) for r in docs.collect()])
    assert all(r.near_edited > max(0.6, r.near_next) or r.near_next > 0.6 for r in got if r.n_chars > 200)
