"""Counts and codes against the public library, on odd texts."""

import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerline.llm import bpe_codec, token_count

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a   b\n\n c", "tab\there", "it's we'll I'M", "aaaaaaaaaaaaaaaaa", "ababababab aaaa aaa",
    "Émile où ça ñandú straße", "日本語のテキスト", "🙂🙂 🙃", "x<|endoftext|>y", "<|endoftext|><|endoftext|>", " <|endoftext|> \n", "3.14159 1,000,000 ½", "a b c　d",
    "line one.\nLine two.\n\nLine", "trail \n next", "\r\nx\r\n", "a\x1cb \x85c", "word " * 3000, "!!!???...---", "don't 'sup 's", "﻿bom", "é",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def stream(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def test_counts_match_the_library(library):
    assert token_count.Counter(PATH).count(TEXTS) == [len(library.encode(t, add_special_tokens=False).ids) for t in TEXTS]


def test_codes_match_the_library(library):
    c = bpe_codec.Codec(PATH)
    for text, ids in zip(TEXTS, c.encode(TEXTS), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == stream(want)
        assert c.decode(ids) == library.decode(want, skip_special_tokens=False) == text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab cdeé\n\t'sT1 .!|<>ñ 日endoftx|"), max_size=60), max_size=8))
def test_any_text(texts):
    library, c = Tokenizer.from_file(PATH), bpe_codec.codec(PATH)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert c.encode(texts) == [stream(w) for w in want]
    assert token_count.Counter(PATH).count(texts) == [len(w) for w in want]


def test_memo_starts_anew(library, monkeypatch):
    monkeypatch.setattr(token_count, "MEMO", 3)
    c = token_count.Counter(PATH)
    for t in ("a b c d e f", "g h a", "a b"):
        assert c.count([t]) == [len(library.encode(t, add_special_tokens=False).ids)]


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (2, "two words", "y"), (2, "two words", "y"), (None, "no id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(token_count.count_tokens(docs, PATH, limit=1).collect(), key=str)
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got if r.doc_id) == [(1, 0, 0, False), (2, 0, 0, False), (2, 9, 2, True), (2, 9, 2, True)]
    again = bpe_codec.decode(bpe_codec.encode(docs, PATH), PATH)
    assert sorted(r.text for r in again.collect()) == ["", "", "no id", "two words", "two words"]
    one = bpe_codec.round_trip(docs.where("doc_id = 1"), PATH).collect()[0]
    assert (one.n_tokens, one.ids_sha256, one.decoded_sha256) == (0, *[hashlib.sha256(b"").hexdigest()] * 2)
    assert token_count.count_tokens(docs.limit(0), PATH).count() == 0


def test_whole_table(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    assert {r.doc_id: r.n_tokens for r in token_count.count_tokens(docs, PATH).collect()} == {i: len(w) for i, w in want.items()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_codec.round_trip(docs, PATH).collect()}
    assert got == {i: (len(w), hashlib.sha256(stream(w)).hexdigest(), hashlib.sha256(texts[i].encode()).hexdigest()) for i, w in want.items()}
