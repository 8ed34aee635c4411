"""Byte-pair encoding and decoding by batched numpy merge rounds.

The symbols of many words lie end to end in one flat array, words parted by a negative sentinel. A round looks up every
adjacent pair by binary search over the sorted pair keys, takes the lowest-ranked pair of each word and merges it; rounds
go on until no word has a ranked pair. Words are encoded once per batch and remembered by their bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import bpe_vocab
from ledgerline.llm.common import map_texts, spread

#: Entries of each memo of a worker; a full memo starts anew.
MEMO = 600_000
_FAR = np.int64(1) << 40


def encode_words(words: list[bytes], vocab: bpe_vocab.Vocabulary) -> list[bytes]:
    """The ids of each word (not empty) as little-endian unsigned 32-bit integers."""
    if not words:
        return []
    flat = np.frombuffer(b"".join(words), dtype=np.uint8)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    word = np.repeat(np.arange(len(words)), size)
    symbol = np.full(len(flat) + len(words), -1, dtype=np.int64)
    symbol[np.arange(len(flat)) + word] = vocab.of_byte[flat]
    owner = np.full(len(symbol), -1, dtype=np.int64)
    owner[np.arange(len(flat)) + word] = word
    done_symbols: list[np.ndarray] = []
    done_owners: list[np.ndarray] = []
    top = len(vocab.keys) - 1
    while len(symbol):
        pair = np.where((symbol[:-1] >= 0) & (symbol[1:] >= 0), symbol[:-1] * vocab.base + symbol[1:], -1)
        spot = np.minimum(np.searchsorted(vocab.keys, pair), top) if top >= 0 else np.zeros(len(pair), dtype=np.int64)
        ranked = (vocab.keys[spot] == pair) if top >= 0 else np.zeros(len(pair), dtype=bool)
        rank = np.where(ranked, vocab.ranks[spot] if top >= 0 else 0, _FAR)
        least = np.full(len(words), _FAR)
        np.minimum.at(least, owner[:-1][ranked], rank[ranked])
        active = (owner >= 0) & (least[owner] < _FAR)
        finished = (owner >= 0) & ~active
        done_symbols.append(symbol[finished])
        done_owners.append(owner[finished])
        places = np.flatnonzero(ranked & (rank == least[owner[:-1]]))
        if not len(places):
            break
        # in a run of overlapping places the first, third, ... merge
        starts = np.flatnonzero(np.r_[True, np.diff(places) != 1])
        along = np.arange(len(places)) - np.repeat(starts, np.diff(np.r_[starts, len(places)]))
        places = places[along % 2 == 0]
        symbol[places] = vocab.results[spot[places]]
        stay = active.copy()
        stay[places + 1] = False
        # the sentinel after a word that goes on stays with it
        ends = np.flatnonzero(owner < 0)
        stay[ends] = active[ends - 1]
        symbol, owner = symbol[stay], owner[stay]
    symbols, owners = np.concatenate(done_symbols), np.concatenate(done_owners)
    order = np.argsort(owners, kind="stable")
    stream = symbols[order].astype("<u4").tobytes()
    stops = np.cumsum(np.bincount(owners, minlength=len(words))) * 4
    return [stream[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]


class Codec:
    """Encodes texts to ids and ids to texts, as the vocabulary's library does by default."""

    def __init__(self, path: str) -> None:
        self.vocab = bpe_vocab.load(path)
        self.of: dict[str, bytes] = {}
        self.feed = encode_words([b"\n"], self.vocab)[0]

    def _learn(self, keys: set[str]) -> None:
        new = [k for k in keys if k not in self.of]
        if not new:
            return
        if len(self.of) + len(new) > MEMO:
            self.of, new = {}, list(keys)
        split = [self.vocab.pattern.findall(k) for k in new]
        words = sorted({w for ws in split for w in ws})
        got = dict(zip(words, encode_words([w.encode() for w in words], self.vocab), strict=True))
        self.of |= {k: b"".join(map(got.__getitem__, ws)) for k, ws in zip(new, split, strict=True)}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Per text the bytes of its ids, little-endian unsigned 32-bit; a null text has none."""
        special = self.vocab.special
        plans: list[list[str | bytes]] = []
        keys: set[str] = set()
        for text in texts:
            plan: list[str | bytes] = []
            for part, mark in bpe_vocab.segments(text, special) if text and any(s in text for s in special) else [(text or "", None)]:
                if part and bpe_vocab.regular(part):
                    for n, line in enumerate(part.split("\n")):
                        if n:
                            plan.append(self.feed)
                        head, *tail = line.split(" ")
                        tail = [" " + x for x in tail]
                        plan.append(head)
                        plan += tail
                        keys.add(head)
                        keys.update(tail)
                elif part:
                    pieces = self.vocab.pattern.findall(part)
                    plan += pieces
                    keys.update(pieces)
                if mark is not None:
                    plan.append(int(mark).to_bytes(4, "little"))
            plans.append(plan)
        self._learn(keys)
        of = self.of
        return [b"".join([x if isinstance(x, bytes) else of[x] for x in plan]) for plan in plans]

    def decode(self, ids: bytes) -> str:
        """The text of an id stream; bytes that are no UTF-8 become replacement characters."""
        pieces = self.vocab.pieces
        return b"".join([pieces[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a vocabulary file, one per worker."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids binary) of every row: its ids as little-endian unsigned 32-bit integers.

    A null or empty text has an empty stream; repeated rows and null ids give a row each; other columns are ignored.
    """
    arrow = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(rows: pa.RecordBatch) -> dict[str, list]:
        return {"doc_id": rows.column("doc_id").to_pylist(), "ids": codec(path).encode(rows.column("text").to_pylist())}

    return map_texts(spread(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))), run, "doc_id long, ids binary", arrow)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); a null stream decodes to an empty text."""
    arrow = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(rows: pa.RecordBatch) -> dict[str, list]:
        return {"doc_id": rows.column("doc_id").to_pylist(), "text": [codec(path).decode(x or b"") for x in rows.column("ids").to_pylist()]}

    return map_texts(encoded.select("doc_id", "ids"), run, "doc_id long, text string", arrow, text="ids")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes every row in one pass, with digests of both.

    Nulls, repeats and other columns as in :func:`encode`; an empty stream has the digest of no bytes.
    """
    arrow = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(rows: pa.RecordBatch) -> dict[str, list]:
        c = codec(path)
        streams = c.encode(rows.column("text").to_pylist())
        return {
            "doc_id": rows.column("doc_id").to_pylist(),
            "n_tokens": [len(x) // 4 for x in streams],
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in streams],
            "decoded_sha256": [hashlib.sha256(c.decode(x).encode()).hexdigest() for x in streams],
        }

    return map_texts(spread(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", arrow)
