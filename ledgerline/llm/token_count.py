"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch lie in one ragged numpy array (symbols and word starts). In each round every word finds the lowest
rank among its adjacent pairs and merges all places of that pair at once; words without a ranked pair leave the array. A
merge only makes pairs of higher rank than its own, so this equals merging one place at a time. What is left is counted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import bpe_vocab
from ledgerline.llm.common import map_texts, spread

#: Entries of each memo of a worker; a full memo starts anew.
MEMO = 800_000
NONE = np.int64(1) << 40
_SLOTS = 8


class PairTable:
    """Merge ranks in a table of buckets that a multiplicative hash picks: a lookup compares one row of slots."""

    def __init__(self, vocab: bpe_vocab.Vocabulary) -> None:
        self.bits = max(8, int(np.ceil(np.log2(len(vocab.keys) + 1))) + 1)
        while True:
            h = self._hash(vocab.keys)
            order = np.argsort(h, kind="stable")
            at = np.arange(len(h)) - np.searchsorted(h[order], h[order])
            if not len(at) or at.max() < _SLOTS:
                break
            self.bits += 1
        self.width = int(at.max()) + 1 if len(at) else 1
        self.keys = np.full((1 << self.bits, self.width), -1, dtype=np.int64)
        self.where = np.full((1 << self.bits, self.width), -1, dtype=np.int64)
        self.keys[h[order], at] = vocab.keys[order]
        self.where[h[order], at] = order

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key among the sorted merges, -1 where it is none."""
        h = self._hash(keys)
        out = np.full(len(keys), -1, dtype=np.int64)
        for slot in range(self.width):
            hit = self.keys[h, slot] == keys
            out[hit] = self.where[h[hit], slot]
        return out


def count_words(words: list[bytes], vocab: bpe_vocab.Vocabulary, pairs: PairTable) -> np.ndarray:
    """Tokens of each word (not empty)."""
    counts = np.zeros(len(words), dtype=np.int64)
    if not words:
        return counts
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    symbols = vocab.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
    ids = np.arange(len(words))
    while len(symbols):
        starts = np.cumsum(size) - size
        inner = np.ones(len(symbols), dtype=bool)
        inner[starts + size - 1] = False
        at = np.flatnonzero(inner)
        found = pairs.find(symbols[at] * vocab.base + symbols[at + 1])
        rank = np.full(len(symbols), NONE)
        rank[at] = np.where(found >= 0, vocab.ranks[found], NONE)
        least = np.minimum.reduceat(rank, starts)
        done = least == NONE
        counts[ids[done]] = size[done]
        owner = np.repeat(np.arange(len(size)), size)
        hit = (rank == least[owner]) & (rank < NONE)
        # of places that overlap (a a a), every second one from the left merges
        places = np.flatnonzero(hit)
        if len(places):
            run = np.r_[True, np.diff(places) > 1]
            first = np.maximum.accumulate(np.where(run, np.arange(len(places)), 0))
            even = (np.arange(len(places)) - first) % 2 == 0
            chosen = places[even]
            back = np.full(len(symbols), -1, dtype=np.int64)
            back[at] = found
            symbols[chosen] = vocab.results[back[chosen]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[chosen + 1] = False
        else:
            keep = np.ones(len(symbols), dtype=bool)
        keep &= ~done[owner]
        symbols = symbols[keep]
        size = np.bincount(owner[keep], minlength=len(size))[~done]
        ids = ids[~done]
    return counts


class Counter:
    """Counts whole texts; equal pieces are merged once while they are in the memo."""

    def __init__(self, path: str) -> None:
        self.vocab = bpe_vocab.load(path)
        self.pairs = PairTable(self.vocab)
        self.of: dict[str, int] = {}

    def _learn(self, keys: set[str]) -> None:
        new = [k for k in keys if k not in self.of]
        if not new:
            return
        if len(self.of) + len(new) > MEMO:
            self.of = {}
            new = list(keys)
        split = [self.vocab.pattern.findall(k) for k in new]
        words = sorted({w for ws in split for w in ws})
        got = dict(zip(words, count_words([w.encode() for w in words], self.vocab, self.pairs).tolist(), strict=True))
        self.of |= {k: sum(map(got.__getitem__, ws)) for k, ws in zip(new, split, strict=True)}

    def count(self, texts: list[str | None]) -> list[int]:
        special = self.vocab.special
        plans: list[tuple[list[str], int]] = []
        keys: set[str] = set()
        for text in texts:
            pieces: list[str] = []
            fixed = 0
            for part, mark in bpe_vocab.segments(text, special) if text and any(s in text for s in special) else [(text or "", None)]:
                fixed += mark is not None
                if not part:
                    continue
                if bpe_vocab.regular(part):
                    first, rest = bpe_vocab.chunks(part)
                    fixed += len(first) - 1  # the line feeds
                    pieces += first
                    pieces += [" " + x for x in rest]
                else:
                    pieces += self.vocab.pattern.findall(part)
            plans.append((pieces, fixed))
            keys.update(pieces)
        self._learn(keys)
        return [fixed + sum(map(self.of.__getitem__, pieces)) for pieces, fixed in plans]


_COUNTERS: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs``, in the vocabulary file at ``path``.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null ids give a row each. Other columns are ignored.
    The special strings of the file are one token wherever they stand in a text.
    """
    arrow = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def counted(rows: pa.RecordBatch) -> dict[str, list]:
        if path not in _COUNTERS:
            _COUNTERS[path] = Counter(path)
        texts = rows.column("text").to_pylist()
        n = _COUNTERS[path].count(texts)
        return {"doc_id": rows.column("doc_id").to_pylist(), "n_bytes": [len(t.encode()) if t else 0 for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return map_texts(spread(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))), counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", arrow)
