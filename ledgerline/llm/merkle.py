"""Document fingerprints: Merkle trees of pieces, paragraphs and sections.

Leaves are pieces of a few bytes, cut where a hash of the last four bytes is greatest among its neighbours, so the same words
are cut alike wherever they stand. Pieces make up paragraphs (lines, or stretches of long ones), paragraphs make up sections
(ended by an empty line), sections make up parts, and parts greater ones up to the root. Within these bounds a group ends
where the digest of a child is greatest among its neighbours, and after MOST children. The digest of a node is taken over those
of its children. Equal roots mean equal texts; ``differing`` walks two trees down their unequal branches to the spans where they part.

A fingerprint is the root, the number of a level, and the nodes of that level in order: the finest one with at most LIMIT
nodes, so its length is bounded, whatever the text's. Two of them are compared at the coarser one's level; the finer one's
nodes are grouped up to it, which needs no text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import map_texts, slices, spread

#: Nodes in a fingerprint.
LIMIT = 256
#: A piece is cut after the byte with the greatest hash among so many on both sides, and after LONGEST bytes.
REACH, LONGEST = 6, 24  # _byte_peaks is for this reach
#: The same for groups of nodes.
GROUP_REACH, MOST = 2, 8
#: Ranges of ids that a task gets, on average.
_RANGES = 4
_LEAST = -(1 << 63)
_PAD = 8  # zero bytes between texts
_BLOCK = 1 << 20  # bytes or values that are looked at together
_LINE, _SECTION = 1, 2  # marks of nodes that end a line, and of empty lines

_rng = np.random.default_rng(20)
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _rng.integers(1, 1 << 63, LIMIT, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    x = sums + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _digests(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Digests of runs of values (bytes or digests of children), each of at most LIMIT, a block of runs at a time."""
    out = np.empty(len(starts), dtype=np.uint64)
    step = max(1, _BLOCK // LONGEST)
    for k in range(0, len(starts), step):
        s, n = starts[k : k + step], sizes[k : k + step]
        begin = np.cumsum(n) - n
        base, n32 = int(s[0]), n.astype(np.int32)
        at = np.arange(n.sum(), dtype=np.int32)
        place = at - np.repeat(begin.astype(np.int32), n32)
        held = values[base : int(s[-1] + n[-1])]
        if len(held) != len(at):  # pads between texts are left out
            held = held[at + np.repeat((s - base - begin).astype(np.int32), n32)]
        terms = (_BYTES[held] if held.dtype == np.uint8 else held) * _PLACES[place]
        out[k : k + step] = _mixed(np.add.reduceat(terms, begin), n)
    return out


def _peaks(h: np.ndarray, reach: int, owner: np.ndarray) -> np.ndarray:
    """Where a value is above the ``reach`` ones before it and not below those after it (of the same owner)."""
    top = h > 0
    for s in range(1, min(reach, len(h) - 1) + 1):
        after, before = h[s:] > h[:-s], h[:-s] >= h[s:]
        other = owner[s:] != owner[:-s]
        top[s:] &= after | other
        top[:-s] &= before | other
    return top


def _byte_peaks(h: np.ndarray) -> np.ndarray:
    """The same for hashes of bytes with REACH of 6; texts lie more than that apart, with zeros between them."""
    two = h.copy()
    np.maximum(h[1:], h[:-1], out=two[1:])
    six = two.copy()  # the greatest of so many up to each place
    np.maximum(two[2:], two[:-2], out=six[2:])
    np.maximum(six[4:], two[:-4], out=six[4:])
    top = h > 0
    top[1:] &= h[1:] > six[:-1]
    top[:-6] &= h[:-6] >= six[6:]
    return top


def _cut(starts: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts runs longer than ``most``; also gives the run that each part comes from."""
    parts = (ends - starts - 1) // most + 1
    of = np.repeat(np.arange(len(starts)), parts)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = starts[of] + nth * most
    return begin, np.minimum(begin + most, ends[of]), of


class Nodes:
    """The nodes of a level, of many texts: digests (32 bits, the last two are marks), leaves below, text and place of each."""

    def __init__(self, level: int, digest: np.ndarray, leaves: np.ndarray, owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        self.level, self.digest, self.leaves, self.owner, self.start, self.end = level, digest, leaves, owner, start, end

    def of(self, kept: np.ndarray) -> Nodes:
        return Nodes(self.level, self.digest[kept], self.leaves[kept], self.owner[kept], self.start[kept], self.end[kept])

    def up(self) -> Nodes:
        """The next level; start and end of its nodes number their children here."""
        mark = self.digest & np.uint64(3)
        ends = _peaks(self.digest, GROUP_REACH, self.owner)
        ends[0] = False  # the first node alone makes no group, so from sections on each level has fewer nodes
        ends[1:] &= self.owner[1:] == self.owner[:-1]
        if self.level < _SECTION:
            ends |= mark > self.level
        ends[:-1] |= self.owner[1:] != self.owner[:-1]
        ends[-1:] = True
        end = np.flatnonzero(ends) + 1
        start, end, _ = _cut(np.concatenate([[0], end[:-1]]), end, MOST)
        digest = _digests(self.digest, start, end - start) >> np.uint64(34) << np.uint64(2)
        if self.level == 0:
            digest |= mark[end - 1]
        return Nodes(self.level + 1, digest, np.add.reduceat(self.leaves, start), self.owner[start], start, end)


def _pieces(texts: list[bytes]) -> Nodes:
    """The leaves of texts; start and end are places in the texts joined with _PAD bytes before and between them."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    begin = np.cumsum(size + _PAD) - size
    flat = np.frombuffer(bytes(_PAD) + bytes(_PAD).join(texts) + bytes(_PAD), dtype=np.uint8)
    inside = np.repeat(np.tile([False, True], len(texts)), np.stack([np.full(len(texts), _PAD), size], axis=1).ravel())
    cut = np.zeros(len(flat) + 1, dtype=bool)
    cut[(begin + size)[size > 0]] = True
    for k in range(0, len(flat), _BLOCK):
        a, b = max(0, k - 2 * _PAD), min(len(flat), k + _BLOCK + 2 * _PAD)
        part = flat[a:b].astype(np.uint32)
        h = part.copy()
        for s in (1, 2, 3):
            h[s:] |= part[:-s] << np.uint32(8 * s)
        h = (h * np.uint32(0x9E3779B1)) ^ np.uint32(0x5BD1E995)
        within = np.zeros(b - a, dtype=bool)
        within[: max(0, min(len(inside), b) - a)] = inside[a:b]
        h[~within] = 0
        here = (_byte_peaks(h) | (flat[a:b] == 10)) & within
        stop = min(len(flat), k + _BLOCK)
        cut[k + 1 : stop + 1] |= here[k - a : stop - a]
    ends = np.flatnonzero(cut)
    owner = np.searchsorted(begin, ends, side="left") - 1
    first = np.concatenate([[True], owner[1:] != owner[:-1]])[: len(ends)]
    starts = np.where(first, begin[owner], np.concatenate([[0], ends[:-1]])[: len(ends)])
    starts, ends, of = _cut(starts, ends, LONGEST)
    owner = owner[of]
    line = flat[ends - 1] == 10
    empty = line & (ends - starts == 1) & ((starts == begin[owner]) | (flat[starts - 1] == 10))
    digest = _digests(flat, starts, ends - starts) >> np.uint64(34) << np.uint64(2)
    digest |= np.where(empty, _SECTION, np.where(line, _LINE, 0)).astype(np.uint64)
    return Nodes(0, digest, np.ones(len(starts), dtype=np.int64), owner, starts, ends)


def fingerprints_of(texts: list[str | None]) -> list[str]:
    """Fingerprints of texts; a null text has that of an empty one."""
    held = [(t or "").encode() for t in texts]
    out = [""] * len(held)
    nodes = _pieces(held)
    done: list[Nodes] = []
    while len(nodes.digest):
        many = np.bincount(nodes.owner, minlength=len(held))[nodes.owner] > LIMIT
        done.append(nodes.of(~many))
        nodes = nodes.of(many).up() if many.any() else nodes.of(many)
    for level in done:
        if not len(level.digest):
            continue
        start = np.flatnonzero(np.concatenate([[True], level.owner[1:] != level.owner[:-1]]))
        size = np.diff(np.concatenate([start, [len(level.owner)]]))
        roots = _digests(level.digest, start, size)
        listed = level.digest if level.level == 0 else np.stack([level.digest, level.leaves.astype(np.uint64)], axis=1)
        listed = listed.astype(">u4")
        for root, a, n in zip(roots.tolist(), start.tolist(), size.tolist(), strict=True):
            at = level.owner[a]
            out[at] = f"{root:016x}{xxhash.xxh3_64_intdigest(held[at], 7):016x}:{level.level:x}:{listed[a : a + n].tobytes().hex()}"
    none = f"{0:016x}{xxhash.xxh3_64_intdigest(b'', 7):016x}:0:"
    return [x or none for x in out]


def fingerprint(text: str | None) -> str:
    return fingerprints_of([text])[0]


def _read(printed: str) -> Nodes:
    _, level, listed = printed.split(":")
    values = np.frombuffer(bytes.fromhex(listed), dtype=">u4").astype(np.uint64)
    digest, leaves = (values[::2], values[1::2].astype(np.int64)) if int(level, 16) else (values, np.ones(len(values), dtype=np.int64))
    none = np.zeros(len(digest), dtype=np.int64)
    return Nodes(int(level, 16), digest, leaves, none, none, none)


def likeness(a: str, b: str) -> float:
    """1.0 for equal roots, else the Dice coefficient of the nodes at the coarser one's level, weighted by their leaves."""
    if a.partition(":")[0] == b.partition(":")[0]:
        return 1.0
    x, y = _read(a), _read(b)
    if not len(x.digest) or not len(y.digest):
        return 0.0
    while x.level < y.level:
        x = x.up()
    while y.level < x.level:
        y = y.up()
    _, at = np.unique(np.concatenate([x.digest, y.digest]), return_inverse=True)
    n, most = len(x.digest), int(at.max()) + 1
    both = np.minimum(np.bincount(at[:n], x.leaves, most), np.bincount(at[n:], y.leaves, most)).sum()
    return float(2 * both / (x.leaves.sum() + y.leaves.sum()))


def _tree(text: bytes) -> list[Nodes]:
    levels = [_pieces([text])]
    while len(levels[-1].digest) > 1:
        levels.append(levels[-1].up())
    return levels


def _beyond(mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """Which values of ``mine`` are not in ``theirs``, or come more often."""
    _, at = np.unique(np.concatenate([mine, theirs]), return_inverse=True)
    order = np.argsort(at[: len(mine)], kind="stable")
    size = np.bincount(at[: len(mine)])
    nth = np.empty(len(mine), dtype=np.int64)
    nth[order] = np.arange(len(mine)) - np.repeat(np.cumsum(size) - size, size)
    return nth >= np.bincount(at[len(mine) :], minlength=int(at.max(initial=0)) + 1)[at[: len(mine)]]


def differing(a: str | None, b: str | None) -> list[tuple[int, int]]:
    """Byte spans (start, end) of ``a``, widened to whole characters, whose leaves are not in ``b`` (or more often than there), found by
    going down unequal branches only. Digests have 30 bits, so a changed leaf is missed once in 10^9 leaves of ``b``.
    """
    text, other = (a or "").encode(), (b or "").encode()
    mine, theirs = _tree(text), _tree(other)
    suspects = np.arange(len(mine[-1].digest))
    for k in range(len(mine) - 1, -1, -1):
        level = mine[k]
        if k < len(theirs):
            suspects = suspects[_beyond(level.digest, theirs[k].digest)[suspects]]
        if k:
            suspects = np.concatenate([np.arange(level.start[i], level.end[i]) for i in suspects] or [suspects])
    spans: list[tuple[int, int]] = []
    inner = lambda i: 0 < i < len(text) and text[i] & 0xC0 == 0x80
    for i in suspects.tolist():
        start, end = int(mine[0].start[i]) - _PAD, int(mine[0].end[i]) - _PAD
        while inner(start):
            start -= 1
        while inner(end):
            end += 1
        if spans and spans[-1][1] >= start:
            spans[-1] = (spans[-1][0], end)
        else:
            spans.append((start, end))
    return spans


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row of ``docs``; null texts as empty ones, repeats a row each."""
    arrow = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def run(rows: pa.RecordBatch) -> dict[str, list]:
        return {"doc_id": rows.column("doc_id").to_pylist(), "fingerprint": fingerprints_of(rows.column("text").to_pylist())}

    return map_texts(spread(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))), run, "doc_id long, fingerprint string", arrow)


class Ranges:
    """Cuts of rows by id, and within an id that spans several ranges by the digest of the text."""

    def __init__(self, cuts: list[int]) -> None:
        keys, times = np.unique(np.array(cuts, dtype=np.int64), return_counts=True)
        # digests are even over 64 bits, so their cuts are known beforehand
        ties = [[_LEAST + (1 << 64) * j // n for j in range(n)] for n in times.tolist()]
        self.keys = np.repeat(keys, times)
        self.ties = np.array([t for part in ties for t in part], dtype=np.int64)
        self.split = keys[times > 1]

    def of(self, key: np.ndarray, tie: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, key, side="right")
        for k in self.split[np.isin(self.split, key)]:
            rows = key == k
            low, high = np.searchsorted(self.keys, k, side="left"), np.searchsorted(self.keys, k, side="right")
            at[rows] = low + np.searchsorted(self.ties[low:high], tie[rows], side="right")
        return at.astype(np.int32)


def _ranges(rows: DataFrame, n: int) -> tuple[Ranges, dict[int, tuple[int, int]]]:
    """Cuts of the rows into about ``n`` ranges, and the exact least (key, tie) of each that has rows (bounded by ``n``)."""
    cuts = rows.agg(F.percentile_approx("key", [(i + 1) / n for i in range(n - 1)] or [0.5], 10 * max(n, 1000))).first()[0]
    ranges = Ranges(cuts or [0])
    arrow = pa.schema([("range", pa.int32()), ("key", pa.int64()), ("tie", pa.int64())])

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, tie = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "tie"))
            at = ranges.of(key, tie)
            order = np.lexsort((tie, key, at))
            first = order[np.flatnonzero(np.diff(at[order], prepend=-1))]
            yield pa.RecordBatch.from_arrays([pa.array(at[first]), pa.array(key[first]), pa.array(tie[first])], schema=arrow)

    found = rows.select("key", "tie").mapInArrow(least, "range int, key long, tie long").groupBy("range").agg(F.min(F.struct("key", "tie")).alias("least")).collect()
    return ranges, {r["range"]: tuple(r["least"]) for r in found}


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (range, last, key, tie, doc_id, text) dealt out by ranges of ids and sorted: after the rows of a range stands the
    first row of the next range (``last``), after the last range that of the first. One shuffle of the texts, no join.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = spread(docs.select(F.col("doc_id").cast("long"), text.alias("text"))).withColumns({"key": F.coalesce("doc_id", F.lit(_LEAST)), "tie": F.xxhash64("text")})
    spark = docs.sparkSession
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 10_000)
    ranges, first = _ranges(rows, _RANGES * n)
    order = sorted(first)
    before = {first[r]: order[k - 1] for k, r in enumerate(order)}
    firsts = np.array(sorted(k for k, _ in before), dtype=np.int64)
    arrow = pa.schema([("range", pa.int32()), ("last", pa.bool_()), ("key", pa.int64()), ("tie", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, tie = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "tie"))
            own = [batch.column(c) for c in ("key", "tie", "doc_id", "text")]
            at = pa.array(ranges.of(key, tie))
            yield pa.RecordBatch.from_arrays([at, pa.array(np.zeros(len(at), dtype=bool)), *own], schema=arrow)
            twice = [(i, before[pair]) for i in np.flatnonzero(np.isin(key, firsts)).tolist() if (pair := (int(key[i]), int(tie[i]))) in before]
            if twice:
                rows_ = pa.array([i for i, _ in twice])
                yield pa.RecordBatch.from_arrays([pa.array([r for _, r in twice], pa.int32()), pa.array([True] * len(twice)), *(pc.take(c, rows_) for c in own)], schema=arrow)

    dealt = rows.select("key", "tie", "doc_id", "text").mapInArrow(deal, "range int, last boolean, key long, tie long, doc_id long, text string")
    return dealt.repartition(n, "range").sortWithinPartitions("range", "last", "key", "tie", "text")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text has its last quarter of code points (rounded down) replaced by as many (or all) of the first of the next
    document in order of doc_id; the first document follows the last. Rows without an id come first, rows with equal ids are
    ordered by the XXH64 of their texts. Null texts count as empty. A single row is its own next document; an empty table gives no rows.
    """
    arrow = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row whose next one is to come
        for batch in batches:
            for part in slices(batch, "text"):
                lasts, ids, texts = (part.column(c).to_pylist() for c in ("last", "doc_id", "text"))
                pairs: list[tuple] = []  # rows with their next ones
                for last, doc_id, text, own in zip(lasts, ids, texts, fingerprints_of(texts), strict=True):
                    if last and held is None:
                        continue  # further rows like the next range's first row
                    if held is not None:
                        pairs.append((*held, text, own))
                    held = None if last else (doc_id, text, own)
                edited = [text[: len(text) - len(text) // 4] + after[: len(text) // 4] for _, text, _, after, _ in pairs]
                changed = fingerprints_of(edited)
                yield pa.RecordBatch.from_arrays([
                    pa.array([p[0] for p in pairs], pa.int64()), pa.array([len(p[1]) for p in pairs], pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                    pa.array([p[2] for p in pairs], pa.string()), pa.array(changed, pa.string()),
                    pa.array([likeness(p[2], c) for p, c in zip(pairs, changed, strict=True)], pa.float64()), pa.array([likeness(p[2], p[4]) for p in pairs], pa.float64()),
                ], schema=arrow)

    return with_next(docs).select("last", "doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
