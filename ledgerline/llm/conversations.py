"""Conversation structure repair by Dial's bucket-queue shortest paths.

A conversation is a path of rows through four states (nothing said yet, system, user, assistant). Keeping, relabelling or
deleting a row and inserting a turn are arcs with small integer costs, so distances to the goal are found by a queue of
buckets, one for each distance (Dial), and recorded at every node; the audit is read by walking from the start along tight
arcs (cost plus distance ahead equals distance here), always the one whose initial is ASCII-least. From one node, arcs of one
initial lead to one node, so the audit tells the repair.

Rows are dealt out by ranges of conversation and turn, and cut into segments of at most SEGMENT rows and SEGMENT_BYTES of
text (one longer row alone), so a conversation of any length is worked on by many tasks. A segment's rows count by their role
initial and fault only: one letter each. Segments give the least costs between their border states; these are folded from
the conversation's end to give the distance at each border; each segment then walks from each state at its start, and the
walks are strung together. What meets in one task for one conversation is a few dozen numbers and the audit of each segment,
less than a small multiple of the audit that is the conversation's result. The SHA-256 of a repaired conversation is a
sequential function of its text: one task streams the segments in order and holds one at a time.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import staged

SEGMENT_BITS = 10
#: Rows and bytes of text that a segment has at most.
SEGMENT, SEGMENT_BYTES = 1 << SEGMENT_BITS, 4 << 20
_FAR = 1 << 60
SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States: nothing yet, after s, after u, after a; the goal is the first or the last.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, GOAL = 4, (0, 3)
#: What is still to be inserted at the end of a conversation.
TAIL = ("", "ua", "a", "")
SOUND, CUT, BLANK, COPY = range(4)  # faults of a row
_INITIALS = "suao"  # o: any other


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after damage by crc32 of ``conv_id:turn`` modulo 20; nulls count as one space.

    0 drops the row, 1 empties its text, 2 removes its ends of sentences, 3 repeats it, 4 makes it the user's.
    """
    held = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.concat(held("conv_id"), F.lit(":"), held("turn"))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), held("role").alias("role"), held("text").alias("text"), (F.crc32(key.cast("binary")) % 20).alias("_way")).where("_way <> 0")
    way = F.col("_way")
    text = F.when(way == 1, F.lit("")).when(way == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(way == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(way == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("_copies"))
    return rows.select("conv_id", "turn", "role", "text", F.explode("_copies")).drop("col")


def _segmented(rows: DataFrame) -> DataFrame:
    """Adds seq, a number that grows with conversation, turn (nulls first), then the digest of role and text; seq >> SEGMENT_BITS
    is the segment. Rows that are all alike are dealt out by where they come from, which nothing can tell from the result."""
    key = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = rows.select("conv_id", "turn", "role", "text", key.alias("key"), F.monotonically_increasing_id().alias("_from"))
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.col("key"), F.col("_from")]
    rows = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).drop("_from")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = (TaskContext.get().partitionId() << 32) - 1
        last, n, size = object(), 0, 0
        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).to_pylist()
            seq = []
            for conv, more in zip(batch.column("conv_id").to_pylist(), sizes, strict=True):
                if conv != last or n == SEGMENT or (n and size + more > SEGMENT_BYTES):
                    segment, last, n, size = segment + 1, conv, 0, 0
                seq.append((segment << SEGMENT_BITS) + n)
                n, size = n + 1, size + more
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seq, pa.int64())], names=[*batch.schema.names, "seq"])

    return rows.mapInArrow(run, "conv_id long, turn long, role string, text string, key string, seq long")


def _segment(seq: str = "seq") -> Column:
    return F.shiftright(seq, SEGMENT_BITS)


def _place(seq: str = "seq") -> Column:
    return F.col(seq).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1).cast("long")).cast("int")


@lru_cache(1 << 10)
def arcs(letter: str) -> tuple[tuple[tuple[str, int, int], ...], ...]:
    """For each state the arcs (initial, cost, next state) by which a row is passed, least initials first."""
    initial, fault = _INITIALS[ord(letter) // 4 % 4], ord(letter) % 4
    dear = TRUNCATED if fault == CUT else 0
    out = []
    for q in range(STATES):
        found = [("D", DELETE, q)]
        if fault in (SOUND, CUT):
            if (q, initial) in STEP:
                found.append(("K", KEEP + dear, STEP[q, initial]))
            found += [("R", REROLE + dear, STEP[q, r]) for r in "ua" if (q, r) in STEP]
        out.append(tuple(found))
    return tuple(out)


#: Inserting a turn: for each state the next one, or none. A system turn is never inserted.
INSERTS = tuple(next((STEP[q, r] for r in "ua" if (q, r) in STEP), None) for q in range(STATES))


@lru_cache(1 << 10)
def _back(letter: str) -> tuple[tuple[tuple[int, int], ...], ...]:
    """For each state after a row the (state before, cost) of arcs that lead to it."""
    return tuple(tuple((q, cost) for q in range(STATES) for _, cost, to in arcs(letter)[q] if to == end) for end in range(STATES))


def distances(letters: str, ends: tuple[int, ...]) -> list[int]:
    """Dial's queue from the end: for each node (place * STATES + state) the least cost ahead, given that of the last place's states."""
    n = len(letters)
    ahead = [_FAR] * ((n + 1) * STATES)
    buckets: dict[int, list[int]] = defaultdict(list)
    for q, d in enumerate(ends):
        if d < _FAR:
            ahead[n * STATES + q] = d
            buckets[d].append(n * STATES + q)
    least = min(buckets, default=0)
    while buckets:
        while least not in buckets:  # gaps are at most the dearest arc wide, or lie between the ends' own distances
            least += 1
        for node in buckets.pop(least):
            if ahead[node] != least:
                continue
            at, q = divmod(node, STATES)
            reached = [(at * STATES + p, least + INSERT) for p in range(STATES) if INSERTS[p] == q]
            if at:
                reached += [((at - 1) * STATES + p, least + cost) for p, cost in _back(letters[at - 1])[q]]
            for before, d in reached:
                if d < ahead[before]:
                    ahead[before] = d
                    buckets[d].append(before)
    return ahead


def _seeds() -> Iterator[tuple[int, ...]]:
    return (tuple(0 if p == q else _FAR for p in range(STATES)) for q in range(STATES))


@lru_cache(1 << 14)
def costs(letters: str) -> tuple[int, ...]:
    """The least costs from each state before the rows to each one after them, row by row."""
    to = [distances(letters, s)[:STATES] for s in _seeds()]
    return tuple(to[end][q] for q in range(STATES) for end in range(STATES))


@lru_cache(1 << 14)
def walks(letters: str, ends: tuple[int, ...]) -> tuple[tuple[str, int] | None, ...]:
    """For each state before the rows the ASCII-least audit of a cheapest way over them, and the state after them."""
    ahead = distances(letters, ends)
    out = []
    for start in range(STATES):
        audit, at, q = [], 0, start
        if ahead[q] >= _FAR:
            out.append(None)
            continue
        while at < len(letters):
            here = ahead[at * STATES + q]
            insert = [("I", INSERT, INSERTS[q])] if INSERTS[q] is not None else []
            for initial, cost, to in sorted([*arcs(letters[at])[q], *insert]):
                place = at if initial == "I" else at + 1
                if cost + ahead[place * STATES + to] == here:
                    audit.append(initial)
                    at, q = place, to
                    break
        out.append(("".join(audit), q))
    return tuple(out)


def finish() -> tuple[int, ...]:
    """The least costs ahead at the end of a conversation."""
    return tuple(INSERT * len(t) for t in TAIL)


def acts(letters: str, audit: str, start: int) -> list[str]:
    """For each row the initials of turns inserted before it, then K (kept), U or A (relabelled) or D (deleted)."""
    out, q, said, at = [], start, "", 0
    for edit in audit:
        if edit == "I":
            q = INSERTS[q]
            said += _INITIALS[q - 1]
            continue
        if edit != "D":
            initial = _INITIALS[ord(letters[at]) // 4 % 4]
            q = STEP[q, initial] if edit == "K" else INSERTS[q]
        out.append(said + (edit if edit in "KD" else _INITIALS[q - 1].upper()))
        said, at = "", at + 1
    return out


_SEGMENTS = pa.schema([
    ("conv_id", pa.int64()), ("segment", pa.int64()), ("letters", pa.string()), ("costs", pa.list_(pa.int64())), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
])
_LEGAL = {"su", "ua", "au"}


def _read_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts a segment's letters together, with faults, and the least costs between its border states."""
    for batch in batches:
        out = defaultdict(list)
        for r in batch.to_pylist():
            codes, firsts = [c for _, c in sorted((x["at"], x["code"]) for x in r["codes"])], set(r["firsts"])
            codes = [c - c % 4 + COPY if c % 4 in (SOUND, CUT) and i not in firsts else c for i, c in enumerate(codes)]
            said = [_INITIALS[c // 4] for c in codes]
            letters = "".join(chr(64 + c) for c in codes)
            faults = [c % 4 for c in codes]
            row = {"conv_id": r["conv_id"], "segment": r["segment"], "letters": letters, "costs": costs(letters), "blank": faults.count(BLANK), "duplicate": faults.count(COPY), "truncated": faults.count(CUT)}
            row["illegal"] = sum(a + b not in _LEGAL for a, b in zip(said, said[1:], strict=False))
            for k, v in row.items():
                out[k].append(v)
        yield pa.RecordBatch.from_pydict(out, schema=_SEGMENTS) if out else pa.RecordBatch.from_pylist([], schema=_SEGMENTS)


_FOLDED = pa.schema([
    ("conv_id", pa.int64()), ("cost", pa.int64()), ("borders", pa.int64()), ("ends", pa.list_(pa.struct([("segment", pa.int64()), ("ahead", pa.list_(pa.int64()))]))),
])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a conversation's end back: the least cost ahead of each state at the end of each segment."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            ahead, ends = finish(), []
            parts = sorted(r["parts"], key=lambda p: p["segment"])
            for p in reversed(parts):
                ends.append({"segment": p["segment"], "ahead": ahead})
                ahead = tuple(min(p["costs"][q * STATES + e] + ahead[e] for e in range(STATES)) for q in range(STATES))
            borders = sum(a["ends"][1] + b["ends"][0] not in _LEGAL for a, b in zip(parts, parts[1:], strict=False))
            rows.append({"conv_id": r["conv_id"], "cost": ahead[0], "borders": borders, "ends": ends})
        yield pa.RecordBatch.from_pylist(rows, schema=_FOLDED)


_WALKED = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("letters", pa.string()), ("audits", pa.list_(pa.string())), ("exits", pa.list_(pa.int64()))])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audit of each segment from each state that it can begin in, and the state that it ends in."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            low = min(r["ahead"])
            found = walks(r["letters"], tuple(a - low for a in r["ahead"]))
            rows.append({"conv_id": r["conv_id"], "segment": r["segment"], "letters": r["letters"], "audits": [w[0] if w else None for w in found], "exits": [w[1] if w else None for w in found]})
        yield pa.RecordBatch.from_pylist(rows, schema=_WALKED)


_STRUNG = pa.schema([("conv_id", pa.int64()), ("audit", pa.string()), ("begins", pa.list_(pa.struct([("segment", pa.int64()), ("state", pa.int64()), ("tail", pa.string())])))])


def _string(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's audit, and the state in which each of its segments begins."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            q, audit, begins = 0, [], []
            for p in sorted(r["parts"], key=lambda p: p["segment"]):
                begins.append({"segment": p["segment"], "state": q, "tail": ""})
                audit.append(p["audits"][q])
                q = p["exits"][q]
            begins[-1]["tail"] = TAIL[q]
            rows.append({"conv_id": r["conv_id"], "audit": "".join(audit) + "I" * len(TAIL[q]), "begins": begins})
        yield pa.RecordBatch.from_pylist(rows, schema=_STRUNG)


_ACTED = pa.schema([("segment", pa.int64()), ("tail", pa.string()), ("acts", pa.list_(pa.string()))])


def _act(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [{"segment": r["segment"], "tail": r["tail"], "acts": acts(r["letters"], r["audits"][r["state"]], r["state"])} for r in batch.to_pylist()]
        yield pa.RecordBatch.from_pylist(rows, schema=_ACTED)


def _ddl(schema: pa.Schema) -> str:
    names = {"int64": "bigint", "string": "string"}

    def kind(t: pa.DataType) -> str:
        if pa.types.is_list(t):
            return f"array<{kind(t.value_type)}>"
        if pa.types.is_struct(t):
            return f"struct<{', '.join(f'{t.field(i).name}: {kind(t.field(i).type)}' for i in range(t.num_fields))}>"
        return names[str(t)]

    return ", ".join(f"{f.name} {kind(f.type)}" for f in schema)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, which come in order; the last line end of a conversation is none of it."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    last, digest, any_ = None, None, False
    for batch in batches:
        done = []
        for conv, lines in zip(batch.column("conv_id").to_pylist(), batch.column("lines"), strict=True):
            if digest is None or conv != last:
                if digest is not None:
                    done.append({"conv_id": last, "repaired_sha256": digest.hexdigest()})
                last, digest, any_ = conv, hashlib.sha256(), False
            data = lines.as_buffer()
            if data is not None and data.size:
                if any_:
                    digest.update(b"\n")
                digest.update(memoryview(data)[:-1])
                any_ = True
        yield pa.RecordBatch.from_pylist(done, schema=schema)
    if digest is not None:
        yield pa.RecordBatch.from_pylist([{"conv_id": last, "repaired_sha256": digest.hexdigest()}], schema=schema)


def _said(initials: Column) -> Column:
    """Lines of inserted turns."""
    return F.replace(F.replace(initials, F.lit("u"), F.lit("user:\n")), F.lit("a"), F.lit("assistant:\n"))


def examined(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows in order, as a table, with code (initial and first fault but for copies), and the table of their segments."""
    rows = staged(_segmented(rows), "turns")
    last = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    fault = F.when(last == "", F.lit(BLANK)).when(last.isin(".", "!", "?"), F.lit(SOUND)).otherwise(F.lit(CUT))
    initial = F.position(F.substring("role", 1, 1), F.lit("sua")) - 1
    initial = F.when((initial < 0) | (F.col("role") == ""), F.lit(len(_INITIALS) - 1)).otherwise(initial)
    coded = rows.select("conv_id", "seq", "key", (initial * 4 + fault).alias("code"))
    firsts = coded.groupBy("conv_id", "key").agg(F.min("seq").alias("seq")).select(F.lit(None).cast("long").alias("conv_id"), "seq", F.lit(None).cast("int").alias("code"))
    both = coded.select("conv_id", "seq", "code").unionByName(firsts).withColumn("at", _place())
    each = both.groupBy(_segment().alias("segment")).agg(
        F.max("conv_id").alias("conv_id"), F.collect_list(F.when(F.col("code").isNotNull(), F.struct("at", "code"))).alias("codes"), F.collect_list(F.when(F.col("code").isNull(), F.col("at"))).alias("firsts"),
    )
    return rows, staged(each.mapInArrow(_read_segments, _ddl(_SEGMENTS)), "segments")


def repaired(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows`` are (conv_id, turn, role, text); a conversation of ``conversations`` without any has zeros, no audit and the
    digest of nothing. Null ids are one conversation, null turns come first; rows of one turn come by the digest of role and
    text, rows that are all alike side by side. Null roles and texts count as one space. A gap that 64 bits cannot hold is
    null. Other columns are ignored.
    """
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    rows, segments = examined(rows)
    code = lambda letter: F.get(F.array(*map(F.lit, _INITIALS)), F.floor((F.ascii(letter) - 64) / 4).cast("int"))
    ends = F.array(code(F.substring("letters", 1, 1)), code(F.substring("letters", -1, 1)))
    folded = segments.groupBy("conv_id").agg(F.collect_list(F.struct("segment", "costs", ends.alias("ends"))).alias("parts")).mapInArrow(_fold, _ddl(_FOLDED))
    folded = staged(folded, "folded")
    ahead = folded.select(F.explode("ends").alias("e")).select("e.segment", "e.ahead")
    walked = staged(segments.select("conv_id", "segment", "letters").join(ahead, "segment").mapInArrow(_walk, _ddl(_WALKED)), "walked")
    strung = staged(walked.groupBy("conv_id").agg(F.collect_list(F.struct("segment", "audits", "exits")).alias("parts")).mapInArrow(_string, _ddl(_STRUNG)), "strung")
    begins = strung.select(F.explode("begins").alias("b")).select("b.*")
    acted = walked.select("segment", "letters", "audits").join(begins, "segment").mapInArrow(_act, _ddl(_ACTED))
    said = rows.select("conv_id", _segment().alias("segment"), _place().alias("at"), "role", "text").join(acted, "segment")
    act = F.get("acts", F.col("at"))
    edit, before = F.right(act, F.lit(1)), _said(F.left(act, F.length(act) - 1))
    own = F.when(edit == "D", F.lit("")).otherwise(F.concat(F.when(edit == "U", F.lit("user")).when(edit == "A", F.lit("assistant")).otherwise(F.col("role")), F.lit(":"), "text", F.lit("\n")))
    lines = said.groupBy("segment").agg(F.max("conv_id").alias("conv_id"), F.max("tail").alias("tail"), F.array_sort(F.collect_list(F.struct("at", F.concat(before, own).alias("line")))).alias("lines"))
    lines = lines.select("conv_id", "segment", F.concat(F.array_join(F.transform("lines", lambda x: x["line"]), ""), _said(F.col("tail"))).alias("lines"))
    hashed = lines.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "segment").mapInArrow(_hashes, "conv_id long, repaired_sha256 string")
    counts = segments.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")))
    wide = lambda c: c.cast("decimal(38,0)")
    turns = rows.groupBy("conv_id", "turn").agg(F.lit(1).alias("n")).groupBy("conv_id").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.count("turn").alias("n"))
    turns = turns.select("conv_id", F.when(F.col("n") == 0, F.lit(0).cast("long")).otherwise((wide(F.col("hi")) - wide(F.col("lo")) + 1 - F.col("n")).try_cast("long")).alias("gaps"))
    every = (rows if conversations is None else conversations).select(F.col("conv_id").cast("long")).distinct()
    for part in (turns, counts, folded.select("conv_id", "cost", "borders"), strung.select("conv_id", "audit"), hashed):
        every = every.unionByName(part, allowMissingColumns=True)
    whole = every.groupBy("conv_id").agg(*(F.max(c).alias(c) for c in every.columns if c != "conv_id"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return whole.select(
        "conv_id", F.when(F.col("audit").isNull(), F.lit(0).cast("long")).otherwise(F.col("gaps")).alias("gaps"), *(zero(c).alias(c) for c in ("blank", "duplicate", "truncated")), (zero("illegal") + zero("borders")).alias("illegal"),
        zero("cost").alias("cost"), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


#: DuckDB SQL for op12's rows: crc32 bit by bit, and a plain table of the cheapest (cost, audit) of each state, row by row.
REPAIRED_SQL = r"""
WITH keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hashed AS (
    SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(8 * length(k)), lambda i: CAST(CASE WHEN i % 8 = 0 THEN ascii(k[i // 8 + 1]) ELSE 0 END AS BIGINT))),
        lambda c, b: xor(xor(c, b) >> 1, CASE WHEN xor(c, b) % 2 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % 20 AS way FROM keyed),
harmed AS (
    SELECT conv_id, turn, CASE way WHEN 4 THEN 'user' ELSE role END AS role, CASE way WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(range(CASE way WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM hashed WHERE way <> 0),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text), copy) AS n,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again,
           CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS i, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS fin
    FROM harmed),
faulty AS (
    SELECT *, CASE WHEN fin = '' THEN 'b' WHEN again > 1 THEN 'd' WHEN fin NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, lag(i) OVER (PARTITION BY conv_id ORDER BY n) AS prev FROM placed),
facts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
           count(*) FILTER (prev IS NOT NULL AND prev || i NOT IN ('su', 'ua', 'au')) AS illegal, list({'i': i, 'f': fault, 'role': role, 'text': text} ORDER BY n) AS rows
    FROM faulty GROUP BY conv_id),
steps (q, r, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
inserts (q, n, t, edits, words) AS (VALUES (0, 0, 0, '', ''), (1, 0, 1, '', ''), (2, 0, 2, '', ''), (3, 0, 3, '', ''),
    (0, 1, 2, 'I', 'user:' || chr(10)), (0, 2, 3, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 1, 2, 'I', 'user:' || chr(10)), (1, 2, 3, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)),
    (2, 1, 3, 'I', 'assistant:' || chr(10)), (2, 2, 2, 'II', 'assistant:' || chr(10) || 'user:' || chr(10)), (3, 1, 2, 'I', 'user:' || chr(10)), (3, 2, 3, 'II', 'user:' || chr(10) || 'assistant:' || chr(10))),
ways (i, f, q, t, cost, edit, named) AS (
    SELECT i, f, q, q, 2, 'D', '' FROM (VALUES ('s'), ('u'), ('a'), ('o')) a(i), (VALUES ('b'), ('d'), ('t'), ('')) b(f), (VALUES (0), (1), (2), (3)) c(q)
    UNION ALL SELECT r, f, q, t, CASE f WHEN 't' THEN 5 ELSE 0 END, 'K', '' FROM steps, (VALUES ('t'), ('')) b(f)
    UNION ALL SELECT i, f, q, t, CASE f WHEN 't' THEN 6 ELSE 1 END, 'R', CASE r WHEN 'u' THEN 'user' ELSE 'assistant' END FROM steps, (VALUES ('t'), ('')) b(f), (VALUES ('s'), ('u'), ('a'), ('o')) a(i) WHERE r <> 's'),
moves AS (
    SELECT ways.i, ways.f, inserts.q, ways.t, 5 * inserts.n + ways.cost AS cost, inserts.edits || ways.edit AS edits, inserts.words, ways.edit, ways.named FROM inserts JOIN ways ON ways.q = inserts.t),
paths AS (
    WITH RECURSIVE walk AS (
        SELECT conv_id, 0 AS pos, 0 AS q, 0 AS cost, '' AS audit, '' AS said FROM facts
        UNION ALL
        SELECT conv_id, pos, q, best.cost, best.audit, best.said FROM (
            SELECT w.conv_id, w.pos + 1 AS pos, m.t AS q, min({'cost': w.cost + m.cost, 'audit': w.audit || m.edits,
                   'said': w.said || m.words || CASE m.edit WHEN 'D' THEN '' WHEN 'K' THEN x.role || ':' || x.text || chr(10) ELSE m.named || ':' || x.text || chr(10) END}) AS best
            FROM walk w JOIN (SELECT conv_id, generate_subscripts(rows, 1) AS pos, unnest(rows) AS x FROM facts) r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.pos = w.pos + 1
            JOIN moves m ON m.i = x.i AND m.f = x.f AND m.q = w.q GROUP BY w.conv_id, w.pos, m.t))
    SELECT * FROM walk),
ended AS (
    SELECT p.conv_id, min({'cost': p.cost + 5 * e.n, 'audit': p.audit || e.edits, 'said': p.said || e.words}) AS best
    FROM paths p JOIN facts f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND p.pos = len(f.rows) JOIN inserts e ON e.q = p.q WHERE e.t IN (0, 3) GROUP BY p.conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(left(best.said, length(best.said) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""
