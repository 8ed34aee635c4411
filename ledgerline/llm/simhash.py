"""SimHash near-duplicates by anchor points of a covering code.

A fingerprint has 64 bits. Two fingerprints at 3 or fewer differing bits have at most one differing bit in one of their
32-bit halves, so each half is searched for distance 1. The anchors of a half are the words of a perfect Hamming code on 31
of its bits (covering radius 1), with the last bit as it stands. A fingerprint has its home at the nearest anchor and is
replicated to every anchor within covering radius plus threshold (2): 16 of them at most, and one for the last bit turned.
Homes and replicas that meet at an anchor are compared in full. Nothing is missed: the home of one of two linked
fingerprints is an anchor to which the other one is replicated.

Equal fingerprints are one node from the start, so the size of a group of copies plays no part in the search. Anchors at
which many distinct fingerprints meet are searched by a second key: of the other half's four bytes at least one is equal, as
at most three bits differ. Components come from alternating large-star and small-star rounds over the links, each round written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import map_texts, remove, spread, staged, written

SEED = 42
WIDTH = 3
DISTANCE = 3
#: An anchor that is home to more distinct fingerprints is searched by the other half's bytes as well.
CROWD = 256
#: Shingles whose bits are counted at once.
_AT_ONCE = 1 << 15


def fingerprint(text: str | None) -> int:
    """The signed 64-bit SimHash of the 3-word shingles of a text; 0 without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.cumsum(size + 1) - size - 1
    wide = min(WIDTH, len(words))
    begins = starts[: len(words) - wide + 1].tolist()
    ends = (starts + size)[wide - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(begins), _AT_ONCE):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(begins[k : k + _AT_ONCE], ends[k : k + _AT_ONCE], strict=True)], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = np.packbits(counts * 2 > len(begins), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, key: bool = False) -> DataFrame:
    """(doc_id, fp), and key of id and text if asked for, of every row; null texts and texts without words have 0."""
    names = ["doc_id", "key"] if key else ["doc_id"]
    arrow = pa.schema([(n, pa.int64()) for n in (*names, "fp")])

    def run(rows: pa.RecordBatch) -> dict[str, list]:
        return {n: rows.column(n).to_pylist() for n in names} | {"fp": [fingerprint(t) for t in rows.column("text").to_pylist()]}

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("key", _row_key(F.col("doc_id"), F.col("text")))
    return map_texts(spread(rows.select(*names, "text")), run, ", ".join(f"{n} long" for n in (*names, "fp")), arrow)


def _syndrome(code: Column) -> Column:
    """Of a 31-bit word: the position (1 to 31) whose bit parts it from its nearest code word, 0 if it is one."""
    masks = [sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1) for j in range(5)]
    parts = [F.shiftleft(F.bit_count(code.bitwiseAND(F.lit(m).cast("long"))).bitwiseAND(1), j) for j, m in enumerate(masks)]
    total = parts[0]
    for x in parts[1:]:
        total = total.bitwiseOR(x)
    return total.cast("int")


def _bit(position: Column) -> Column:
    """The word with the bit at a position from 1 set."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), position - 1)


def _halves(fps: DataFrame) -> DataFrame:
    """A row for each half of each fingerprint: its code word part, its last bit, its syndrome and its home."""
    low = F.lit((1 << 32) - 1).cast("long")
    both = F.array(F.struct(F.lit(0).alias("half"), F.shiftrightunsigned("fp", 32).alias("w")), F.struct(F.lit(1).alias("half"), F.col("fp").bitwiseAND(low).alias("w")))
    rows = fps.select("fp", F.explode(both).alias("h")).select("fp", "h.half", "h.w")
    rows = rows.withColumn("code", F.col("w").bitwiseAND(F.lit((1 << 31) - 1).cast("long"))).withColumn("last", F.shiftrightunsigned("w", 31))
    rows = rows.withColumn("s", _syndrome(F.col("code")))
    return rows.withColumn("home", F.when(F.col("s") == 0, F.col("code")).otherwise(F.col("code").bitwiseXOR(_bit(F.col("s")))))


def _anchor(code: Column, last: Column, half: Column) -> Column:
    """One long for an anchor: half, last bit, code word."""
    return code.bitwiseOR(F.shiftleft(last.cast("long"), 31)).bitwiseOR(F.shiftleft(half.cast("long"), 32))


def links(fps: DataFrame) -> DataFrame:
    """(u, v) with u < v: the pairs of distinct fingerprints at 3 or fewer differing bits, each once."""
    halves = _halves(fps)
    homes = halves.select(_anchor(F.col("home"), F.col("last"), F.col("half")).alias("anchor"), F.col("half"), F.col("fp").alias("u"))
    # i and i ^ s: two turned bits lead to a code word as the one at s does
    couples = F.transform(
        F.filter(F.sequence(F.lit(1), F.lit(31)), lambda i: i < i.bitwiseXOR(F.col("s"))),
        lambda i: F.col("code").bitwiseXOR(_bit(i)).bitwiseXOR(_bit(i.bitwiseXOR(F.col("s")))),
    )
    near = F.transform(F.concat(F.array("home"), couples), lambda c: _anchor(c, F.col("last"), F.col("half")))
    turned = F.array(_anchor(F.col("home"), F.lit(1) - F.col("last"), F.col("half")))
    replicas = halves.select(F.explode(F.concat(near, turned)).alias("anchor"), F.col("half"), F.col("fp").alias("v"))
    crowded = staged(homes.groupBy("anchor").count().where(F.col("count") > CROWD).select("anchor"), "crowded")
    if crowded.isEmpty():
        return _near(homes.join(replicas.drop("half"), "anchor"))
    # home rows alone decide which way a pair is met, so each pair is met one way
    sparse = _near(homes.join(crowded, "anchor", "left_anti").join(replicas.drop("half"), "anchor"))
    homes = _by_byte(homes.join(crowded, "anchor", "left_semi"), "u")
    replicas = _by_byte(replicas.join(crowded, "anchor", "left_semi"), "v").drop("half")
    met = homes.join(replicas, ["anchor", "byte", "value"])
    other = _other_half(F.col("u").bitwiseXOR(F.col("v")))
    first = F.array_position(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: _byte(other, i)), F.lit(0)) - 1
    return sparse.unionByName(_near(met.where(F.col("byte") == first)))


def _near(met: DataFrame) -> DataFrame:
    """The pairs u < v of those that meet at an anchor that are linked, each once."""
    differ = F.col("u").bitwiseXOR(F.col("v"))
    # a pair belongs to the upper half if it is near there, else to the lower one
    once = (F.col("half") == 0) == (F.bit_count(F.shiftrightunsigned(differ, 32)) <= 1)
    return met.where((F.col("u") < F.col("v")) & (F.bit_count(differ) <= DISTANCE) & once).select("u", "v")


def _other_half(fp: Column) -> Column:
    """The half that the anchor was not made of."""
    return F.when(F.col("half") == 0, fp.bitwiseAND(F.lit((1 << 32) - 1).cast("long"))).otherwise(F.shiftrightunsigned(fp, 32))


def _byte(half: Column, i: Column) -> Column:
    return F.call_function("shiftright", half, i * 8).bitwiseAND(F.lit(255).cast("long")).cast("int")


def _by_byte(rows: DataFrame, fp: str) -> DataFrame:
    """A row for each byte of the other half."""
    rows = rows.withColumn("byte", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return rows.withColumn("value", _byte(_other_half(F.col(fp)), F.col("byte")))


def _state(edges: DataFrame) -> tuple:
    """Number and digest of an edge table."""
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of a link, root its component's least node.

    Large-star: each node ties its greater neighbours to its least neighbour. Small-star: each node ties its lesser
    neighbours to the least of them. At the fixed point all ties lead to roots. Minima combine before the shuffle.
    """
    spark = edges.sparkSession
    now, path = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "ties")
    before = _state(now)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large, large_path = written(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        superseded = (path, large_path)
        now, path = written(small.distinct(), "small")
        remove(spark, *superseded)
        after = _state(now)
        if after == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _row_key(doc_id: Column, text: Column) -> Column:
    """One long for an id and a text, null or not."""
    return F.xxhash64(doc_id.isNull(), doc_id, text.isNull(), text)


def _rooted(nodes: DataFrame) -> DataFrame:
    """Adds root, the least fingerprint of its component, to nodes with distinct fingerprints."""
    tied = components(links(nodes.select("fp")))
    return nodes.join(tied.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``.

    component_id is the smallest doc_id reachable over links of 3 or fewer differing bits. Null, empty and blank texts have
    fingerprint zero and are linked like any other. Rows without an id keep a row and never name a component that has ids.
    Repeated rows give a row each. An empty table gives no rows; other columns are ignored.
    """
    prints = staged(fingerprints(docs), "prints")
    nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    rooted = _rooted(nodes)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each component one, with the smallest doc_id (of repeats, the least text hash).

    A component without ids keeps a row as well.
    """
    prints = staged(fingerprints(docs, key=True), "prints")
    nodes = staged(prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("first")), "nodes")
    stays = _rooted(nodes).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("_id"), F.col("first.key").alias("_key"))
    row = "_" * (1 + max(map(len, docs.columns)))  # no column of docs
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    keyed = docs.withColumn(row, _row_key(doc_id, text))
    kept = keyed.join(stays.hint("shuffle_hash"), keyed["doc_id"].cast("long").eqNullSafe(stays["_id"]) & (keyed[row] == stays["_key"]), "left_semi")
    return kept.dropDuplicates(["doc_id", row]).drop(row)
