"""Learning a batch of confirmed rows into the keyed tables of a store, in one commit.

The batch is parsed once; each table takes the keys that the batch touches, meets their old state and writes their new rows.
Counted tables grow as ``knowledge.learn`` says: counts with every row, confidence with strictly newer months only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import routing as rt
from ledgerline.functions import text as tx
from ledgerline.operators import classify, knowledge
from ledgerline.operators.staging import staged
from ledgerline.operators.store import Snapshot, Store

#: The tables of a knowledge store and their keys.
KEYS = {
    "receipts": ["receipt"], "customers": ["customer_id"], "aliases": ["customer_id", "alias"], "payers": ["customer_id", "payer"], "channels": ["channel"],
    "templates": ["template_key"], "members": ["template_key", "customer_id"], "patterns": ["pattern_key"], "slots": ["pattern_key", "slot"], "features": ["pattern_key", "slot", "value"],
    "postings": ["pattern_key", "token"], "memory": ["recurring", "channel", "customer_id"], "negatives": ["text_key", "customer_id"], "contexts": ["channel", "context"],
    "slot_rules": ["channel", "context"], "changes": ["change_id"], "versions": ["name"],
}
#: Version of what is derived from a row; rows of another version are derived again.
DERIVED = "rules-1"


def _counted(base: Snapshot, name: str, rows: DataFrame, facts: dict[str, Column] | None = None) -> DataFrame:
    """The touched rows of a counted table after ``rows`` (its keys, period); ``facts`` are those of its newest row (txn_id)."""
    keys = KEYS[name]
    state = base.table(name).join(rows.select(*keys).distinct(), keys, "left_semi") if name in base else None
    if not facts:
        return knowledge.learn(state, rows.select(*keys, "period"), keys)
    rows = rows.select(*keys, "period", F.struct("txn_id", *(v.alias(k) for k, v in facts.items())).alias("fact"))
    new = knowledge.learn(state, rows, keys, F.col("fact"))
    return new.select(*new.columns[:-1], *(F.col("facts")[k].alias(k) for k in facts))


def learned(base: Snapshot, batch: DataFrame) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(upserts, deletes) of a batch of confirmed rows (txn_id, cid, channel, raw, period, mode[, name]).

    A row counts once, whatever how often it comes: its receipt is the digest of text, customer, channel and txn_id. A
    confirmation lifts the negatives of its text and customer, and retires the slot rules of the places it has numbers at.
    """
    if "name" not in batch.columns:
        batch = batch.withColumn("name", F.lit(""))
    receipt = F.sha2(F.to_json(F.array(F.col("txn_id").cast("string"), F.col("raw"), F.col("cid"), F.col("channel"))), 256)
    fresh = knowledge.unseen(batch.withColumn("receipt", receipt), base.table("receipts") if "receipts" in base else None)
    rows = classify.parsed(fresh, "txn_id").withColumn("channel", tx.channel_key(F.col("channel")))
    identity = F.array_join(rt.pattern_identity(F.col("norm.numbers")), ",")
    pattern = F.sha2(F.concat_ws(rt.SEPARATOR, "cid", "channel", "template_key", identity), 256)
    # keys are written with the rows, so that no table makes them anew
    rows = staged(rows.withColumn("pattern_key", pattern).withColumnRenamed("cid", "customer_id"), "learned")
    numbers = rows.select("txn_id", "pattern_key", "period", "channel", F.explode(F.filter("norm.numbers", lambda n: n["numeric_type"] != "AMOUNT")).alias("n"))
    numbers = numbers.select("txn_id", "pattern_key", "period", "channel", "n.slot", "n.value", "n.numeric_type", "n.context")
    payers = rows.select("customer_id", "period", F.explode(F.array_distinct(F.concat(F.array("channel"), "norm.payer_accounts"))).alias("payer"))
    names = rows.where(tx.name_key(F.col("name")) != "").select("customer_id", tx.name_key(F.col("name")).alias("alias"), "period")
    new_patterns = classify.bucketed(rows.dropDuplicates(["pattern_key"]))
    # a pattern comes once, and so does a token in its list
    tokens = new_patterns.select("pattern_key", "customer_id", F.explode(classify.tokens(F.col("customer_id"), F.col("name"))).alias("t")).select("pattern_key", "customer_id", "t.token", "t.weight")
    upserts = {
        "receipts": rows.select("receipt", "customer_id", "period"),
        "customers": _counted(base, "customers", rows, {"name": F.col("name")}),
        "aliases": _counted(base, "aliases", names),
        "payers": _counted(base, "payers", payers),
        "channels": _counted(base, "channels", rows),
        "templates": _counted(base, "templates", rows, {"template": F.col("norm.template"), "structure": F.col("norm.structure"), "channel": F.col("channel")}),
        "members": _counted(base, "members", rows),
        "patterns": _counted(base, "patterns", rows, {"customer_id": F.col("customer_id"), "channel": F.col("channel"), "template_key": F.col("template_key"), "raw": F.col("raw"), "derived": F.lit(DERIVED)}),
        "slots": _counted(base, "slots", numbers),
        "features": _decayed(base, numbers, _counted(base, "features", numbers, {k: F.col(k) for k in ("numeric_type", "channel", "context")})),
        "postings": tokens,
        "memory": _counted(base, "memory", rows),
        "contexts": _counted(base, "contexts", numbers.where("context IS NOT NULL")),
        "changes": rows.groupBy().agg(F.count("*").alias("rows"), F.max("txn_id").alias("last")).select(F.lit(base.version + 1).alias("change_id"), F.lit("learn").alias("action"), "rows", "last"),
        "versions": rows.sparkSession.range(1).select(F.lit("derived").alias("name"), F.lit(DERIVED).alias("value")),
    }
    deletes = {}
    if "negatives" in base:
        deletes["negatives"] = base.table("negatives").join(rows.select("text_key", "customer_id").distinct(), KEYS["negatives"], "left_semi")
    if "slot_rules" in base:
        deletes["slot_rules"] = base.table("slot_rules").join(numbers.select("channel", "context").distinct(), KEYS["slot_rules"], "left_semi")
    return upserts, deletes


def _decayed(base: Snapshot, numbers: DataFrame, touched: DataFrame) -> DataFrame:
    """The touched features, and those of the batch's patterns that a newer month does not show: these lose a share of their
    confidence for each such month."""
    touched = touched.withColumn("missing_count", F.lit(0).cast("long"))
    if "features" not in base:
        return touched
    months = numbers.where("period <> 'unknown'").select("pattern_key", "period").distinct()
    others = base.table("features").join(numbers.select(*KEYS["features"]).distinct(), KEYS["features"], "left_anti")
    missed = others.join(months, "pattern_key").where("period > last_period").groupBy(*others.columns).agg(F.count("*").alias("_n"), F.max("period").alias("_last"))
    less = F.round(F.col("confidence") * F.pow(F.lit(0.7), "_n"), 9)
    return touched.unionByName(missed.withColumn("confidence", less).withColumn("missing_count", F.col("missing_count") + F.col("_n")).withColumn("last_period", F.col("_last")).drop("_n", "_last"))


def learn(store: Store, batch: DataFrame, marks: dict[str, int] | None = None) -> Snapshot:
    """Learns a batch into all tables at once; whoever reads an earlier snapshot sees nothing of it."""
    base = store.snapshot()
    upserts, deletes = learned(base, batch)
    return store.commit(base, upserts, deletes, marks)


def slot_rules(base: Snapshot, least: int = 1) -> DataFrame:
    """(channel, context, customers, rows): how many customers stand behind the numbers of a place, from the patterns' features."""
    features = base.table("features").select("pattern_key", "channel", "context", "seen").where("context IS NOT NULL")
    owned = features.join(base.table("patterns").select("pattern_key", "customer_id"), "pattern_key")
    return owned.groupBy("channel", "context").agg(F.count_distinct("customer_id").alias("customers"), F.sum("seen").alias("rows")).where(F.col("rows") >= least)


def stale(base: Snapshot, edited: DataFrame) -> DataFrame:
    """(pattern_key, ...) of the patterns whose derived rows do not belong to what the pattern is now.

    ``edited`` are the patterns as they should be (pattern_key, customer_id, channel, raw, name); a pattern is stale if the
    digest of what its postings are made from, or the version of how, has changed.
    """
    digest = lambda: F.sha2(F.to_json(F.array("customer_id", "channel", "raw", F.lit(DERIVED))), 256)
    now = edited.withColumn("_digest", digest())
    held = base.table("patterns").withColumn("_held", F.sha2(F.to_json(F.array("customer_id", "channel", "raw", "derived")), 256)).select("pattern_key", "_held")
    return now.join(held, "pattern_key", "left").where(~F.col("_digest").eqNullSafe(F.col("_held"))).drop("_digest", "_held")


def reindex(store: Store, edited: DataFrame) -> tuple[Snapshot, int]:
    """Rebuilds the postings (all token families) of stale patterns only, in one commit; the snapshot and how many rows it wrote.

    Patterns that ``edited`` does not have any more lose their postings, slots and features (``stale`` says what edited is).
    """
    base = store.snapshot()
    if "name" not in edited.columns:
        edited = edited.withColumn("name", F.lit(""))
    changed = staged(stale(base, edited), "stale")
    gone = base.table("patterns").join(edited.select("pattern_key"), "pattern_key", "left_anti").select("pattern_key")
    tokens = staged(postings_of(changed), "tokens")
    held = base.table("postings")
    dead = held.join(changed.select("pattern_key").unionByName(gone), "pattern_key", "left_semi").join(tokens, KEYS["postings"], "left_anti")
    patterns = base.table("patterns").drop("customer_id", "channel", "raw", "derived").join(changed.select("pattern_key", "customer_id", "channel", "raw"), "pattern_key").withColumn("derived", F.lit(DERIVED))
    deletes = {"postings": dead, "patterns": gone} | {t: base.table(t).join(gone, "pattern_key", "left_semi") for t in ("slots", "features")}
    done = store.commit(base, {"postings": tokens, "patterns": patterns.select(*base.table("patterns").columns)}, deletes)
    return done, tokens.count()


def postings_of(patterns: DataFrame) -> DataFrame:
    """(pattern_key, customer_id, token, weight) of patterns (pattern_key, customer_id, channel, raw, name): all token families."""
    rows = classify.bucketed(classify.parsed(patterns, "pattern_key"))
    found = rows.select("pattern_key", "customer_id", F.explode(classify.tokens(F.col("customer_id"), F.col("name"))).alias("t"))
    return found.select("pattern_key", "customer_id", "t.token", "t.weight").dropDuplicates(["pattern_key", "token"])


#: Who goes with whom: (child, its columns, parent, the parent's columns).
REFERENCES = [
    ("aliases", ["customer_id"], "customers", ["customer_id"]), ("payers", ["customer_id"], "customers", ["customer_id"]), ("receipts", ["customer_id"], "customers", ["customer_id"]),
    ("negatives", ["customer_id"], "customers", ["customer_id"]), ("members", ["customer_id"], "customers", ["customer_id"]), ("memory", ["customer_id"], "customers", ["customer_id"]),
    ("patterns", ["customer_id"], "customers", ["customer_id"]), ("slots", ["pattern_key"], "patterns", ["pattern_key"]), ("features", ["pattern_key"], "patterns", ["pattern_key"]), ("postings", ["pattern_key"], "patterns", ["pattern_key"]),
]
#: Who goes when the last one that needs it is gone: (shared, its columns, the tables that need it, their columns).
SHARED = [("templates", ["template_key"], "patterns", ["template_key"])]


def cascade(tables: dict[str, DataFrame], roots: dict[str, DataFrame], references=REFERENCES, shared=SHARED) -> dict[str, DataFrame]:
    """The rows of each table that go when the rows ``roots`` go, to a fixed point.

    Rows go with a parent that goes; a shared row goes when some row that needs it goes and none is left. Rounds follow the
    graph until no table loses more, so a chain of any length is walked; each round is staged. Rows that repeat go together.
    """
    gone = {name: staged(rows.select(*tables[name].columns).distinct(), f"gone-{name}") for name, rows in roots.items()}
    counts = {name: rows.count() for name, rows in gone.items()}
    while True:
        found: dict[str, DataFrame] = {}
        for child, own, parent, theirs in references:
            if child in tables and parent in gone:
                keys = gone[parent].select(*(F.col(t).alias(o) for o, t in zip(own, theirs, strict=True))).distinct()
                found[child] = _with(found.get(child), tables[child].join(keys, own, "left_semi"))
        for name, own, by, theirs in shared:
            if name in tables and by in gone and by in tables:
                renamed = lambda df, own=own, theirs=theirs: df.select(*(F.col(t).alias(o) for o, t in zip(own, theirs, strict=True))).distinct()
                left = renamed(_among(tables[by], gone[by], "left_anti"))
                found[name] = _with(found.get(name), tables[name].join(renamed(gone[by]), own, "left_semi").join(left, own, "left_anti"))
        more = False
        for name, rows in found.items():
            rows = staged(_with(gone.get(name), rows).select(*tables[name].columns).distinct(), f"gone-{name}")
            n = rows.count()
            if n > counts.get(name, 0):
                gone[name], counts[name], more = rows, n, True
        if not more:
            return {name: _among(tables[name], rows, "left_semi") for name, rows in gone.items()}


def _among(rows: DataFrame, some: DataFrame, how: str) -> DataFrame:
    """The rows that are (left_semi) or are not (left_anti) alike one of ``some`` in all columns; nulls are alike."""
    other = some.toDF(*(f"_{c}" for c in some.columns))
    alike = F.lit(True)
    for c in some.columns:
        alike = alike & rows[c].eqNullSafe(other[f"_{c}"])
    return rows.join(other, alike, how)


def _with(a: DataFrame | None, b: DataFrame) -> DataFrame:
    return b if a is None else a.unionByName(b)


def forget(store: Store, customers: DataFrame) -> Snapshot:
    """Deletes customers (customer_id) with all that is theirs, in one commit; layouts that others use stay."""
    base = store.snapshot()
    tables = {name: base.table(name) for name in KEYS if name in base}
    roots = {"customers": tables["customers"].join(customers.select("customer_id").distinct(), "customer_id", "left_semi")}
    return store.commit(base, {}, cascade(tables, roots))

