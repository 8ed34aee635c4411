"""Knowledge as keyed state: learning batches, slots, memory, feedback and invalidation.

State tables are DataFrames that a batch turns into the next version; a batch is aggregated per key before it meets the state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.values import confidence_after
from ledgerline.operators.relations import drop_members, segmented_runs

#: Customers of one transfer from which on it is a provider's settlement.
SETTLEMENT = 10


def unseen(batch: DataFrame, receipts: DataFrame | None, key: str = "receipt") -> DataFrame:
    """The rows of a batch whose receipt is new, each receipt once."""
    once = batch.dropDuplicates([key])
    return once if receipts is None else drop_members(once, receipts, key)


def learn(state: DataFrame | None, batch: DataFrame, keys: list[str], facts: Column | None = None) -> DataFrame:
    """(keys, seen, advances, last_period, confidence) after a batch of (keys, period).

    Counts always grow; confidence only with a strictly newer known period. A first sighting starts at 0.2; periods that
    are not after the stored one count as late data and change nothing but the count. Of ``facts`` (a struct of the batch's
    columns) the greatest one of each key is added as ``facts``, null for keys that only the state has.

    Batch and state meet in one shuffle: a key has a row for each of its periods, and one of the state.
    """
    kept = [] if facts is None else [F.max(facts).alias("facts")]
    rows = batch.groupBy(*keys, "period").agg(F.count("*").alias("n"), *kept)
    none = {"o_seen": "long", "o_advances": "long", "o_last": "string"}
    rows = rows.select("*", *(F.lit(None).cast(t).alias(c) for c, t in none.items()))
    before = F.lit(None).cast("string")
    if state is not None:
        old = state.select(*keys, F.lit(0).cast("long").alias("n"), F.col("seen").alias("o_seen"), F.col("advances").alias("o_advances"), F.col("last_period").alias("o_last"))
        rows = rows.unionByName(old, allowMissingColumns=True)
        before = F.max("o_last").over(Window.partitionBy(*keys))
    rows = rows.withColumn("before", before)
    later = F.coalesce("before", F.lit("")).isin("", "unknown") | (F.col("period") > F.col("before"))
    newer = F.when((F.col("period") != "unknown") & later, F.col("period"))
    rows = rows.groupBy(*keys).agg(
        F.coalesce(F.max("o_seen"), F.lit(0)).alias("o_seen"), F.max("o_advances").alias("o_advances"), F.max("before").alias("o_last"),
        F.sum("n").alias("n"), F.count(newer).alias("fresh"), F.max(newer).alias("newest"), *([] if facts is None else [F.max("facts").alias("facts")]),
    )
    first = F.col("o_advances").isNull()
    advances = F.when(first, F.greatest(F.col("fresh") - 1, F.lit(0))).otherwise(F.col("o_advances") + F.col("fresh"))
    last = F.coalesce("newest", "o_last", F.lit("unknown"))
    out = [*keys, (F.col("o_seen") + F.col("n")).alias("seen"), advances.alias("advances"), last.alias("last_period"), F.round(confidence_after(advances), 9).alias("confidence")]
    return rows.select(*out, *([] if facts is None else ["facts"]))


def memberships(batch: DataFrame, template: str, customer: str) -> DataFrame:
    """(template, customer, seen) of settlement rosters."""
    return batch.groupBy(template, customer).agg(F.count("*").alias("seen"))


def settlement_units(rows: DataFrame, key: str, order: list[str], unit: str, customer: str) -> DataFrame:
    """(key, run, customers, rows, settlement): runs of consecutive rows of one transfer (``unit``), with their number of customers
    and whether they are a settlement. A key or transfer may hold any share of the rows (``relations.segmented_runs``)."""
    numbered = segmented_runs(rows.select(*dict.fromkeys([key, *order, unit, customer])), key, order, unit)
    # customers first: what is counted of a run is dealt out by customer
    each = numbered.groupBy(key, "run", customer).agg(F.count("*").alias("n"))
    grouped = each.groupBy(key, "run").agg(F.count(customer).alias("customers"), F.sum("n").alias("rows"))
    return grouped.select("*", (F.col("customers") >= SETTLEMENT).alias("settlement"))


def settlements(templates: DataFrame) -> DataFrame:
    """Templates whose single transfers cover many customers and that a proxy or a settled row stands behind."""
    return templates.where((F.col("most_customers") >= SETTLEMENT) & ((F.col("mode") == "proxy") | (F.col("settled_rows") > 0)))


def remember(rows: DataFrame, signature: Column) -> DataFrame:
    """(signature, channel, owners, owner, latest): recurring memory; the owner only where it is alone."""
    keyed = rows.withColumn("signature", signature)
    memory = keyed.groupBy("signature", "channel").agg(F.count_distinct("cid").alias("owners"), F.min("cid").alias("one"), F.max(F.struct("period", "txn_id")).alias("last"))
    return memory.select("signature", "channel", "owners", F.when(F.col("owners") == 1, F.col("one")).alias("owner"), F.col("last.txn_id").alias("latest"))


def review(state: DataFrame, feedback: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(state, negatives) after feedback (keys, accepted): accepted rows count as seen, rejected ones become hard negatives
    that a later acceptance of the same key lifts."""
    marks = feedback.groupBy(*keys).agg(F.count_if("accepted").alias("yes"), F.count_if(~F.col("accepted")).alias("no"))
    merged = state.join(marks, keys, "left").withColumn("seen", F.col("seen") + F.coalesce("yes", F.lit(0))).drop("yes", "no")
    negatives = marks.where("no > 0 AND yes = 0").select(*keys, F.col("no").alias("count"))
    return merged, negatives


def hard_negatives(reviews: DataFrame) -> DataFrame:
    """(text_key, customer_id, count) after reviews (entry_key, at, text_key, proposed, chosen, mentioned, allocation).

    A proposed customer that was not chosen is a negative of the text, once for each entry and choice. It is none if the text
    names, or an earlier allocation pays, several customers and both are among them: they are co-recipients. An acceptance
    lifts the negatives of its text and customer that came before it. A rejection has no chosen customer.
    """

    def together(ids: str) -> Column:
        return (F.size(F.array_distinct(ids)) > 1) & F.array_contains(ids, F.col("proposed")) & F.array_contains(ids, F.col("chosen"))

    co_recipient = F.coalesce(together("mentioned"), F.lit(False)) | F.coalesce(together("allocation"), F.lit(False))
    wrong = reviews.where(F.col("proposed").isNotNull() & ~F.col("proposed").eqNullSafe(F.col("chosen")) & ~co_recipient)
    once = wrong.groupBy("entry_key", "text_key", F.col("proposed").alias("customer_id"), "chosen").agg(F.min("at").alias("at"))
    lifts = reviews.where("chosen IS NOT NULL").groupBy("text_key", F.col("chosen").alias("customer_id")).agg(F.max("at").alias("lifted"))
    left = once.join(lifts, ["text_key", "customer_id"], "left").where("lifted IS NULL OR at > lifted")
    return left.groupBy("text_key", "customer_id").agg(F.count("*").alias("count"))


def undo(changes: DataFrame, current: DataFrame, asked: DataFrame) -> DataFrame:
    """(change_id, entity, outcome, value) of each asked change_id of the log.

    changes is the log (change_id, entity, before, after, reversible, reverted), current the values now (entity, value). A
    change is undone if it is reversible and not reverted yet (else: fixed), the last one of its entity (else: newer), and
    what it left is still there (else: changed); value is what stood before it, null if nothing did.
    """
    last = changes.groupBy("entity").agg(F.max("change_id").alias("last"))
    now = current.select("entity", F.col("value").alias("now"))
    rows = changes.join(asked.select("change_id").distinct(), "change_id", "left_semi").join(last, "entity").join(now, "entity", "left")
    outcome = (
        F.when(~F.col("reversible") | F.col("reverted"), "fixed").when(F.col("last") > F.col("change_id"), "newer")
        .when(~F.col("now").eqNullSafe(F.col("after")), "changed").otherwise("undone")
    )
    return rows.select("change_id", "entity", outcome.alias("outcome"), F.col("before").alias("value"))


def after_undo(current: DataFrame, undone: DataFrame) -> DataFrame:
    """(entity, value): the current values with undone changes taken back; an entity without a value before is gone."""
    back = undone.where("outcome = 'undone'").select("entity", F.col("value").alias("before"), F.lit(True).alias("back"))
    both = current.join(back, "entity", "full")
    return both.select("entity", F.when(F.col("back"), F.col("before")).otherwise(F.col("value")).alias("value")).where("value IS NOT NULL")


def invalidate(stats: DataFrame, positions: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics without the positions that a correction touched."""
    return stats.join(positions.select(*keys).distinct(), keys, "left_anti")


def sync_tokens(postings: DataFrame, aliases: DataFrame) -> DataFrame:
    """Postings with the name tokens of renamed customers replaced: (token, customer_id, weight)."""
    names = aliases.select("customer_id", F.explode(F.split("alias", " ")).alias("w")).select(F.concat(F.lit("name:"), "w").alias("token"), "customer_id", F.lit(2.0).alias("weight")).distinct()
    changed = aliases.select("customer_id").distinct()
    others = postings.where(~F.col("token").startswith("name:"))
    kept = drop_members(postings.where(F.col("token").startswith("name:")), changed, "customer_id")
    return others.unionByName(kept).unionByName(names)


def compare_and_set(current: DataFrame, change: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, revision, value, applied): a change applies where it was made against the current revision."""
    new = change.select(*keys, F.col("revision").alias("expected"), F.col("value").alias("proposed"))
    both = current.join(new, keys, "left")
    fits = F.coalesce(F.col("expected") == F.col("revision"), F.lit(False))
    return both.select(*keys, (F.col("revision") + fits.cast("int")).alias("revision"), F.when(fits, F.col("proposed")).otherwise(F.col("value")).alias("value"), fits.alias("applied"))
