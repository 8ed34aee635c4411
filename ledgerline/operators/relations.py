"""Relational operators of the linkage engine that are not tied to one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.staging import staged


def with_history(base: DataFrame, history: DataFrame, key: str, fill: dict[str, object]) -> DataFrame:
    """Every base row with its history; counts without history are filled."""
    return base.join(history, key, "left").fillna(fill)


def keep_members(rows: DataFrame, members: DataFrame, key: str) -> DataFrame:
    return rows.join(members.select(key).distinct(), key, "left_semi")


def drop_members(rows: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Rows whose key is no member; null keys stay, null members exclude nothing."""
    return rows.join(members.select(key).distinct(), key, "left_anti")


def mode_of(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """(key, name, n): the most frequent value of each key, ties to the least value."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("b"))
    return best.select(key, F.col("b.v").alias(name), (-F.col("b.m")).alias("n"))


def runs(rows: DataFrame, key: str, order: list[str], changed: Column, name: str = "run") -> DataFrame:
    """Numbers the runs of each key: a new one begins where ``changed`` holds (gaps and islands)."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_new", F.when(F.coalesce(changed, F.lit(True)), 1).otherwise(0)).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def segmented_runs(rows: DataFrame, key: str, order: list[str], unit: str, name: str = "run") -> DataFrame:
    """Numbers the runs of each key from 1: a new one begins where ``unit`` differs from the row before.

    For keys that may hold a large share of the rows: rows are dealt out by ranges of key and order, so a key can span many
    tasks. Each range numbers its own rows; what it needs of the ranges before it (their last row, and how many runs of the
    key they began) comes from a table with a few rows for each range. Nulls are a key and a unit of their own.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    by = [F.asc_nulls_first(key), *map(F.col, order)]
    dealt = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    dealt = staged(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)), "ranges")
    within = Window.partitionBy("_range").orderBy("_at")
    here = F.struct(F.col(key).alias("k"), F.col(unit).alias("u"))
    last = dealt.groupBy("_range").agg(F.max_by(here, "_at").alias("_last"))
    before = last.select("_range", F.lag("_last").over(Window.orderBy("_range")).alias("_carried"))
    marked = dealt.withColumn("_before", F.lag(here).over(within)).join(before, "_range")
    marked = marked.withColumn("_before", F.coalesce("_before", "_carried"))
    same_key = F.col("_before").isNotNull() & F.col("_before.k").eqNullSafe(F.col(key))
    marked = marked.withColumn("_new", F.when(same_key & F.col("_before.u").eqNullSafe(F.col(unit)), 0).otherwise(1))
    begun = marked.groupBy("_range", F.col(key).alias("_key")).agg(F.sum("_new").alias("_begun"))
    of_key = Window.partitionBy("_key").orderBy("_range")
    carried = begun.withColumn("_sofar", F.coalesce(F.sum("_begun").over(of_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("_sofar > 0")
    numbered = marked.withColumn(name, F.sum("_new").over(Window.partitionBy("_range", key).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)))
    numbered = numbered.join(carried.select(F.col("_range").alias("_r"), "_key", "_sofar"), (F.col("_range") == F.col("_r")) & F.col(key).eqNullSafe(F.col("_key")), "left")
    return numbered.select(*rows.columns, (F.col(name) + F.coalesce("_sofar", F.lit(0))).alias(name))


def interval_union(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, start, end): the intervals of each key with overlapping and touching ones merged."""
    w = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(reach >= F.col(start), 0).otherwise(1))
    numbered = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def overlap_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], width: int) -> DataFrame:
    """Pairs of half-open integer spans that overlap. Both sides are dealt out to bins of ``width``; a pair is kept in the bin
    where the later of its starts lies, so each is found once."""
    a, b = left_span
    c, d = right_span
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width)))
    x, y = left.where(F.col(b) > F.col(a)).withColumn("_bin", bins(a, b)), right.where(F.col(d) > F.col(c)).withColumn("_bin", bins(c, d))
    meets = (F.col(a) < F.col(d)) & (F.col(b) > F.col(c)) & (F.col("_bin") == F.floor(F.greatest(a, c) / width))
    return x.join(y, "_bin").where(meets).drop("_bin")


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def merge_state(state: DataFrame, delta: DataFrame, keys: list[str], how: dict[str, Column]) -> DataFrame:
    """Keyed merge: a full outer join of old state (``o_`` columns) and aggregated delta (``d_`` columns)."""
    old = state.select(*keys, *(F.col(c).alias(f"o_{c}") for c in state.columns if c not in keys))
    new = delta.select(*keys, *(F.col(c).alias(f"d_{c}") for c in delta.columns if c not in keys))
    return old.join(new, keys, "full").select(*keys, *(value.alias(name) for name, value in how.items()))
