"""Names at learned positions: where a channel's layouts write names, and what stands there."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import narrative as nr
from ledgerline.functions.text import name_key
from ledgerline.functions.values import wilson
from ledgerline.operators.staging import staged

#: A position is a name position from so many hits on, with so high a lower bound of their share.
LEAST_HITS, LEAST_SHARE = 20, 0.6
#: Words that end so large a share of a position's names stop later ones.
STOP_SHARE = 0.05


def _starts(raw: pd.Series) -> pd.Series:
    return raw.map(nr.word_starts)


def starts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, raw, context, start, words, after): a row for each word of a narrative.

    The number of partitions is set: reading words costs far more than the few bytes that a small file is split by.
    """
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    found = rows.select(*keys, "raw").repartition(n).select(*keys, "raw", F.explode(F.pandas_udf(_starts, nr.WORD_STARTS)("raw")).alias("s"))
    return found.select(*keys, "raw", "s.context", "s.start", "s.words", "s.after")


def learn_positions(rows: DataFrame) -> DataFrame:
    """(channel, context, hits, total, stops) of positions where confirmed names (channel, raw, name) stand often enough."""
    wanted = F.split(name_key(F.col("name")), " ")
    words = F.transform("words", lambda w: w["word"])
    n = F.size(wanted)
    found = starts(rows, ["channel", "name"]).withColumn("hit", (n >= 2) & (F.slice(words, 1, n) == wanted))
    end = F.when(F.col("hit"), F.coalesce(F.get(words, n), F.col("after")))
    stats = found.groupBy("channel", "context").agg(F.count_if("hit").alias("hits"), F.count("*").alias("total"))
    low, _ = wilson(F.col("hits"), F.col("total"))
    kept = stats.where((F.col("hits") >= LEAST_HITS) & (low >= LEAST_SHARE))
    ends = found.where("hit").groupBy("channel", "context", end.alias("end")).agg(F.count("*").alias("n")).join(kept, ["channel", "context"])
    often = F.col("end").rlike("^[a-z]+$") & (F.col("n") / F.col("hits") >= STOP_SHARE)
    stops = ends.groupBy("channel", "context").agg(F.array_sort(F.collect_set(F.when(often, F.col("end")))).alias("stops"))
    return kept.join(stops, ["channel", "context"])


def extract(rows: DataFrame, positions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name): names of two words or more at learned positions of (keys, channel, raw).

    The words of all rows look far smaller to the planner than they are. The positions are written first, so that it knows how
    few they are and sends those to the words, never the words to the driver.
    """
    known = staged(positions.select("channel", "context", "stops"), "positions")
    at = starts(rows, [*keys, "channel"]).join(known, ["channel", "context"])
    stop = F.transform("words", lambda w: F.array_contains("stops", w["word"]) | w["word"].isin(nr.NAME_STOPS))
    first = F.array_position(stop, True)
    size = F.when(first > 0, first - 1).otherwise(F.size("words")).cast("int")
    named = at.withColumn("size", size).where("size >= 2")
    end = F.get(F.col("words"), F.col("size") - 1)["end"]
    return named.select(*keys, F.substr("raw", F.col("start") + 1, end - F.col("start")).alias("name"))


def _bank_names(raw: pd.Series) -> pd.Series:
    return raw.map(nr.bank_name)


def with_positions(rows: DataFrame, positions: DataFrame, key: str) -> DataFrame:
    """(key, name, source): the name of a bank field, else one at a learned position."""
    fields = rows.select(key, "channel", "raw", F.pandas_udf(_bank_names, "string")("raw").alias("field"))
    learned = extract(rows, positions, [key]).groupBy(key).agg(F.min("name").alias("located"))
    both = fields.join(learned, key, "left").where("field IS NOT NULL OR located IS NOT NULL")
    return both.select(key, F.coalesce("field", "located").alias("name"), F.when(F.col("field").isNotNull(), "bank_field").otherwise("learned_position").alias("source"))
