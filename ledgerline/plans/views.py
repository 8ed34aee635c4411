"""Tables of a data folder, and narratives derived from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(txn_id, cid, period, amount, channel, raw): a transfer narrative for each order."""
    o = table(spark, sf_dir, "orders")
    cid = F.lpad(F.col("o_custkey").cast("string"), 6, "0")
    raw = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("TT tien nuoc HD "), (F.col("o_orderkey") % 997).cast("string"))).otherwise(
        F.concat(F.lit("TT tien nuoc KH "), cid, F.lit(" ky "), F.date_format("o_orderdate", "MM/yyyy"))
    )
    return o.select(
        F.col("o_orderkey").alias("txn_id"), cid.alias("cid"), F.date_format("o_orderdate", "yyyy-MM").alias("period"),
        F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("channel"), raw.alias("raw"),
    )


NV = """nv AS (
SELECT o_orderkey AS txn_id, lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS cid, strftime(o_orderdate, '%Y-%m') AS period,
       o_totalprice AS amount, o_orderpriority AS channel,
       CASE WHEN o_orderkey % 5 = 0 THEN concat('TT tien nuoc HD ', CAST(o_orderkey % 997 AS VARCHAR))
            ELSE concat('TT tien nuoc KH ', lpad(CAST(o_custkey AS VARCHAR), 6, '0'), ' ky ', strftime(o_orderdate, '%m/%Y')) END AS raw
FROM orders)"""

#: Folding in the checking SQL.
FOLD = "replace(lower(strip_accents({0})), 'đ', 'd')"


def stop_list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in sorted(set(words)))


#: First month of the held-out narratives.
HOLDOUT = "1997-01"
