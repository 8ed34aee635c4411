"""The decision cascade: guards over joined evidence, first hit wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scores of accepted rules; thresholds of acceptance and review.
SCORES = {"memory": 0.97, "id": 0.98, "contract": 0.96}
AUTO, REVIEW, MARGIN = 0.9, 0.6, 0.08


def threshold(score, auto: float = AUTO, review: float = REVIEW):
    return F.when(score >= auto, "auto_accept").when(score >= review, "review").otherwise("manual_check")


def cap_competing(score, runner_up, auto: float = AUTO, review: float = REVIEW, margin: float = MARGIN):
    """A close runner-up keeps a score below acceptance."""
    close = (runner_up >= review) & (score - runner_up < margin)
    return F.when(close, F.least(score, F.lit(max(review, auto - 0.01)))).otherwise(score)


def _owners(known: DataFrame, key, name: str) -> DataFrame:
    """Who owns a key in the whole knowledge: how many, and the one if alone."""
    rows = known.select(key.alias(name), "cid").where(F.col(name) != "").distinct()
    return rows.groupBy(name).agg(F.count("*").alias(f"{name}_owners"), F.min("cid").alias(f"{name}_owner"))


def cascade(queries: DataFrame, known: DataFrame) -> DataFrame:
    """Adds rule, decision, customer_id and score to narratives (txn_id, channel, raw, amount).

    In order: not a credit; memory of the very text (shared, own, or against a written id); a written id (unknown, shared,
    own); a contract (unknown, shared, own); nothing.
    """
    kh, hd = F.regexp_extract("raw", r"KH (\d{6})", 1), F.regexp_extract("raw", r"HD (\d+)", 1)
    memory = known.select("raw", "channel", "cid").distinct().groupBy("raw", "channel").agg(F.count("*").alias("memory_owners"), F.min("cid").alias("memory_owner"))
    rows = queries.withColumn("kh", kh).withColumn("hd", hd).join(memory, ["raw", "channel"], "left")
    rows = rows.join(_owners(known, kh, "kh"), "kh", "left").join(_owners(known, hd, "hd"), "hd", "left")
    m, written, contract = F.col("memory_owners"), F.col("kh") != "", F.col("hd") != ""
    rule = (
        F.when(F.col("amount") <= 1000, "not_credit")
        .when((m > 1) & ~written, "memory_shared")
        .when((m == 1) & (~written | (F.col("memory_owner") == F.col("kh"))), "memory")
        .when(m == 1, "memory_conflict")
        .when(written & F.col("kh_owners").isNull(), "id_unknown")
        .when(F.col("kh_owners") > 1, "id_shared")
        .when(F.col("kh_owners") == 1, "id")
        .when(contract & F.col("hd_owners").isNull(), "contract_unknown")
        .when(F.col("hd_owners") > 1, "contract_shared")
        .when(F.col("hd_owners") == 1, "contract")
        .otherwise("nothing")
    )
    rows = rows.withColumn("rule", rule)
    r = F.col("rule")
    score = F.coalesce(*(F.when(r == k, F.lit(v)) for k, v in SCORES.items()), F.lit(0.0))
    owner = F.when(r == "memory", F.col("memory_owner")).when(r == "id", F.col("kh_owner")).when(r == "contract", F.col("hd_owner"))
    return rows.withColumn("score", score).withColumn("customer_id", owner).withColumn("decision", F.when(r == "not_credit", "reject").otherwise(threshold(F.col("score"))))
