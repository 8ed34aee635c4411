"""Postings: tokens of narratives, who owns them, and retrieval channels over them.

Ownership is always counted over the whole knowledge, before any cut of candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of the token families of a pattern.
TOKEN_WEIGHTS = {"id": 8.0, "exact": 10.0, "template": 2.0, "detail": 12.0, "w": 1.0, "name": 2.0, "payer": 3.0, "contract": 12.0, "code": 4.0, "bound-id": 10.0, "slot-id": 14.0, "v": 0.3, "n": 0.8}


def narrative_tokens(raw: Column) -> Column:
    """(token, weight) of a narrative: its labelled customer or contract number, its exact text and its layout."""
    customer = F.regexp_extract(raw, r"KH (\d{6})", 1)
    contract = F.regexp_extract(raw, r"HD (\d+)", 1)
    weight = lambda family: F.lit(TOKEN_WEIGHTS[family])
    return F.array_compact(
        F.array(
            F.when(customer != "", F.struct(F.concat(F.lit("id:"), customer).alias("token"), weight("id").alias("weight"))),
            F.when(contract != "", F.struct(F.concat(F.lit("contract:"), contract).alias("token"), weight("contract").alias("weight"))),
            F.struct(F.concat(F.lit("exact:"), raw).alias("token"), weight("exact").alias("weight")),
        )
    )


def postings(patterns: DataFrame, raw: str, owner: str, key: str) -> DataFrame:
    """(token, weight, pattern_id, customer_id), one row for each token of a pattern."""
    rows = patterns.select(F.col(key).alias("pattern_id"), F.col(owner).alias("customer_id"), F.explode(narrative_tokens(F.col(raw))).alias("t"))
    return rows.select("t.token", "t.weight", "pattern_id", "customer_id").dropDuplicates(["token", "pattern_id"])


def token_owners(found: DataFrame) -> DataFrame:
    """(token, owners, owner): how many customers own a token, and the one owner if it is alone."""
    return held_owners(found.select("token", "customer_id").distinct())


def held_owners(each: DataFrame) -> DataFrame:
    """``token_owners`` of pairs (token, customer_id) that come once each."""
    one = each.groupBy("token").agg(F.count("*").alias("owners"), F.min("customer_id").alias("owner"))
    return one.select("token", "owners", F.when(F.col("owners") == 1, F.col("owner")).alias("owner"))


def decide_by_owner(queries: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """(key, token, owners, customer_id, decision) of each query's token: unique, shared or unknown."""
    rows = queries.join(owners, "token", "left").withColumn("owners", F.coalesce("owners", F.lit(0)).cast("long"))
    decision = F.when(F.col("owners") == 1, "unique").when(F.col("owners") > 1, "shared").otherwise("unknown")
    return rows.select(key, "token", "owners", F.col("owner").alias("customer_id"), decision.alias("decision"))


def token_sets(rows: DataFrame, key: str) -> DataFrame:
    """(key, set_key, tokens) of (key, token): what each row asks, as a sorted set. Rows that ask the same share a set."""
    sets = rows.groupBy(key).agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    return sets.withColumn("set_key", F.md5(F.array_join("tokens", "\x1f")))


def distinct_sets(sets: DataFrame) -> DataFrame:
    """(set_key, token) of the distinct sets."""
    return sets.groupBy("set_key").agg(F.first("tokens").alias("tokens")).select("set_key", F.explode("tokens").alias("token"))


def posting_channel(queries: DataFrame, found: DataFrame, key: str, per_customer: int, limit: int) -> DataFrame:
    """(key, pattern_id, customer_id, score, rank): summed weights, at most ``per_customer`` patterns of a customer.

    Weights are grouped before any limit, so repeated tokens cannot use up the budget. Hits are found once for each distinct
    set of tokens: a token that many queries share is joined with its postings once.
    """
    sets = token_sets(queries, key)
    scored = distinct_sets(sets).join(found, "token").groupBy("set_key", "pattern_id", "customer_id").agg(F.sum("weight").alias("score"))
    order = [F.desc("score"), F.desc("pattern_id")]
    best = top_k(scored, ["set_key", "customer_id"], order, per_customer, "own").drop("own")
    hits = top_k_split(best, ["set_key"], order, limit, F.col("pattern_id"))
    return sets.select(key, "set_key").join(hits, "set_key").select(key, "pattern_id", "customer_id", "score", "rank")


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int | Column, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key in a total order, with their rank from 1; ``k`` may be a column of the rows."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def top_k_split(rows: DataFrame, keys: list[str], order: list[Column], k: int | Column, split: Column, rank: str = "rank", buckets: int = 32) -> DataFrame:
    """``top_k`` for keys that may hold a large share of the rows: cut within hash buckets of ``split`` first."""
    cut = top_k(rows.withColumn("_bucket", F.pmod(F.xxhash64(split), F.lit(buckets))), [*keys, "_bucket"], order, k, rank)
    return top_k(cut.drop("_bucket", rank), keys, order, k, rank)


def common_owners(sets: DataFrame, held: DataFrame) -> DataFrame:
    """(set_key, customers): how many customers own every token of each distinct set (set_key, tokens sorted by owners).

    ``tokens`` are structs (owners, token), ``held`` the distinct (token, customer_id). Only the owners of a set's rarest token
    are looked at; a set of one token has as many as that has owners.
    """
    each = sets.select("set_key", "tokens").dropDuplicates(["set_key"])
    several = each.where(F.size("tokens") > 1)
    first = several.select("set_key", "tokens", F.col("tokens")[0]["token"].alias("token")).join(held, "token")
    rest = first.select("set_key", "customer_id", F.size("tokens").alias("n"), F.explode(F.slice("tokens", 2, F.size("tokens") - 1)).alias("t")).select("set_key", "customer_id", "n", "t.token")
    full = rest.join(held, ["token", "customer_id"]).groupBy("set_key", "customer_id", "n").agg(F.count("*").alias("met")).where("met = n - 1")
    found = full.groupBy("set_key").agg(F.count("*").alias("found"))
    customers = F.when(F.size("tokens") == 1, F.col("tokens")[0]["owners"]).otherwise(F.coalesce("found", F.lit(0)))
    return each.join(found, "set_key", "left").select("set_key", customers.cast("long").alias("customers"))


def intersect_owners(tokens: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, customers): how many customers own every token of a query (conflict where none does)."""
    counted = tokens.select(key, "token").distinct().join(token_owners(found), "token", "left").withColumn("owners", F.coalesce("owners", F.lit(0)))
    sets = counted.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("owners", "token"))).alias("tokens"))
    sets = sets.withColumn("set_key", F.md5(F.array_join(F.transform("tokens", lambda t: t["token"]), "\x1f")))
    return sets.select(key, "set_key").join(common_owners(sets, found.select("token", "customer_id").distinct()), "set_key").select(key, "customers")
