"""Queries of joins, aggregations, windows, sets, sorts and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions import text as tx
from ledgerline.functions import values as vl
from ledgerline.operators import postings, relations
from ledgerline.plans.registry import query
from ledgerline.plans.views import FOLD, HOLDOUT, NV, narratives, table

_NV = f"WITH {NV}"


# Joins


@query(
    "roster_recent_topk",
    "SELECT c_mktsegment, c_custkey, CAST(rank AS INTEGER) AS rank FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY last DESC, c_custkey) AS rank FROM (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1) JOIN customer ON c_custkey = o_custkey) WHERE rank <= 20",
)
def roster_recent_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 most recent members of each segment. Members are cut per key bucket first, so no segment meets in one task."""
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    rows = table(spark, sf_dir, "customer").join(last, "c_custkey").withColumn("bucket", F.pmod(F.xxhash64("c_custkey"), F.lit(64)))
    order = [F.desc("last"), F.col("c_custkey")]
    near = postings.top_k(rows, ["c_mktsegment", "bucket"], order, 20)
    return postings.top_k(near, ["c_mktsegment"], order, 20).select("c_mktsegment", "c_custkey", "rank")


@query(
    "dominant_channel_mode",
    "SELECT o_custkey, o_orderpriority AS channel, CAST(n AS BIGINT) AS n FROM (SELECT o_custkey, o_orderpriority, count(*) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS r FROM orders GROUP BY 1, 2) WHERE r = 1",
)
def dominant_channel_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.mode_of(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "channel")


@query(
    "recurring_owner_lookup",
    f"""{_NV}, k AS (SELECT raw, channel, cid, max(period || lpad(CAST(txn_id AS VARCHAR), 12, '0')) AS latest FROM nv WHERE period < '{HOLDOUT}' GROUP BY ALL),
m AS (SELECT raw, channel, count(DISTINCT cid) AS owners, max(latest) AS latest FROM k GROUP BY ALL)
SELECT n.txn_id, CAST(coalesce(m.owners, 0) AS BIGINT) AS owners, CAST(substr(m.latest, 8) AS BIGINT) AS latest_link FROM nv n LEFT JOIN m ON n.raw = m.raw AND n.channel = m.channel WHERE n.period >= '{HOLDOUT}'""",
)
def recurring_owner_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All owners of a signature and channel are counted before the latest link is shown."""
    n = narratives(spark, sf_dir)
    memory = n.where(F.col("period") < HOLDOUT).groupBy("raw", "channel").agg(F.count_distinct("cid").alias("owners"), F.max(F.struct("period", "txn_id")).alias("latest"))
    found = n.where(F.col("period") >= HOLDOUT).join(memory, ["raw", "channel"], "left")
    return found.select("txn_id", F.coalesce("owners", F.lit(0)).cast("long").alias("owners"), F.col("latest.txn_id").alias("latest_link"))


@query(
    "shared_layout_first_match",
    f"{_NV} SELECT channel, min(txn_id) AS example FROM nv WHERE period < '{HOLDOUT}' AND regexp_extract(raw, 'KH ([0-9]{{6}})', 1) = cid GROUP BY channel",
)
def shared_layout_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first confirmed example of each channel whose written id is its own customer."""
    own = narratives(spark, sf_dir).where((F.col("period") < HOLDOUT) & (F.regexp_extract("raw", r"KH (\d{6})", 1) == F.col("cid")))
    return own.groupBy("channel").agg(F.min("txn_id").alias("example"))


@query(
    "saved_name_reuse",
    f"{_NV}, k AS (SELECT raw, max(txn_id) AS saved FROM nv WHERE period < '{HOLDOUT}' GROUP BY raw) SELECT n.txn_id, k.saved FROM nv n JOIN k ON n.raw = k.raw WHERE n.period >= '{HOLDOUT}'",
)
def saved_name_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = narratives(spark, sf_dir)
    saved = n.where(F.col("period") < HOLDOUT).groupBy("raw").agg(F.max("txn_id").alias("saved"))
    return n.where(F.col("period") >= HOLDOUT).join(saved, "raw").select("txn_id", "saved")


@query("detail_owners", f"{_NV} SELECT raw, CAST(count(DISTINCT cid) AS BIGINT) AS owners, min(cid) AS first_owner FROM nv WHERE period < '{HOLDOUT}' GROUP BY raw")
def detail_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = narratives(spark, sf_dir).where(F.col("period") < HOLDOUT)
    return known.groupBy("raw").agg(F.count_distinct("cid").alias("owners"), F.min("cid").alias("first_owner"))


@query(
    "left_outer_history",
    "SELECT c_custkey, CAST(coalesce(n, 0) AS BIGINT) AS seen, last FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, strftime(max(o_orderdate), '%Y-%m-%d') AS last FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey",
)
def left_outer_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("seen"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last"))
    return relations.with_history(table(spark, sf_dir, "customer").select("c_custkey"), history, "c_custkey", {"seen": 0})


@query("semi_membership", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return relations.keep_members(table(spark, sf_dir, "customer"), members, "c_custkey").select("c_custkey", "c_name")


@query("anti_rejected", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return relations.drop_members(table(spark, sf_dir, "customer"), rejected, "c_custkey").select("c_custkey")


@query(
    "exists_scope",
    "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 480000) AS individual, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '5-LOW') AS collection FROM customer",
)
def exists_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(F.col("o_totalprice") > 480000).alias("individual"), F.bool_or(F.col("o_orderpriority") == "5-LOW").alias("collection"))
    return relations.with_history(table(spark, sf_dir, "customer").select("c_custkey"), flags, "c_custkey", {"individual": False, "collection": False})


@query("customer_pattern_counts", "SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS patterns FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def customer_pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("patterns"))
    return relations.with_history(table(spark, sf_dir, "customer").select("c_custkey"), counts, "c_custkey", {"patterns": 0})


@query("examples_per_customer_top3", "SELECT o_custkey, o_orderkey, CAST(rank AS INTEGER) AS rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders) WHERE rank <= 3")
def examples_per_customer_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.top_k(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("latest_example", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM (SELECT o_custkey, o_orderkey, o_orderdate, max(o_orderdate) OVER (PARTITION BY o_custkey) AS m FROM orders) WHERE o_orderdate = m GROUP BY 1")
def latest_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("o_orderkey"))


_WILSON_LOW = "((hits / total) + 1.96*1.96/(2*total) - 1.96 * sqrt((hits / total)*(1-(hits / total))/total + 1.96*1.96/(4.0*total*total))) / (1 + 1.96*1.96/total)"
_WILSON_HIGH = _WILSON_LOW.replace(" - 1.96 * sqrt", " + 1.96 * sqrt")


@query(
    "slot_kind_broadcast_join",
    f"""WITH s AS (SELECT l_linenumber, l_returnflag, CAST(count(*) FILTER (WHERE l_linestatus = 'F') AS DOUBLE) AS hits, CAST(count(*) AS DOUBLE) AS total FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l.l_linenumber, CASE WHEN {_WILSON_LOW} >= 0.95 THEN 'id' WHEN {_WILSON_HIGH} <= 0.05 THEN 'not_id' ELSE 'unknown' END AS kind FROM lineitem l JOIN s ON s.l_linenumber = l.l_linenumber AND s.l_returnflag = l.l_returnflag""",
)
def slot_kind_broadcast_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of each position, looked up per row. The planner broadcasts the statistics if they are small."""
    rows = table(spark, sf_dir, "lineitem")
    slots = rows.groupBy("l_linenumber", "l_returnflag").agg(F.count_if(F.col("l_linestatus") == "F").alias("hits"), F.count("*").alias("total"))
    kinds = slots.select("l_linenumber", "l_returnflag", vl.slot_kind(F.col("hits"), F.col("total")).alias("kind"))
    return rows.join(kinds, ["l_linenumber", "l_returnflag"]).select("l_orderkey", "l_linenumber", "kind")


_SPANS = "e AS (SELECT event_id, user_id, CAST(event_id AS BIGINT) * 3 AS a, CAST(event_id AS BIGINT) * 3 + CAST(floor(value) AS BIGINT) % 11 AS b FROM events)"


@query("span_overlap_join", f"WITH {_SPANS} SELECT x.event_id AS event_id, y.event_id AS other_id FROM e x JOIN e y ON x.a < y.b AND x.b > y.a AND x.a < x.b AND y.a < y.b AND x.event_id < y.event_id")
def span_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of events whose spans overlap, each once."""
    e = _spans(spark, sf_dir)
    other = e.select(F.col("event_id").alias("other_id"), F.col("a").alias("c"), F.col("b").alias("d"))
    return relations.overlap_join(e.select("event_id", "a", "b"), other, ("a", "b"), ("c", "d"), 64).where("event_id < other_id").select("event_id", "other_id")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("event_id") * 3
    return table(spark, sf_dir, "events").select("event_id", "user_id", start.alias("a"), (start + F.floor("value") % 11).alias("b"))


@query(
    "interval_union",
    """WITH e AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) AS a, CAST(floor(value) AS BIGINT) + event_id % 4 AS b FROM events),
m AS (SELECT *, CASE WHEN max(b) OVER (PARTITION BY user_id ORDER BY a, b, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= a THEN 0 ELSE 1 END AS n FROM e),
i AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY a, b, event_id ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT user_id, min(a) AS a, max(b) AS b FROM i GROUP BY user_id, island""",
)
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.floor("value")
    return relations.interval_union(table(spark, sf_dir, "events").select("user_id", a.alias("a"), (a + F.col("event_id") % 4).alias("b")), "user_id", "a", "b")


@query(
    "ordered_number_alignment",
    f"""{_NV}, n AS (SELECT txn_id, cid, period, regexp_extract_all(raw, '[0-9]+') AS nums FROM nv),
k AS (SELECT cid, nums AS old FROM n WHERE period < '{HOLDOUT}' QUALIFY row_number() OVER (PARTITION BY cid ORDER BY period DESC, txn_id DESC) = 1),
u AS (SELECT txn_id, nums, old, unnest(generate_series(1, len(nums))) AS slot FROM n JOIN k USING (cid) WHERE period >= '{HOLDOUT}')
SELECT txn_id, CAST(slot AS INTEGER) AS slot, nums[slot] AS query_value, old[slot] AS history_value, coalesce(nums[slot] = old[slot], FALSE) AS exact FROM u""",
)
def ordered_number_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a narrative beside those of its customer's latest example, slot by slot."""
    n = narratives(spark, sf_dir).withColumn("nums", F.regexp_extract_all("raw", F.lit(r"[0-9]+"), F.lit(0)))
    known = postings.top_k(n.where(F.col("period") < HOLDOUT), ["cid"], [F.desc("period"), F.desc("txn_id")], 1).select("cid", F.col("nums").alias("old"))
    rows = n.where(F.col("period") >= HOLDOUT).join(known, "cid").select("txn_id", "old", F.posexplode("nums").alias("at", "query_value"))
    history = F.get(F.col("old"), F.col("at"))
    return rows.select("txn_id", (F.col("at") + 1).alias("slot"), "query_value", history.alias("history_value"), F.coalesce(F.col("query_value") == history, F.lit(False)).alias("exact"))


@query(
    "ordered_agreement",
    f"""{_NV}, n AS (SELECT txn_id, cid, period, regexp_extract_all(raw, '[0-9]+') AS nums FROM nv),
k AS (SELECT cid, nums AS old FROM n WHERE period < '{HOLDOUT}' QUALIFY row_number() OVER (PARTITION BY cid ORDER BY period DESC, txn_id DESC) = 1)
SELECT txn_id, round(len(list_filter(generate_series(1, len(nums)), lambda i: coalesce(nums[i] = old[i], FALSE))) / len(nums), 4) AS agreement FROM n JOIN k USING (cid) WHERE period >= '{HOLDOUT}'""",
)
def ordered_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ordered_number_alignment(spark, sf_dir)
    return rows.groupBy("txn_id").agg(F.round(F.avg(F.col("exact").cast("double")), 4).alias("agreement"))


@query(
    "receipt_dedup",
    f"{_NV} SELECT n.txn_id FROM nv n WHERE n.period >= '{HOLDOUT}' AND sha256(concat_ws('|', n.raw, n.cid, n.channel)) NOT IN (SELECT sha256(concat_ws('|', raw, cid, channel)) FROM nv WHERE period < '{HOLDOUT}') AND sha256(concat_ws('|', n.raw, CAST(CAST(n.cid AS BIGINT) AS VARCHAR), n.channel)) NOT IN (SELECT sha256(concat_ws('|', raw, cid, channel)) FROM nv WHERE period < '{HOLDOUT}')",
)
def receipt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narratives without a receipt under any of their key variants."""
    n = narratives(spark, sf_dir)
    key = lambda cid: F.sha2(F.concat_ws("|", "raw", cid, "channel"), 256)
    receipts = n.where(F.col("period") < HOLDOUT).select(key(F.col("cid")).alias("key")).distinct()
    late = n.where(F.col("period") >= HOLDOUT)
    variants = late.select("txn_id", F.explode(F.array(key(F.col("cid")), key(F.col("cid").cast("long").cast("string")))).alias("key"))
    return late.join(variants.join(receipts, "key", "left_semi").select("txn_id"), "txn_id", "left_anti").select("txn_id")


@query(
    "ngram_alias_join",
    """WITH d AS (SELECT p_partkey, string_split(p_name || ' ' || lower(p_type) || ' ' || p_name, ' ') AS w FROM part),
g AS (SELECT DISTINCT p_partkey, array_to_string(w[i : i + n - 1], ' ') AS gram FROM (SELECT p_partkey, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, generate_series(2, 6) AS g(n)))
SELECT p_partkey, gram AS alias FROM g WHERE gram IN (SELECT p_name FROM part)""",
)
def ngram_alias_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    words = F.split(F.concat_ws(" ", "p_name", F.lower("p_type"), "p_name"), " ")
    grams = part.select("p_partkey", F.explode(tx.word_ngrams(words)).alias("alias"))
    return relations.keep_members(grams, part.select(F.col("p_name").alias("alias")), "alias")


@query(
    "substring_alias_join",
    """WITH a AS (SELECT DISTINCT p_name FROM part), d AS (SELECT p_partkey, ' ' || p_name || ' ' || lower(p_type) || ' ' AS t FROM part)
SELECT p_partkey, p_name AS alias FROM d, a WHERE contains(t, ' ' || p_name || ' ')""",
)
def substring_alias_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases that stand in a text as whole words: met through their first word, verified as phrases."""
    part = table(spark, sf_dir, "part")
    aliases = part.select(F.col("p_name").alias("alias")).distinct().withColumn("word", F.substring_index("alias", " ", 1))
    texts = part.select("p_partkey", F.concat(F.lit(" "), F.concat_ws(" ", "p_name", F.lower("p_type")), F.lit(" ")).alias("t"))
    met = texts.select("p_partkey", "t", F.explode(F.array_distinct(F.split(F.trim("t"), " "))).alias("word")).join(aliases, "word")
    return met.where(F.col("t").contains(F.concat(F.lit(" "), "alias", F.lit(" ")))).select("p_partkey", "alias")


@query("account_ownership", "SELECT l_suppkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags, CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts FROM lineitem GROUP BY 1")
def account_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"), F.count_distinct("l_partkey").alias("parts"))


@query("feature_value_join", "SELECT l_orderkey, l_linenumber, p_partkey FROM lineitem JOIN part ON p_partkey = l_partkey AND p_size = CAST(l_quantity AS INTEGER)")
def feature_value_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"), F.round("l_quantity").cast("int").alias("p_size"))
    return rows.join(part, ["p_partkey", "p_size"]).select("l_orderkey", "l_linenumber", "p_partkey")


@query("template_usage", f"{_NV} SELECT template, CAST(sum(n) AS BIGINT) AS links, CAST(max(c) AS BIGINT) AS customers FROM (SELECT regexp_replace(raw, '[0-9]+', '#', 'g') AS template, count(*) AS n, count(DISTINCT cid) AS c FROM nv GROUP BY 1, period < '{HOLDOUT}') GROUP BY 1")
def template_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of both stores by template, united before they are counted."""
    n = narratives(spark, sf_dir).withColumn("template", F.regexp_replace("raw", "[0-9]+", "#"))
    known, late = n.where(F.col("period") < HOLDOUT), n.where(F.col("period") >= HOLDOUT)
    count = lambda d: d.groupBy("template").agg(F.count("*").alias("n"), F.count_distinct("cid").alias("c"))
    return count(known).unionByName(count(late)).groupBy("template").agg(F.sum("n").alias("links"), F.max("c").alias("customers"))


@query("orphan_anti_join", "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45) AND s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)")
def orphan_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_suppkey").alias("s_suppkey"))
    held = table(spark, sf_dir, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("s_nationkey"))
    return relations.drop_members(relations.drop_members(table(spark, sf_dir, "supplier"), used, "s_suppkey"), held, "s_nationkey").select("s_suppkey")


@query("rekey_merge", "SELECT lpad(CAST(o_custkey % 1000 AS VARCHAR), 6, '0') AS customer_id, CAST(count(*) AS BIGINT) AS seen, max(o_totalprice) AS top, CAST(count(DISTINCT o_custkey) AS BIGINT) AS merged FROM orders GROUP BY 1")
def rekey_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "orders").withColumn("customer_id", tx.id_key((F.col("o_custkey") % 1000).cast("string")))
    return keyed.groupBy("customer_id").agg(F.count("*").alias("seen"), F.max("o_totalprice").alias("top"), F.count_distinct("o_custkey").alias("merged"))


@query("truth_map_join", f"{_NV}, m AS (SELECT channel, lower(raw) AS k, string_agg(DISTINCT cid, ',' ORDER BY cid) AS truth FROM nv WHERE period < '{HOLDOUT}' GROUP BY ALL) SELECT txn_id, truth FROM nv n LEFT JOIN m ON m.channel = n.channel AND m.k = lower(n.raw) WHERE period >= '{HOLDOUT}'")
def truth_map_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = narratives(spark, sf_dir).withColumn("k", tx.fold(F.col("raw")))
    truth = n.where(F.col("period") < HOLDOUT).groupBy("channel", "k").agg(F.array_join(F.array_sort(F.collect_set("cid")), ",").alias("truth"))
    return n.where(F.col("period") >= HOLDOUT).join(truth, ["channel", "k"], "left").select("txn_id", "truth")


@query("archive_inner_join", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 300000")
def archive_inner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_totalprice > 300000").withColumnRenamed("o_custkey", "c_custkey")
    return o.join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey").select("o_orderkey", "c_name", "o_totalprice")


# Aggregations


@query("distinct_customers_per_template", f"{_NV} SELECT regexp_replace(raw, '[0-9]+', '#', 'g') AS template, CAST(count(DISTINCT cid) AS BIGINT) AS customers FROM nv GROUP BY 1")
def distinct_customers_per_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narratives(spark, sf_dir).groupBy(F.regexp_replace("raw", "[0-9]+", "#").alias("template")).agg(F.count_distinct("cid").alias("customers"))


_COHORT = """h AS (SELECT o_custkey AS customer_id, count(*) AS seen, max(strftime(o_orderdate, '%Y-%m-%d')) AS last_seen, 1 AS patterns, 0 AS collections, max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS bank FROM orders WHERE o_orderstatus = 'F' GROUP BY 1
UNION ALL SELECT o_custkey, count(*), max(strftime(o_orderdate, '%Y-%m-%d')), 0, 1, 0 FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
g AS (SELECT customer_id, CAST(sum(seen) AS BIGINT) AS seen, max(last_seen) AS last_seen, CAST(sum(patterns) AS BIGINT) AS patterns, CAST(sum(collections) AS BIGINT) AS collections, CAST(max(bank) AS INTEGER) AS bank FROM h GROUP BY 1)"""


def _cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    day = F.max(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("last_seen")
    urgent = F.max(F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)).alias("bank")
    own = o.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("customer_id")).agg(F.count("*").alias("seen"), day, F.lit(1).alias("patterns"), F.lit(0).alias("collections"), urgent)
    shared = o.where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("customer_id")).agg(F.count("*").alias("seen"), day, F.lit(0).alias("patterns"), F.lit(1).alias("collections"), F.lit(0).alias("bank"))
    return own.unionByName(shared).groupBy("customer_id").agg(F.sum("seen").alias("seen"), F.max("last_seen").alias("last_seen"), F.sum("patterns").alias("patterns"), F.sum("collections").alias("collections"), F.max("bank").alias("bank"))


@query("cohort_history_agg", f"WITH {_COHORT} SELECT * FROM g")
def cohort_history_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cohort(spark, sf_dir)


@query(
    "cohort_page",
    f"""WITH {_COHORT} SELECT customer_id, c_name, seen FROM g JOIN customer ON c_custkey = customer_id WHERE customer_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 450000)
ORDER BY CASE WHEN bank = 1 THEN 0 ELSE 1 END, patterns DESC, seen DESC, last_seen DESC, customer_id LIMIT 50 OFFSET 20""",
)
def cohort_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = table(spark, sf_dir, "orders").where("o_orderstatus = 'O' AND o_totalprice > 450000").select(F.col("o_custkey").alias("customer_id"))
    rows = relations.drop_members(_cohort(spark, sf_dir), rejected, "customer_id").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"), "c_name"), "customer_id")
    order = [F.when(F.col("bank") == 1, 0).otherwise(1), F.desc("patterns"), F.desc("seen"), F.desc("last_seen"), F.col("customer_id")]
    return relations.page(rows, order, 20, 50).select("customer_id", "c_name", "seen")


@query(
    "id_slot_statistics",
    f"""{_NV}, g AS (SELECT channel, raw, list(DISTINCT cid) AS owners FROM nv WHERE period < '{HOLDOUT}' GROUP BY ALL HAVING count(DISTINCT cid) < 10),
n AS (SELECT channel, owners, unnest(regexp_extract_all(raw, '[A-Z]+ [0-9]+')) AS slot FROM g)
SELECT channel, regexp_replace(slot, '[0-9]+', '') || '#' || length(regexp_extract(slot, '[0-9]+')) AS context, CAST(count(*) FILTER (WHERE list_contains(owners, lpad(regexp_extract(slot, '[0-9]+'), 6, '0'))) AS BIGINT) AS hits, CAST(count(*) AS BIGINT) AS total FROM n GROUP BY 1, 2""",
)
def id_slot_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the number at a position is its narrative's customer; narratives of ten or more customers are left out."""
    known = narratives(spark, sf_dir).where(F.col("period") < HOLDOUT)
    grouped = known.groupBy("channel", "raw").agg(F.collect_set("cid").alias("owners")).where(F.size("owners") < 10)
    slots = grouped.select("channel", "owners", F.explode(F.regexp_extract_all("raw", F.lit("[A-Z]+ [0-9]+"), F.lit(0))).alias("slot"))
    number = F.regexp_extract("slot", "[0-9]+", 0)
    context = F.concat(F.regexp_replace("slot", "[0-9]+", ""), F.lit("#"), F.length(number).cast("string"))
    return slots.groupBy("channel", context.alias("context")).agg(F.count_if(F.array_contains("owners", tx.id_key(number))).alias("hits"), F.count("*").alias("total"))


@query(
    "name_slot_statistics",
    """SELECT split_part(p_name, ' ', 1) AS context, CAST(count(*) AS BIGINT) AS hits, CAST(count(*) FILTER (WHERE p_type = 'ECONOMY') AS BIGINT) AS economy, string_agg(DISTINCT split_part(p_name, ' ', 2), ',' ORDER BY split_part(p_name, ' ', 2)) AS boundaries FROM part GROUP BY 1 HAVING count(*) >= 20""",
)
def name_slot_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split("p_name", " ")
    grouped = table(spark, sf_dir, "part").groupBy(F.get(parts, F.lit(0)).alias("context")).agg(F.count("*").alias("hits"), F.count_if(F.col("p_type") == "ECONOMY").alias("economy"), F.array_join(F.array_sort(F.collect_set(F.get(parts, F.lit(1)))), ",").alias("boundaries"))
    return grouped.where("hits >= 20")


@query(
    "label_table_conditional_aggs",
    f"{_NV} SELECT raw, CAST(count(DISTINCT CASE WHEN channel <> '5-LOW' THEN cid END) AS BIGINT) AS ids, min(CASE WHEN channel <> '5-LOW' THEN cid END) AS first_id, CAST(sum(CASE WHEN channel = '5-LOW' THEN 1 ELSE 0 END) AS BIGINT) AS skipped, bool_or(channel = '1-URGENT') AS urgent FROM nv GROUP BY raw",
)
def label_table_conditional_aggs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.when(F.col("channel") != "5-LOW", F.col("cid"))
    return narratives(spark, sf_dir).groupBy("raw").agg(
        F.count_distinct(kept).alias("ids"), F.min(kept).alias("first_id"), F.count_if(F.col("channel") == "5-LOW").alias("skipped"), F.bool_or(F.col("channel") == "1-URGENT").alias("urgent")
    )


_LABELS = "WITH l AS (SELECT l.doc_id, quality, toxic, lang FROM labels l JOIN documents USING (doc_id))"
_METRIC = "CAST(count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS BIGINT) AS fp, CAST(count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS BIGINT) AS fn"
_PRF = "round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall, round(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif((tp / nullif(tp + fp, 0)) + (tp / nullif(tp + fn, 0)), 0), 9) AS f1"


def _metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    q, t = F.col("quality"), F.col("toxic")
    counts = rows.groupBy(*keys).agg(F.count_if((q == 1) & (t == 0)).alias("tp"), F.count_if((q == 0) & (t == 0)).alias("fp"), F.count_if((q == 1) & (t == 1)).alias("fn"))
    m = vl.ratio_metrics(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.select(*keys, "tp", "fp", "fn", *(F.round(m[k], 9).alias(k) for k in ("precision", "recall", "f1")))


@query("confusion_metrics", f"{_LABELS} SELECT tp, fp, fn, {_PRF} FROM (SELECT {_METRIC} FROM l)")
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id"), [])


@query("metrics_by_slice", f"{_LABELS}, s AS (SELECT *, unnest(['all', lang, CASE WHEN doc_id % 2 = 0 THEN 'seen' ELSE 'unseen' END]) AS slice FROM l) SELECT slice, tp, fp, fn, {_PRF} FROM (SELECT slice, {_METRIC} FROM s GROUP BY slice)")
def metrics_by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    slices = F.array(F.lit("all"), F.col("lang"), F.when(F.col("doc_id") % 2 == 0, "seen").otherwise("unseen"))
    return _metrics(rows.withColumn("slice", F.explode(slices)), ["slice"])


@query(
    "nearest_rank_percentiles",
    "WITH v AS (SELECT user_id, list_sort(list(value)) AS v FROM events GROUP BY 1) SELECT user_id, v[1 + (len(v) - 1) * 50 // 100] AS p50, v[1 + (len(v) - 1) * 95 // 100] AS p95, v[1 + (len(v) - 1) * 99 // 100] AS p99 FROM v",
)
def nearest_rank_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By rank, not by collecting a key's values: equal values share a counted row, and a running count finds the rank."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("user_id")
    ranked = counts.withColumn("upto", F.sum("n").over(w.orderBy("value"))).withColumn("total", F.sum("n").over(w))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor((F.col("total") - 1) * p / 100), F.col("value")))
    return ranked.groupBy("user_id").agg(at(50).alias("p50"), at(95).alias("p95"), at(99).alias("p99"))


@query(
    "import_counters",
    "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY GROUPING SETS ((event_type), (strftime(ts, '%Y-%m-%d')), ())",
)
def import_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return e.groupingSets([["event_type"], ["day"], []], "event_type", "day").agg(F.count("*").alias("n"))


@query(
    "scope_digest",
    """WITH a AS (SELECT o_orderkey // 4096 AS k, sha256(string_agg(o_orderkey || ':' || o_orderstatus, ';' ORDER BY o_orderkey)) AS d FROM orders GROUP BY 1),
    b AS (SELECT k // 4096 AS k, sha256(string_agg(d, '' ORDER BY k)) AS d FROM a GROUP BY k // 4096) SELECT sha256(string_agg(d, '' ORDER BY k)) AS digest FROM b""",
)
def scope_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest of a whole scope as a tree over ranges of keys, so that no task holds more than a range."""
    row = F.struct(F.col("o_orderkey").alias("k"), F.concat_ws(":", "o_orderkey", "o_orderstatus").alias("v"))
    level = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 4096).alias("k"), row.alias("x"))

    def up(rows: DataFrame, between: str) -> DataFrame:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]), between)
        return rows.groupBy("k").agg(F.sha2(joined, 256).alias("v"))

    ranges = up(level, ";").select(F.floor(F.col("k") / 4096).alias("k"), F.struct("k", "v").alias("x"))
    groups = up(ranges, "").select(F.lit(0).alias("k"), F.struct("k", "v").alias("x"))
    return up(groups, "").select(F.col("v").alias("digest"))


@query(
    "settlement_runs",
    """WITH r AS (SELECT user_id, event_id, event_type, value, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT r.*, e.ts FROM r JOIN events e USING (event_id)))
SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS size, min(event_id) AS first_event FROM s GROUP BY user_id, run, event_type HAVING count(*) >= 3""",
)
def settlement_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the same kind in a user's history, three or longer."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    changed = ~F.lag("event_type").over(w).eqNullSafe(F.col("event_type"))
    numbered = relations.runs(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], changed)
    return numbered.groupBy("user_id", "run", "event_type").agg(F.count("*").alias("size"), F.min("event_id").alias("first_event")).where("size >= 3").drop("run")


@query(
    "split_count_running_max",
    f"{_NV}, d AS (SELECT channel, period, raw, count(DISTINCT cid) AS c FROM nv GROUP BY ALL), m AS (SELECT channel, period, max(c) AS c FROM d GROUP BY ALL) SELECT channel, period, CAST(max(c) OVER (PARTITION BY channel ORDER BY period ROWS UNBOUNDED PRECEDING) AS BIGINT) AS most FROM m",
)
def split_count_running_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = narratives(spark, sf_dir).groupBy("channel", "period", "raw").agg(F.count_distinct("cid").alias("c"))
    months = each.groupBy("channel", "period").agg(F.max("c").alias("c"))
    w = Window.partitionBy("channel").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return months.select("channel", "period", F.max("c").over(w).alias("most"))


@query("confidence_recursion", f"{_NV} SELECT cid, round(1 - 0.8 * pow(0.7, count(DISTINCT period) - 1), 9) AS confidence FROM nv GROUP BY cid")
def confidence_recursion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence after a customer's months: only a strictly newer month raises it, so the fold has a closed form."""
    months = narratives(spark, sf_dir).groupBy("cid").agg(F.count_distinct("period").alias("months"))
    return months.select("cid", F.round(vl.confidence_after(F.col("months") - 1), 9).alias("confidence"))


@query(
    "value_decay_fold",
    f"""{_NV}, m AS (SELECT cid, period, bool_or(raw LIKE '%KH%') AS here FROM nv GROUP BY ALL), l AS (SELECT cid, list(here ORDER BY period) AS h FROM m GROUP BY cid)
SELECT cid, round(list_reduce(list_concat([0.2::DOUBLE], list_transform(h, lambda x: CASE WHEN x THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)), lambda c, x: CASE WHEN x = 1.0 THEN c + 0.3 * (1 - c) ELSE c * 0.7 END), 9) AS confidence FROM l""",
)
def value_decay_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of a value over a customer's months (bounded by the calendar), present or absent in each."""
    months = narratives(spark, sf_dir).groupBy("cid", "period").agg(F.bool_or(F.col("raw").contains("KH")).alias("here"))
    folded = months.groupBy("cid").agg(F.transform(F.array_sort(F.collect_list(F.struct("period", "here"))), lambda x: x["here"]).alias("h"))
    return folded.select("cid", F.round(vl.decayed(F.col("h")), 9).alias("confidence"))


@query("freshness_snapshot", f"{_NV} SELECT max(period) AS newest, CAST(count(*) AS BIGINT) AS links, CAST(count(DISTINCT cid) AS BIGINT) AS customers, max(period) < '{HOLDOUT}' AS frozen FROM nv WHERE period < '{HOLDOUT}'")
def freshness_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = narratives(spark, sf_dir).where(F.col("period") < HOLDOUT)
    return known.agg(F.max("period").alias("newest"), F.count("*").alias("links"), F.count_distinct("cid").alias("customers"), (F.max("period") < HOLDOUT).alias("frozen"))


@query("dashboard_counts", "SELECT 'customers' AS what, CAST(count(*) AS BIGINT) AS n FROM customer UNION ALL SELECT 'links', count(*) FROM orders UNION ALL SELECT 'features', count(*) FROM lineitem UNION ALL SELECT 'providers', count(*) FROM supplier")
def dashboard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = [table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n") for name, t in (("customers", "customer"), ("links", "orders"), ("features", "lineitem"), ("providers", "supplier"))]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])


@query("row_error_isolation", "SELECT event_id, CAST(TRY_CAST(CASE WHEN event_id % 9 = 0 THEN 'x' || value ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS DOUBLE) AS amount, event_id % 9 = 0 AS failed FROM events")
def row_error_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("x"), F.col("value").cast("string"))).otherwise(F.col("value").cast("string"))
    amount = text.try_cast("double")
    return table(spark, sf_dir, "events").select("event_id", amount.alias("amount"), (amount.isNull() & text.isNotNull()).alias("failed"))


@query("bounded_error_sample", "SELECT event_type, event_id, CAST(rank AS INTEGER) AS rank FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rank FROM events WHERE event_id % 9 = 0) WHERE rank <= 50")
def bounded_error_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 errors of each kind, cut per bucket before they meet."""
    bad = table(spark, sf_dir, "events").where("event_id % 9 = 0").withColumn("bucket", F.pmod(F.xxhash64("event_id"), F.lit(64)))
    near = postings.top_k(bad, ["event_type", "bucket"], [F.col("event_id")], 50)
    return postings.top_k(near, ["event_type"], [F.col("event_id")], 50).select("event_type", "event_id", "rank")


# Filters, sorts and sets


@query("credit_filter", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' OR o_totalprice <= 0 THEN 'reject' ELSE 'keep' END AS decision FROM orders")
def credit_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("debit", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0.0))
    return o.select("o_orderkey", F.when((F.col("o_totalprice") > 0) & (F.col("debit") == 0), "keep").otherwise("reject").alias("decision"))


@query("label_status_case", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'skipped' WHEN c_custkey % 4 = 1 THEN 'unresolved' ELSE 'confirmed' END AS status FROM customer")
def label_status_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.get(F.array(F.lit(" KO "), F.lit("ht"), F.lit("000123"), F.lit("45")), (F.col("c_custkey") % 4).cast("int"))
    key = F.lower(F.trim(code))
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(key == "ko", "skipped").when(key.isin("ht", "pd", "th"), "unresolved").otherwise("confirmed").alias("status"))


@query("validation_override", "SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'manual_check' ELSE 'auto_accept' END AS decision, CAST(CASE WHEN o_orderkey % 6 = 0 THEN 0.59 ELSE 0.97 END AS DOUBLE) AS score FROM orders")
def validation_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = F.when(F.col("o_orderkey") % 6 == 0, F.array(F.lit("bad date"))).otherwise(F.array().cast("array<string>"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", errors.alias("errors"), F.lit(0.97).alias("score"))
    bad = F.size("errors") > 0
    return o.select("o_orderkey", F.when(bad, "manual_check").otherwise("auto_accept").alias("decision"), F.when(bad, F.least("score", F.lit(0.59))).otherwise(F.col("score")).alias("score"))


@query("signed_amount_split", "SELECT c_custkey, greatest(c_acctbal, 0) AS credit, greatest(-c_acctbal, 0) AS debit FROM customer")
def signed_amount_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select("c_custkey", F.greatest(b, F.lit(0.0)).alias("credit"), F.greatest(-b, F.lit(0.0)).alias("debit"))


@query("multi_column_search", "SELECT c_custkey FROM customer WHERE contains(lower(c_name), '42') OR contains(lower(c_mktsegment), 'auto') OR contains(CAST(c_nationkey AS VARCHAR), '42')")
def multi_column_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    search = lambda term: F.lower("c_name").contains(term) | F.lower("c_mktsegment").contains(term) | F.col("c_nationkey").cast("string").contains(term)
    return c.where(search("42") | F.lower("c_mktsegment").contains("auto")).select("c_custkey")


@query("escaped_contains", "SELECT event_id FROM events WHERE contains(props, '\"k\": 5')")
def escaped_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("props").contains('"k": 5')).select("event_id")


@query("json_path_filter", "SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) BETWEEN 10 AND 20")
def json_path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.get_json_object("props", "$.k").try_cast("int").between(10, 20)).select("event_id")


@query("json_missing_is_not_empty", "SELECT event_id, event_id % 3 = 1 AS empty_list FROM events")
def json_missing_is_not_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.get(F.array(F.lit('{"a": 1}'), F.lit('{"ids": []}'), F.lit('{"ids": ["1"]}')), (F.col("event_id") % 3).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object(text, "$.ids") == "[]", F.lit(False)).alias("empty_list"))


@query(
    "working_row_query",
    f"{_NV} SELECT txn_id FROM nv WHERE channel = '1-URGENT' AND contains(lower(concat_ws(' ', raw, cid, period)), '1998') ORDER BY txn_id DESC LIMIT 100 OFFSET 10",
)
def working_row_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = narratives(spark, sf_dir).where((F.col("channel") == "1-URGENT") & tx.fold(F.concat_ws(" ", "raw", "cid", "period")).contains("1998"))
    return relations.page(rows, [F.desc("txn_id")], 10, 100).select("txn_id")


@query("customer_search", "SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS patterns FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE starts_with(lpad(CAST(c_custkey AS VARCHAR), 6, '0'), '0001') OR contains(lower(c_name), '77') GROUP BY 1 ORDER BY 1 LIMIT 50")
def customer_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where(F.lpad(F.col("c_custkey").cast("string"), 6, "0").startswith("0001") | F.lower("c_name").contains("77")).select("c_custkey")
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("patterns"))
    return relations.page(relations.with_history(c, counts, "c_custkey", {"patterns": 0}), [F.col("c_custkey")], 0, 50)


@query("intent_predicate", f"{_NV} SELECT txn_id, regexp_matches(lower(raw), '(^|[^a-z0-9])tien *nuoc([^a-z0-9]|$)') AS water FROM nv")
def intent_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = r"\b(?:tien\s*nuoc|nuoc\s+(?:sinh|sach|may)|phi\s*nuoc|(?:tt|tthd)\s+nuoc|water\s+bill)\b"
    return narratives(spark, sf_dir).select("txn_id", tx.fold(F.col("raw")).rlike(pattern).alias("water"))


@query("candidate_number_filter", f"{_NV} SELECT txn_id, coalesce(array_to_string(list_filter(regexp_extract_all(raw, '[0-9]+'), lambda x: length(x) = 6), ','), '') AS candidates FROM nv")
def candidate_number_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = F.regexp_extract_all("raw", F.lit("[0-9]+"), F.lit(0))
    return narratives(spark, sf_dir).select("txn_id", F.array_join(F.filter(numbers, lambda x: F.length(x) == 6), ",").alias("candidates"))


@query("relevance_filter", f"{_NV} SELECT txn_id FROM nv WHERE (regexp_matches(raw, 'KH [0-9]{{6}}') OR channel = '2-HIGH') AND amount > 1000")
def relevance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    personal = F.col("raw").rlike(r"KH \d{6}") | (F.col("channel") == "2-HIGH")
    return narratives(spark, sf_dir).where(personal & (F.col("amount") > 1000)).select("txn_id")


@query("chronology_guard", f"{_NV} SELECT CAST(count(*) FILTER (WHERE period >= '{HOLDOUT}') AS BIGINT) AS leaked, CAST(count(*) AS BIGINT) AS rows FROM nv WHERE period < '{HOLDOUT}'")
def chronology_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = narratives(spark, sf_dir).where(F.col("period") < HOLDOUT)
    return known.agg(F.count_if(F.col("period") >= HOLDOUT).alias("leaked"), F.count("*").alias("rows"))


@query("export_case", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'batch' WHEN o_orderkey % 5 = 1 THEN 'multi' WHEN o_orderkey % 5 = 2 THEN 'history_multi' WHEN o_orderkey % 5 = 3 THEN 'suggested' ELSE '' END AS kind FROM orders")
def export_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    evidence = F.struct((k == 0).alias("batch"), F.when(k == 1, F.array(F.lit("000001"), F.lit("000002"))).alias("allocation"), F.when(k == 2, F.array(F.lit("000003"))).alias("history"), F.when(k == 3, F.lit("000004")).alias("suggested"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", evidence.alias("e"))
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    return rows.select("o_orderkey", F.when(F.col("e.batch"), "batch").when(some(F.col("e.allocation")), "multi").when(some(F.col("e.history")), "history_multi").when(F.col("e.suggested").isNotNull(), "suggested").otherwise("").alias("kind"))


@query("bulk_eligibility", f"{_NV} SELECT txn_id FROM nv WHERE channel = '3-MEDIUM' AND period >= '{HOLDOUT}'")
def bulk_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = narratives(spark, sf_dir).withColumn("decision", F.when(F.col("channel") == "3-MEDIUM", "auto_accept").otherwise("review"))
    return decided.where((F.col("decision") == "auto_accept") & (F.col("period") >= HOLDOUT)).select("txn_id")


@query("multi_key_boolean_sort", "SELECT o_orderkey FROM orders ORDER BY (o_orderstatus = 'F') DESC, (o_orderpriority = '1-URGENT') DESC, o_totalprice DESC, o_orderkey LIMIT 100")
def multi_key_boolean_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [(F.col("o_orderstatus") == "F").desc(), (F.col("o_orderpriority") == "1-URGENT").desc(), F.desc("o_totalprice"), F.col("o_orderkey")]
    return table(spark, sf_dir, "orders").orderBy(*order).limit(100).select("o_orderkey")


@query("order_limit", "SELECT c_custkey, c_name FROM customer ORDER BY c_name LIMIT 25")
def order_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").orderBy("c_name").limit(25).select("c_custkey", "c_name")


@query("deterministic_limit", "SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 20")
def deterministic_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").orderBy("s_suppkey").limit(20).select("s_suppkey")


@query("scoped_topk", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 4")
def scoped_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.top_k(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 4).select("o_custkey", "o_orderkey")


@query("union_distinct_scope", "SELECT o_custkey AS customer_id FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT c_custkey FROM customer WHERE c_acctbal > 5000 UNION SELECT s_suppkey FROM supplier")
def union_distinct_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("customer_id"))
    b = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("customer_id"))
    return a.union(b).union(table(spark, sf_dir, "supplier").select("s_suppkey")).distinct()


@query("set_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocked = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return relations.drop_members(table(spark, sf_dir, "customer").select("c_custkey"), blocked, "c_custkey")


@query("table_browser_page", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') ORDER BY p_partkey LIMIT 50 OFFSET 5")
def table_browser_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.page(table(spark, sf_dir, "part").where(F.lower("p_name").contains("ring")), [F.col("p_partkey")], 5, 50).select("p_partkey", "p_name")


@query("table_scan", "SELECT * FROM supplier")
def table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier")
