"""Queries of learning, memory, feedback, decisions and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import routing as rt
from ledgerline.functions import text as tx
from ledgerline.functions import values as vl
from ledgerline.operators import knowledge as kn
from ledgerline.operators import postings, relations
from ledgerline.operators.decide import cascade
from ledgerline.plans.registry import query
from ledgerline.plans.views import HOLDOUT, NV, narratives, table

_NV = f"WITH {NV}"
_SPLIT = "1996-01"


def _batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = narratives(spark, sf_dir).withColumn("template", F.regexp_replace("raw", "[0-9]+", "#"))
    return n.where(F.col("period") < _SPLIT), n.where((F.col("period") >= _SPLIT) & (F.col("period") < HOLDOUT))


@query(
    "learn_upsert_state",
    f"{_NV} SELECT cid, channel, CAST(count(*) AS BIGINT) AS seen, CAST(count(DISTINCT period) - 1 AS BIGINT) AS advances, max(period) AS last_period, round(1 - 0.8 * pow(0.7, count(DISTINCT period) - 1), 9) AS confidence FROM nv WHERE period < '{HOLDOUT}' GROUP BY ALL",
)
def learn_upsert_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches learned one after the other."""
    first, second = _batches(spark, sf_dir)
    return kn.learn(kn.learn(None, first, ["cid", "channel"]), second, ["cid", "channel"])


@query(
    "late_data_counts_only",
    f"{_NV}, n AS (SELECT cid, count(*) FILTER (WHERE period >= '{_SPLIT}') AS late, count(DISTINCT period) FILTER (WHERE period >= '{_SPLIT}') AS dl, max(period) FILTER (WHERE period >= '{_SPLIT}') AS ml, count(DISTINCT period) AS d, count(*) AS c, max(period) AS m FROM nv WHERE period < '{HOLDOUT}' GROUP BY 1) SELECT cid, CAST(c AS BIGINT) AS seen, CAST(CASE WHEN dl > 0 THEN dl - 1 ELSE d - 1 END AS BIGINT) AS advances, coalesce(ml, m) AS last_period, round(1 - 0.8 * pow(0.7, CASE WHEN dl > 0 THEN dl - 1 ELSE d - 1 END), 9) AS confidence FROM n",
)
def late_data_counts_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older batch arrives after the newer one: counts grow, confidence does not."""
    first, second = _batches(spark, sf_dir)
    return kn.learn(kn.learn(None, second, ["cid"]), first, ["cid"])


@query("reindex_rebuild", f"{_NV} SELECT token, CAST(count(*) AS BIGINT) AS patterns, CAST(sum(weight) AS DOUBLE) AS weight FROM (SELECT 'w:tien' AS token, 1.0 AS weight FROM nv WHERE period < '{HOLDOUT}' UNION ALL SELECT 'id:' || cid, 8.0 FROM nv WHERE period < '{HOLDOUT}') GROUP BY token")
def reindex_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings rebuilt from all patterns at once."""
    known = narratives(spark, sf_dir).where(F.col("period") < HOLDOUT)
    tokens = F.array(F.struct(F.lit("w:tien").alias("token"), F.lit(postings.TOKEN_WEIGHTS["w"]).alias("weight")), F.struct(F.concat(F.lit("id:"), "cid").alias("token"), F.lit(postings.TOKEN_WEIGHTS["id"]).alias("weight")))
    return known.select(F.explode(tokens).alias("x")).groupBy("x.token").agg(F.count("*").alias("patterns"), F.sum("x.weight").alias("weight"))


@query(
    "settlement_learning",
    f"{_NV} SELECT raw, CAST(count(DISTINCT cid) AS BIGINT) AS customers, CAST(count(*) AS BIGINT) AS rows, count(DISTINCT cid) >= 10 AS settlement FROM nv WHERE period < '{HOLDOUT}' AND raw LIKE '%HD%' GROUP BY raw",
)
def settlement_learning(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = narratives(spark, sf_dir).where((F.col("period") < HOLDOUT) & F.col("raw").contains("HD"))
    return kn.settlement_units(known, "raw", ["txn_id"], "raw", "cid").drop("run")


@query(
    "settlement_runs_of_channel",
    f"""{_NV}, m AS (SELECT *, CASE WHEN raw LIKE '%HD%' THEN 'HD' ELSE raw END AS unit FROM nv), n AS (SELECT *, CASE WHEN unit IS DISTINCT FROM lag(unit) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM m WINDOW w AS (PARTITION BY amount > 100000 ORDER BY txn_id)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY amount > 100000 ORDER BY txn_id ROWS UNBOUNDED PRECEDING) AS run FROM n)
    SELECT amount > 100000 AS large, CAST(run AS BIGINT) AS run, CAST(count(DISTINCT cid) AS BIGINT) AS customers, CAST(count(*) AS BIGINT) AS rows, count(DISTINCT cid) >= 10 AS settlement FROM r GROUP BY ALL""",
)
def settlement_runs_of_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs over two keys that hold all rows between them: consecutive contract transfers count as one."""
    n = narratives(spark, sf_dir).withColumn("large", F.col("amount") > 100000)
    unit = F.when(F.col("raw").contains("HD"), "HD").otherwise(F.col("raw"))
    return kn.settlement_units(n.withColumn("unit", unit), "large", ["txn_id"], "unit", "cid")


@query("settlement_memberships", f"{_NV} SELECT regexp_replace(raw, '[0-9]+', '#', 'g') AS template, cid, CAST(count(*) AS BIGINT) AS seen FROM nv WHERE period < '{_SPLIT}' GROUP BY ALL")
def settlement_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kn.memberships(_batches(spark, sf_dir)[0], "template", "cid")


@query(
    "batch_settlement",
    f"{_NV}, t AS (SELECT channel, regexp_replace(raw, '[0-9]+', '#', 'g') AS template, count(DISTINCT cid) AS most_customers, count(*) FILTER (WHERE raw LIKE '%HD%') AS settled_rows FROM nv WHERE period < '{HOLDOUT}' GROUP BY ALL) SELECT channel, template, CAST(most_customers AS BIGINT) AS most_customers, CAST(settled_rows AS BIGINT) AS settled_rows FROM t WHERE most_customers >= 10 AND (channel = '1-URGENT' OR settled_rows > 0)",
)
def batch_settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = narratives(spark, sf_dir).where(F.col("period") < HOLDOUT).withColumn("template", F.regexp_replace("raw", "[0-9]+", "#"))
    templates = known.groupBy("channel", "template").agg(F.count_distinct("cid").alias("most_customers"), F.count_if(F.col("raw").contains("HD")).alias("settled_rows"))
    return kn.settlements(templates.withColumn("mode", F.when(F.col("channel") == "1-URGENT", "proxy").otherwise("unknown"))).drop("mode")


@query(
    "recurring_memory",
    f"{_NV} SELECT sha256(concat_ws(chr(31), channel, raw)) AS signature, channel, CAST(count(DISTINCT cid) AS BIGINT) AS owners, CASE WHEN count(DISTINCT cid) = 1 THEN min(cid) END AS owner, arg_max(txn_id, period || lpad(CAST(txn_id AS VARCHAR), 12, '0')) AS latest FROM nv WHERE period < '{HOLDOUT}' GROUP BY channel, raw",
)
def recurring_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = narratives(spark, sf_dir).where(F.col("period") < HOLDOUT)
    return kn.remember(known, F.sha2(F.concat_ws(rt.SEPARATOR, "channel", "raw"), 256))


@query("negative_key", f"{_NV} SELECT txn_id, sha256('recurring:1:' || sha256(raw)) AS key FROM nv")
def negative_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narratives(spark, sf_dir).select("txn_id", rt.negative_key(F.sha2("raw", 256)).alias("key"))


@query("shared_layout_key", f"{_NV} SELECT txn_id, sha256('bidv' || chr(31) || regexp_replace(raw, '[0-9]+', '#', 'g') || chr(31) || 'T') AS key FROM nv")
def shared_layout_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narratives(spark, sf_dir).select("txn_id", rt.layout_key(F.regexp_replace("raw", "[0-9]+", "#"), F.lit("T"), F.lit("BIDV Hue")).alias("key"))


@query(
    "review_feedback",
    f"{_NV}, s AS (SELECT cid, count(*) AS seen FROM nv WHERE period < '{HOLDOUT}' GROUP BY 1), f AS (SELECT cid, count(*) FILTER (WHERE txn_id % 3 <> 0) AS yes, count(*) FILTER (WHERE txn_id % 3 = 0) AS no FROM nv WHERE period >= '{HOLDOUT}' GROUP BY 1) SELECT cid, CAST(seen + coalesce(yes, 0) AS BIGINT) AS seen, coalesce(no > 0 AND yes = 0, FALSE) AS blocked FROM s LEFT JOIN f USING (cid)",
)
def review_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = narratives(spark, sf_dir)
    state = n.where(F.col("period") < HOLDOUT).groupBy("cid").agg(F.count("*").alias("seen"))
    feedback = n.where(F.col("period") >= HOLDOUT).select("cid", (F.col("txn_id") % 3 != 0).alias("accepted"))
    merged, negatives = kn.review(state, feedback, ["cid"])
    return merged.join(negatives.select("cid", F.lit(True).alias("blocked")), "cid", "left").select("cid", "seen", F.coalesce("blocked", F.lit(False)).alias("blocked"))


_REVIEWS = f"""{_NV}, k AS (SELECT raw, min(cid) AS proposed FROM nv WHERE period < '{HOLDOUT}' GROUP BY raw),
r AS (SELECT txn_id, raw, proposed, CASE WHEN txn_id % 4 <> 0 THEN cid END AS chosen, CASE WHEN txn_id % 3 = 0 THEN [cid, proposed] ELSE [cid] END AS mentioned FROM nv LEFT JOIN k USING (raw) WHERE period >= '{HOLDOUT}'),
w AS (SELECT txn_id, raw, proposed AS customer_id FROM r WHERE proposed IS NOT NULL AND proposed IS DISTINCT FROM chosen AND NOT coalesce(len(list_distinct(mentioned)) > 1 AND list_contains(mentioned, proposed) AND list_contains(mentioned, chosen), FALSE)),
l AS (SELECT raw, chosen AS customer_id, max(txn_id) AS lifted FROM r WHERE chosen IS NOT NULL GROUP BY ALL)"""


@query("review_co_recipients", f"{_REVIEWS} SELECT sha256(raw) AS text_key, customer_id, CAST(count(*) AS BIGINT) AS count FROM w LEFT JOIN l USING (raw, customer_id) WHERE lifted IS NULL OR txn_id > lifted GROUP BY ALL")
def review_co_recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The holdout reviewed: memory's first owner was proposed; some texts name two customers, some entries are rejected."""
    n = narratives(spark, sf_dir)
    known = n.where(F.col("period") < HOLDOUT).groupBy("raw").agg(F.min("cid").alias("proposed"))
    rows = n.where(F.col("period") >= HOLDOUT).join(known, "raw", "left")
    both = F.when(F.col("txn_id") % 3 == 0, F.array("cid", "proposed")).otherwise(F.array("cid"))
    reviews = rows.select(
        F.col("txn_id").alias("entry_key"), F.col("txn_id").alias("at"), F.sha2("raw", 256).alias("text_key"), "proposed",
        F.when(F.col("txn_id") % 4 != 0, F.col("cid")).alias("chosen"), both.alias("mentioned"), F.array().cast("array<string>").alias("allocation"),
    )
    return kn.hard_negatives(reviews)


_CHANGES = """WITH c AS (SELECT o_orderkey AS change_id, o_custkey AS entity, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS before, o_orderpriority AS after, o_orderkey % 7 <> 0 AS reversible, o_orderkey % 11 = 0 AS reverted FROM orders),
s AS (SELECT entity, max(change_id) AS last, CASE WHEN entity % 5 = 0 THEN 'edited' ELSE arg_max(after, change_id) END AS value FROM c GROUP BY entity),
u AS (SELECT change_id, entity, before, value, CASE WHEN NOT reversible OR reverted THEN 'fixed' WHEN last > change_id THEN 'newer' WHEN value <> after THEN 'changed' ELSE 'undone' END AS outcome FROM c JOIN s USING (entity))"""


def _changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A log of changes and the values now, some of which were edited past the log."""
    key = F.col("o_orderkey")
    log = table(spark, sf_dir, "orders").select(
        key.alias("change_id"), F.col("o_custkey").alias("entity"), F.when(key % 3 != 0, F.col("o_orderstatus")).alias("before"),
        F.col("o_orderpriority").alias("after"), (key % 7 != 0).alias("reversible"), (key % 11 == 0).alias("reverted"),
    )
    last = log.groupBy("entity").agg(F.max_by("after", "change_id").alias("value"))
    return log, last.select("entity", F.when(F.col("entity") % 5 == 0, "edited").otherwise(F.col("value")).alias("value"))


@query("undo_changes", f"{_CHANGES} SELECT change_id, outcome FROM u")
def undo_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, current = _changes(spark, sf_dir)
    return kn.undo(log, current, log).select("change_id", "outcome")


@query("undo_state", f"{_CHANGES}, b AS (SELECT entity, before FROM u WHERE outcome = 'undone') SELECT entity, CASE WHEN b.entity IS NOT NULL THEN before ELSE value END AS value FROM s LEFT JOIN b USING (entity) WHERE b.entity IS NULL OR before IS NOT NULL")
def undo_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, current = _changes(spark, sf_dir)
    return kn.after_undo(current, kn.undo(log, current, log))


@query(
    "import_pipeline",
    f"{_NV} SELECT channel, CASE WHEN amount <= 1000 THEN 'skipped' WHEN txn_id % 11 = 0 THEN 'unresolved' ELSE 'learned' END AS status, CAST(count(*) AS BIGINT) AS n FROM nv WHERE period < '{HOLDOUT}' GROUP BY ALL",
)
def import_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed rows by what an import does with them."""
    known = narratives(spark, sf_dir).where(F.col("period") < HOLDOUT)
    status = F.when(F.col("amount") <= 1000, "skipped").when(F.col("txn_id") % 11 == 0, "unresolved").otherwise("learned")
    receipts = kn.unseen(known.withColumn("receipt", F.sha2(F.concat_ws("|", "txn_id", "raw", "cid"), 256)), None)
    return receipts.groupBy("channel", status.alias("status")).agg(F.count("*").alias("n"))


_CASCADE = f"""{_NV}, k AS (SELECT * FROM nv WHERE period < '{HOLDOUT}'), q AS (SELECT *, regexp_extract(raw, 'KH ([0-9]{{6}})', 1) AS kh, regexp_extract(raw, 'HD ([0-9]+)', 1) AS hd FROM nv WHERE period >= '{HOLDOUT}'),
m AS (SELECT raw, channel, count(DISTINCT cid) AS mo, min(cid) AS mc FROM k GROUP BY ALL),
i AS (SELECT regexp_extract(raw, 'KH ([0-9]{{6}})', 1) AS kh, count(DISTINCT cid) AS io, min(cid) AS ic FROM k WHERE raw LIKE '%KH%' GROUP BY 1),
h AS (SELECT regexp_extract(raw, 'HD ([0-9]+)', 1) AS hd, count(DISTINCT cid) AS ho, min(cid) AS hc FROM k WHERE raw LIKE '%HD%' GROUP BY 1),
f AS (SELECT q.*, mo, mc, io, ic, ho, hc FROM q LEFT JOIN m ON m.raw = q.raw AND m.channel = q.channel LEFT JOIN i ON i.kh = q.kh AND q.kh <> '' LEFT JOIN h ON h.hd = q.hd AND q.hd <> ''),
r AS (SELECT *, CASE WHEN amount <= 1000 THEN 'not_credit' WHEN mo > 1 AND kh = '' THEN 'memory_shared' WHEN mo = 1 AND (kh = '' OR mc = kh) THEN 'memory' WHEN mo = 1 THEN 'memory_conflict' WHEN kh <> '' AND io IS NULL THEN 'id_unknown' WHEN io > 1 THEN 'id_shared' WHEN io = 1 THEN 'id' WHEN hd <> '' AND ho IS NULL THEN 'contract_unknown' WHEN ho > 1 THEN 'contract_shared' WHEN ho = 1 THEN 'contract' ELSE 'nothing' END AS rule FROM f)"""


@query(
    "decision_cascade",
    f"""{_CASCADE} SELECT txn_id, rule, CASE WHEN rule = 'not_credit' THEN 'reject' WHEN rule IN ('memory', 'id', 'contract') THEN 'auto_accept' ELSE 'manual_check' END AS decision,
CASE rule WHEN 'memory' THEN mc WHEN 'id' THEN ic WHEN 'contract' THEN hc END AS customer_id, CAST(CASE rule WHEN 'memory' THEN 0.97 WHEN 'id' THEN 0.98 WHEN 'contract' THEN 0.96 ELSE 0.0 END AS DOUBLE) AS score FROM r""",
)
def decision_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = narratives(spark, sf_dir)
    return cascade(n.where(F.col("period") >= HOLDOUT), n.where(F.col("period") < HOLDOUT)).select("txn_id", "rule", "decision", "customer_id", "score")


@query(
    "chronological_holdout",
    f"{_CASCADE}, d AS (SELECT cid, CASE rule WHEN 'memory' THEN mc WHEN 'id' THEN ic WHEN 'contract' THEN hc END AS c FROM r), s AS (SELECT count(*) FILTER (WHERE c = cid) AS tp, count(*) FILTER (WHERE c <> cid) AS fp, count(*) FILTER (WHERE c IS NULL) AS fn FROM d) SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall FROM s",
)
def chronological_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn before the holdout, decide after it, and score against what is known of the holdout."""
    n = narratives(spark, sf_dir)
    decided = cascade(n.where(F.col("period") >= HOLDOUT), n.where(F.col("period") < HOLDOUT))
    c = F.col("customer_id")
    counts = decided.agg(F.count_if(c == F.col("cid")).alias("tp"), F.count_if(c != F.col("cid")).alias("fp"), F.count_if(c.isNull()).alias("fn"))
    m = vl.ratio_metrics(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.select("tp", "fp", "fn", F.round(m["precision"], 9).alias("precision"), F.round(m["recall"], 9).alias("recall"))


@query(
    "unmatched_truth_anti",
    f"{_NV} SELECT CAST(count(DISTINCT sha256(lower(raw))) AS BIGINT) AS unmatched FROM nv WHERE period >= '{HOLDOUT}' AND sha256(lower(raw)) NOT IN (SELECT sha256(lower(raw)) FROM nv WHERE period < '{HOLDOUT}')",
)
def unmatched_truth_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = narratives(spark, sf_dir).select("period", tx.reconciliation_key(F.col("raw")).alias("key"))
    known, late = n.where(F.col("period") < HOLDOUT), n.where(F.col("period") >= HOLDOUT)
    return relations.drop_members(late, known, "key").agg(F.count_distinct("key").alias("unmatched"))


@query("benchmark_training_join", f"{_NV} SELECT t.txn_id AS txn_id, l.cid AS label FROM nv t JOIN (SELECT raw, min(cid) AS cid FROM nv GROUP BY raw HAVING count(DISTINCT cid) = 1) l ON l.raw = t.raw WHERE period < '{HOLDOUT}'")
def benchmark_training_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = narratives(spark, sf_dir)
    labels = n.groupBy("raw").agg(F.min("cid").alias("label"), F.count_distinct("cid").alias("n")).where("n = 1").drop("n")
    return n.where(F.col("period") < HOLDOUT).join(labels, "raw").select("txn_id", "label")


@query("benchmark_holdout_join", f"{_NV} SELECT t.txn_id AS txn_id, l.cid AS label FROM nv t LEFT JOIN (SELECT raw, min(cid) AS cid FROM nv GROUP BY raw HAVING count(DISTINCT cid) = 1) l ON l.raw = t.raw WHERE period >= '{HOLDOUT}'")
def benchmark_holdout_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = narratives(spark, sf_dir)
    labels = n.groupBy("raw").agg(F.min("cid").alias("label"), F.count_distinct("cid").alias("n")).where("n = 1").drop("n")
    return n.where(F.col("period") >= HOLDOUT).join(labels, "raw", "left").select("txn_id", "label")


@query("retention_replay", f"{_NV}, b AS (SELECT raw, channel, min(cid) AS one, count(DISTINCT cid) AS owners FROM nv WHERE period < '{_SPLIT}' GROUP BY ALL), a AS (SELECT raw, channel, count(DISTINCT cid) AS owners FROM nv WHERE period < '{HOLDOUT}' GROUP BY ALL) SELECT CAST(count(*) AS BIGINT) AS links, CAST(count(*) FILTER (WHERE b.owners = 1 AND a.owners = 1) AS BIGINT) AS kept, CAST(count(*) FILTER (WHERE b.owners = 1 AND a.owners > 1) AS BIGINT) AS shared, CAST(count(*) FILTER (WHERE a.owners IS NULL) AS BIGINT) AS lost FROM b LEFT JOIN a USING (raw, channel)")
def retention_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the memory of an early store still says after the store has grown."""
    n = narratives(spark, sf_dir)
    signature = F.sha2(F.concat_ws(rt.SEPARATOR, "channel", "raw"), 256)
    before = kn.remember(n.where(F.col("period") < _SPLIT), signature)
    after = kn.remember(n.where(F.col("period") < HOLDOUT), signature).select("signature", F.col("owners").alias("now"))
    both = before.join(after, "signature", "left")
    return both.agg(F.count("*").alias("links"), F.count_if((F.col("owners") == 1) & (F.col("now") == 1)).alias("kept"), F.count_if((F.col("owners") == 1) & (F.col("now") > 1)).alias("shared"), F.count_if(F.col("now").isNull()).alias("lost"))


@query("version_gate", "SELECT r_regionkey, r_regionkey % 2 = 0 AS current FROM region")
def version_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether stored rows were made by the current version of their function."""
    stored = F.when(F.col("r_regionkey") % 2 == 0, "rules-1").otherwise("rules-0")
    return table(spark, sf_dir, "region").select("r_regionkey", (stored == "rules-1").alias("current"))


@query("revision_compare_and_set", "SELECT n_nationkey, CAST(n_nationkey % 3 + CASE WHEN n_nationkey % 2 = 0 AND n_nationkey % 3 = 1 THEN 1 ELSE 0 END AS INTEGER) AS revision, CASE WHEN n_nationkey % 2 = 0 AND n_nationkey % 3 = 1 THEN 'new' ELSE n_name END AS value, n_nationkey % 2 = 0 AND n_nationkey % 3 = 1 AS applied FROM nation")
def revision_compare_and_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    current = n.select("n_nationkey", (F.col("n_nationkey") % 3).alias("revision"), F.col("n_name").alias("value"))
    change = n.where("n_nationkey % 2 = 0").select("n_nationkey", F.lit(1).alias("revision"), F.lit("new").alias("value"))
    return kn.compare_and_set(current, change, ["n_nationkey"])


@query("alias_posting_sync", "WITH c AS (SELECT p_partkey % 50 AS customer_id, p_name FROM part), old AS (SELECT DISTINCT 'name:' || unnest(string_split(p_name, ' ')) AS token, customer_id FROM c WHERE customer_id >= 10), new AS (SELECT DISTINCT 'name:' || unnest(['moi', 'ten']) AS token, customer_id FROM c WHERE customer_id < 10) SELECT token, customer_id FROM old UNION ALL SELECT token, customer_id FROM new UNION ALL SELECT DISTINCT 'id:' || customer_id, customer_id FROM c")
def alias_posting_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("customer_id"), "p_name")
    names = c.select(F.explode(F.split("p_name", " ")).alias("w"), "customer_id").select(F.concat(F.lit("name:"), "w").alias("token"), "customer_id", F.lit(2.0).alias("weight")).distinct()
    ids = c.select(F.concat(F.lit("id:"), F.col("customer_id").cast("string")).alias("token"), "customer_id", F.lit(8.0).alias("weight")).distinct()
    renamed = c.where("customer_id < 10").select("customer_id", F.lit("ten moi").alias("alias")).distinct()
    return kn.sync_tokens(names.unionByName(ids), renamed).select("token", "customer_id")


@query("slot_rule_invalidation", "SELECT l_linenumber, l_returnflag, CAST(count(*) AS BIGINT) AS total FROM lineitem WHERE NOT (l_linenumber = 3 OR l_returnflag = 'N' AND l_linenumber = 1) GROUP BY ALL")
def slot_rule_invalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = table(spark, sf_dir, "lineitem").groupBy("l_linenumber", "l_returnflag").agg(F.count("*").alias("total"))
    touched = stats.where("l_linenumber = 3 OR (l_returnflag = 'N' AND l_linenumber = 1)")
    return kn.invalidate(stats, touched, ["l_linenumber", "l_returnflag"])


@query("benchmark_policy_rewrite", f"{_NV} SELECT txn_id, CASE WHEN cid NOT IN (SELECT cid FROM nv WHERE period < '{HOLDOUT}') THEN 'unseen' ELSE channel END AS reported FROM nv WHERE period >= '{HOLDOUT}'")
def benchmark_policy_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose customer is not in the training store are reported apart."""
    n = narratives(spark, sf_dir)
    trained = n.where(F.col("period") < HOLDOUT).select("cid").distinct().withColumn("trained", F.lit(True))
    late = n.where(F.col("period") >= HOLDOUT).join(trained, "cid", "left")
    return late.select("txn_id", F.when(F.col("trained").isNull(), "unseen").otherwise(F.col("channel")).alias("reported"))


@query("migration_backfill", "SELECT DISTINCT sha256(p_name) AS digest, p_name AS template FROM part")
def migration_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the templates that a store lacks: insert of distinct rows, existing ones left alone."""
    all_rows = table(spark, sf_dir, "part").select(F.sha2("p_name", 256).alias("digest"), F.col("p_name").alias("template")).distinct()
    present = all_rows.where(F.col("digest") < "8")
    return present.unionByName(relations.drop_members(all_rows, present, "digest"))


@query("merge_state_full", f"{_NV}, a AS (SELECT cid, count(*) AS n, max(period) AS p FROM nv WHERE period < '{_SPLIT}' GROUP BY 1), b AS (SELECT cid, count(*) AS n, max(period) AS p FROM nv WHERE period >= '{_SPLIT}' AND period < '{HOLDOUT}' GROUP BY 1) SELECT cid, CAST(coalesce(a.n, 0) + coalesce(b.n, 0) AS BIGINT) AS seen, greatest(a.p, b.p) AS last FROM a FULL JOIN b USING (cid)")
def merge_state_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = (b.groupBy("cid").agg(F.count("*").alias("seen"), F.max("period").alias("last")) for b in _batches(spark, sf_dir))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return relations.merge_state(first, second, ["cid"], {"seen": zero("o_seen") + zero("d_seen"), "last": F.greatest("o_last", "d_last")})


@query("cascading_delete", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 3)")
def cascading_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "orders").where("o_custkey % 10 = 3").select(F.col("o_orderkey").alias("l_orderkey"))
    return relations.drop_members(table(spark, sf_dir, "lineitem"), gone, "l_orderkey").select("l_orderkey", "l_linenumber")


@query("route_bulk_update", "SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') THEN 'proxy' ELSE 'unknown' END AS mode FROM orders")
def route_bulk_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), F.lit("proxy").alias("mode")).distinct()
    return table(spark, sf_dir, "orders").join(chosen, "o_custkey", "left").select("o_orderkey", F.coalesce("mode", F.lit("unknown")).alias("mode"))


@query("missing_value_decay", f"{_NV}, m AS (SELECT cid, max(period) AS last FROM nv WHERE period < '{HOLDOUT}' AND raw LIKE '%KH%' GROUP BY 1), n AS (SELECT cid, count(DISTINCT period) AS missed FROM nv JOIN m USING (cid) WHERE period < '{HOLDOUT}' AND period > last GROUP BY 1) SELECT cid, CAST(coalesce(missed, 0) AS BIGINT) AS missing_count, round(0.2 * pow(0.7, coalesce(missed, 0)), 9) AS confidence FROM m LEFT JOIN n USING (cid)")
def missing_value_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each newer period without a value takes a share of its confidence, once."""
    known = narratives(spark, sf_dir).where(F.col("period") < HOLDOUT)
    last = known.where(F.col("raw").contains("KH")).groupBy("cid").agg(F.max("period").alias("last"))
    missed = known.join(last, "cid").where("period > last").groupBy("cid").agg(F.count_distinct("period").alias("missed"))
    n = F.coalesce("missed", F.lit(0)).cast("long")
    return last.join(missed, "cid", "left").select("cid", n.alias("missing_count"), F.round(vl.FIRST * F.pow(F.lit(vl.DECAY), n), 9).alias("confidence"))


@query("reason_lookup", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Mã khách hàng trùng khớp.' WHEN 1 THEN 'Mã thuộc nhiều khách hàng; cần kiểm tra thủ công.' WHEN 2 THEN 'Chưa có dữ liệu đã xác nhận; cần kiểm tra thủ công.' ELSE 'other' END AS message FROM orders")
def reason_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.get(F.array(*map(F.lit, ("unique", "shared", "unknown", "other"))), (F.col("o_orderkey") % 4).cast("int"))
    messages = F.create_map(*(F.lit(x) for pair in rt.REASONS.items() for x in pair))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(F.try_element_at(messages, code), code).alias("message"))


@query("payment_hint", f"{_NV} SELECT txn_id, CASE WHEN txn_id % 3 = 0 THEN 'proxy' ELSE 'unknown' END AS mode FROM nv")
def payment_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("txn_id") % 3 == 0, F.concat(F.lit("MA_GD:629957609|"), "cid", F.lit(", Nước 8/2026#"))).otherwise(F.col("raw"))
    return narratives(spark, sf_dir).select("txn_id", rt.payment_hint(raw).alias("mode"))


@query("payment_route", "SELECT o_orderkey, (['proxy', 'proxy', 'self', 'unknown'])[o_orderkey % 4 + 1] AS mode, (['bank', 'wallet', 'unknown', 'other'])[o_orderkey % 4 + 1] AS kind, CASE WHEN o_orderkey % 4 = 2 THEN '' ELSE 'X' END AS name FROM orders")
def payment_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("o_orderkey") % 4).cast("int")
    mode = F.get(F.array(*map(F.lit, ("Thu hộ qua ngân hàng", "Ví điện tử", "Tự trả", "chưa rõ"))), k)
    kind = F.get(F.array(*map(F.lit, ("", "", "Ngân hàng", "Dịch vụ khác"))), k)
    r = rt.payment_route(mode, kind, F.lit(" X "))
    return table(spark, sf_dir, "orders").select("o_orderkey", r["mode"].alias("mode"), r["kind"].alias("kind"), r["name"].alias("name"))


@query("evidence_struct", f"{_NV} SELECT txn_id, channel || ':' || cid AS evidence FROM nv")
def evidence_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.struct(F.col("channel").alias("channel"), F.array_sort(F.array("cid")).alias("customers"))
    rows = narratives(spark, sf_dir).select("txn_id", e.alias("e"))
    return rows.select("txn_id", F.concat_ws(":", "e.channel", F.array_join("e.customers", ",")).alias("evidence"))


@query("export_projection", f"{_NV} SELECT txn_id, raw AS narrative, cid AS customer, round(amount, 2) AS credit, 'KH ' || cid AS label FROM nv")
def export_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = narratives(spark, sf_dir)
    return n.select("txn_id", tx.csv_safe(F.col("raw")).alias("narrative"), F.col("cid").alias("customer"), F.round("amount", 2).alias("credit"), F.concat(F.lit("KH "), "cid").alias("label"))
