"""Queries of the versioned store, of learning into it, and of streams with state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import knowledge, learning
from ledgerline.operators.staging import scratch
from ledgerline.operators.store import Store
from ledgerline.plans.flow_queries import billed
from ledgerline.plans.registry import query
from ledgerline.plans.views import HOLDOUT, NV, narratives, table
from ledgerline.streaming import keyed, progress, recovery

_NV = f"WITH {NV}"
_SPLIT = "1996-01"


@query(
    "multi_table_learning",
    f"""{_NV}, k AS (SELECT *, CASE WHEN txn_id % 5 = 0 THEN regexp_extract(raw, 'HD ([0-9]+)', 1) ELSE '' END AS hd FROM nv WHERE period < '{HOLDOUT}')
    SELECT t.name AS name, CAST(t.rows AS BIGINT) AS rows, CAST((SELECT count(*) FROM k) AS BIGINT) AS seen FROM (
    SELECT 'customers' AS name, count(DISTINCT cid) AS rows FROM k UNION ALL SELECT 'channels', count(DISTINCT channel) FROM k UNION ALL SELECT 'payers', count(DISTINCT (cid, channel)) FROM k
    UNION ALL SELECT 'templates', count(DISTINCT (channel, hd = '')) FROM k UNION ALL SELECT 'members', count(DISTINCT (channel, hd = '', cid)) FROM k
    UNION ALL SELECT unnest(['patterns', 'slots', 'features', 'memory']), count(DISTINCT (cid, channel, hd)) FROM k) t""",
)
def multi_table_learning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches learned into all keyed tables, a commit each; the rows and sightings of the counted tables."""
    store = Store(spark, scratch(spark, "store"), learning.KEYS)
    n = billed(spark, sf_dir).where(F.col("period") < HOLDOUT).withColumn("mode", F.lit("unknown"))
    for part in (F.col("period") < _SPLIT, F.col("period") >= _SPLIT):
        done = learning.learn(store, n.where(part))
    counted = [done.table(t).groupBy().agg(F.count("*").alias("rows"), F.sum("seen").alias("seen")).select(F.lit(t).alias("name"), "rows", "seen") for t in ("customers", "channels", "payers", "templates", "members", "patterns", "slots", "features", "memory")]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out


@query(
    "store_snapshots",
    "SELECT 'opened' AS reader, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE s_nationkey = -1) AS BIGINT) AS moved FROM supplier UNION ALL SELECT 'last', CAST(count(*) FILTER (WHERE s_suppkey % 3 <> 1) AS BIGINT), CAST(count(*) FILTER (WHERE s_suppkey % 3 = 0) AS BIGINT) FROM supplier",
)
def store_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader of a version keeps it while the same table is changed and rows are deleted."""
    store, s = Store(spark, scratch(spark, "store"), {"suppliers": ["s_suppkey"]}), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    opened = store.commit(store.snapshot(), {"suppliers": s})
    moved = s.where("s_suppkey % 3 = 0").withColumn("s_nationkey", F.lit(-1).cast(s.schema["s_nationkey"].dataType))
    last = store.commit(opened, {"suppliers": moved}, {"suppliers": s.where("s_suppkey % 3 = 1")})
    count = lambda name, snap: snap.table("suppliers").groupBy().agg(F.count("*").alias("n"), F.count_if(F.col("s_nationkey") == -1).alias("moved")).select(F.lit(name).alias("reader"), "n", "moved")
    return count("opened", opened).unionByName(count("last", last))


@query(
    "cascade_fixed_point",
    """WITH c AS (SELECT c_custkey FROM customer WHERE c_nationkey = 3), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)),
    l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)), p AS (SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM l) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM o)))
    SELECT 'customer' AS name, CAST(count(*) AS BIGINT) AS gone FROM c UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'lineitem', count(*) FROM l UNION ALL SELECT 'part', count(*) FROM p""",
)
def cascade_fixed_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of one nation go with their orders and items, and parts that no other item needs."""
    columns = {"customer": ["c_custkey", "c_nationkey"], "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_linenumber", "l_partkey"], "part": ["p_partkey"]}
    tables = {name: table(spark, sf_dir, name).select(*of) for name, of in columns.items()}
    references = [("orders", ["o_custkey"], "customer", ["c_custkey"]), ("lineitem", ["l_orderkey"], "orders", ["o_orderkey"])]
    gone = learning.cascade(tables, {"customer": tables["customer"].where("c_nationkey = 3")}, references, [("part", ["p_partkey"], "lineitem", ["l_partkey"])])
    out = None
    for name in columns:
        n = (gone[name] if name in gone else tables[name].limit(0)).groupBy().agg(F.count("*").alias("gone")).select(F.lit(name).alias("name"), "gone")
        out = n if out is None else out.unionByName(n)
    return out


@query(
    "stateful_learning",
    f"""{_NV}, n AS (SELECT cid, count(*) AS seen, count(DISTINCT period) AS months, max(period) AS last_period, count(DISTINCT period) FILTER (WHERE period >= '{_SPLIT}' AND period < '{HOLDOUT}') AS a,
    count(DISTINCT period) FILTER (WHERE period < '{_SPLIT}') AS b, count(DISTINCT period) FILTER (WHERE period >= '{HOLDOUT}') AS c FROM nv GROUP BY cid), s AS (SELECT *, CASE WHEN a > 0 THEN a ELSE b END + c - 1 AS advances FROM n)
    SELECT cid, CAST(seen AS BIGINT) AS seen, CAST(advances AS BIGINT) AS advances, last_period, CAST(months AS BIGINT) AS months, round(1 - 0.8 * pow(0.7, advances), 9) AS confidence FROM s""",
)
def stateful_learning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of three batches, the oldest months second: keyed state counts late months and is not moved by them."""
    source, state, n = scratch(spark, "stream"), scratch(spark, "state"), narratives(spark, sf_dir).select("cid", "period")
    late = F.col("period") < _SPLIT
    # the stream takes up its checkpoint for each part, so a part is one batch and may be any number of files
    for part in (~late & (F.col("period") < HOLDOUT), late, F.col("period") >= HOLDOUT):
        n.where(part).write.mode("append").parquet(source)
        learned = keyed.learn_stream(spark, source, n.schema, ["cid"], state, files_per_batch=None)
    return learned.drop("dormant")


class _Killed(RuntimeError):
    pass


@query("import_resumed", "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def import_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An import that dies after its tables are written and before they are committed, and is begun again: each row counts once."""
    source, path, checkpoint = scratch(spark, "stream"), scratch(spark, "store"), scratch(spark, "checkpoint")
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    e.repartition(2, "event_id").write.parquet(source)
    e.where("event_id % 4 = 0").coalesce(1).write.mode("append").parquet(source)

    def apply(base, batch):
        fresh = knowledge.unseen(batch, base.table("receipts") if "receipts" in base else None, "event_id")
        counts = fresh.groupBy("event_type").agg(F.count("*").alias("n"))
        if "counts" in base:
            counts = counts.unionByName(base.table("counts")).groupBy("event_type").agg(F.sum("n").alias("n"))
        return {"receipts": fresh.select("event_id"), "counts": counts}, {}

    def importer() -> recovery.Importer:
        return recovery.Importer(Store(spark, path, {"receipts": ["event_id"], "counts": ["event_type"]}), "events", apply)

    first = importer()
    publish = first.store.publish

    def dies(manifest):
        if manifest.marks.get("events") == 1:
            raise _Killed("before the commit of batch 1")
        return publish(manifest)

    first.store.publish = dies
    try:
        recovery.run(first, source, e.schema, checkpoint)
    except Exception as error:
        if "before the commit of batch 1" not in str(error):
            raise
    return recovery.run(importer(), source, e.schema, checkpoint).table("counts")


@query("import_progress", "SELECT event_type, CASE WHEN event_id % 9 = 0 THEN 'failed' WHEN event_id % 4 = 0 THEN 'skipped' ELSE 'learned' END AS status, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def import_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters by kind and status, collected while the rows are written."""
    e = table(spark, sf_dir, "events")
    kinds = sorted(r[0] for r in e.select("event_type").distinct().collect())
    counters = progress.BatchProgress("event_type", kinds)
    status = F.when(F.col("event_id") % 9 == 0, "failed").when(F.col("event_id") % 4 == 0, "skipped").otherwise("learned")
    counters.observe(e.select("event_id", "event_type", status.alias("status"))).write.parquet(scratch(spark, "imported"))
    return spark.createDataFrame([(k, s, n) for (k, s), n in counters.counts().items()], "event_type string, status string, n long")
