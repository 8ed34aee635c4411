"""Queries of sources, sinks, streams, parsing and user functions."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import embedding as em
from ledgerline.functions import narrative as nr
from ledgerline.functions import routing as rt
from ledgerline.functions import sequence as sq
from ledgerline.functions import text as tx
from ledgerline.operators import classify, names, postings, similarity
from ledgerline.operators.staging import scratch
from ledgerline.plans.registry import query
from ledgerline.plans.views import HOLDOUT, NV, narratives, table
from ledgerline.sources import ingest, xlsx
from ledgerline.streaming import imports

_NV = f"WITH {NV}"


# Parsing


def billed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narratives with their months in this century, the only one that billing periods are read in."""
    return narratives(spark, sf_dir).withColumn("raw", F.regexp_replace("raw", r"/19(\d\d)$", "/20$1"))


@query(
    "normalize_narrative",
    f"{_NV} SELECT txn_id, CAST(1 AS INTEGER) AS slot, CASE WHEN txn_id % 5 = 0 THEN 'CONTRACT_ID' ELSE 'CUSTOMER_ID' END AS numeric_type, CASE WHEN txn_id % 5 = 0 THEN regexp_extract(raw, 'HD ([0-9]+)', 1) ELSE cid END AS value FROM nv",
)
def normalize_narrative(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nr.normalized(billed(spark, sf_dir), fields=("numbers",))
    return rows.select("txn_id", F.explode("norm.numbers").alias("n")).select("txn_id", "n.slot", "n.numeric_type", "n.value")


@query("narrative_template", f"{_NV} SELECT txn_id, CASE WHEN txn_id % 5 = 0 THEN 'tt tien nuoc hd <NUM_1>' ELSE 'tt tien nuoc kh <NUM_1>' END AS template, CASE WHEN txn_id % 5 = 0 THEN 'T CONTRACT_ID:#' ELSE 'T CUSTOMER_ID:#' END AS structure FROM nv")
def narrative_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nr.normalized(billed(spark, sf_dir), fields=("template", "structure")).select("txn_id", "norm.template", "norm.structure")


@query("period_recompute_versioned", f"{_NV} SELECT txn_id, CASE WHEN txn_id % 2 = 0 THEN 'stored' WHEN txn_id % 5 = 0 THEN 'not_found' ELSE 'identified' END AS status FROM nv")
def period_recompute_versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the current version keep their periods; the others are scanned again."""
    rows = nr.normalized(billed(spark, sf_dir), fields=("period_status",))
    return rows.select("txn_id", F.when(F.col("txn_id") % 2 == 0, "stored").otherwise(F.col("norm.period_status")).alias("status"))


@query("pattern_identity", f"{_NV} SELECT txn_id, '1|' || CASE WHEN txn_id % 5 = 0 THEN 'CONTRACT_ID|' || regexp_extract(raw, 'HD ([0-9]+)', 1) ELSE 'CUSTOMER_ID|' || cid END || '|#' AS identity FROM nv")
def pattern_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nr.normalized(billed(spark, sf_dir), fields=("numbers",))
    return rows.select("txn_id", F.array_join(rt.pattern_identity(F.col("norm.numbers")), ",").alias("identity"))


@query("recurring_signature")
def recurring_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nr.normalized(billed(spark, sf_dir), fields=("segments", "numbers"))
    return rows.select("txn_id", rt.recurring_signature(F.col("norm"), F.col("channel")).alias("signature"))


@query("unique_transfer_reference", f"{_NV} SELECT txn_id, txn_id % 2 = 0 AS unique_reference FROM nv")
def unique_transfer_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("txn_id") % 2 == 0, F.concat(F.lit("@@"), F.lpad(F.col("txn_id").cast("string"), 12, "7"), F.lit("@@_chiho_ "), "raw")).otherwise(F.col("raw"))
    rows = nr.normalized(narratives(spark, sf_dir).withColumn("raw", raw), fields=("numbers",))
    return rows.select("txn_id", rt.unique_transfer_reference(F.col("norm.numbers")).alias("unique_reference"))


@query("slot_context", f"{_NV} SELECT txn_id, CASE WHEN txn_id % 5 <> 0 THEN 'nuoc kh _ ky #6' END AS context FROM nv")
def slot_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of six digits have a context; shorter contract numbers have none."""
    rows = nr.normalized(billed(spark, sf_dir), fields=("numbers",))
    return rows.select("txn_id", F.explode("norm.numbers").alias("n")).select("txn_id", "n.context")


def varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(txn_id, raw): narratives of nine layouts that together hold every role of a number.

    Eight digits without a label that read as a day (20260713) are a date, whatever the layout says, and so no number.
    """
    n, cid = F.col("o_orderkey"), F.lpad(F.col("o_custkey").cast("string"), 6, "0")
    digits = lambda k, width: F.lpad((n * k % 10**width).cast("string"), width, "4")
    raws = [
        F.concat(F.lit("TT tien nuoc KH "), cid, F.lit(" ky 07/2026")),
        F.concat(F.lit("So tien "), digits(7, 7), F.lit(" VND Ac:"), digits(31, 11), F.lit(" IDKH:"), cid),
        F.concat(F.lit("Hóa đơn số "), digits(3, 7), F.lit(" TKThe:"), digits(5, 8), F.lit(" tiền nước mã KH-"), cid, F.lit(" tháng 7 năm 2026")),
        F.concat(F.lit("9"), digits(9, 15), F.lit("Thanh toan 2CHUYEN tien nuoc danh bo "), cid, F.lit(" T8N2026")),
        F.concat(F.lit("MA_GD:"), digits(11, 9), F.lit("|"), cid, F.lit(",Nuoc8/2026#Nguyen Van A#")),
        F.concat(F.lit("@@"), digits(13, 12), F.lit("@@_chiho_ tieu thu "), (n % 90 + 1).cast("string"), F.lit("m3 ref "), digits(17, 6), F.lit(" hop dong AB-"), digits(19, 6)),
        F.concat(F.lit("ID: "), cid, F.lit(" 035285, 046165 tien nuoc ABC"), digits(23, 3), F.lit("X2 ngay 13/09/2026")),
        F.concat(F.lit("O@L_1_2_3_4_"), digits(29, 8), F.lit("_"), cid, F.lit("_AB"), digits(37, 6), F.lit("_tien nuoc")),
        F.concat(F.lit("Chuyen tien so "), digits(41, 8), F.lit(" cho 1.500.000 dong")),
    ]
    return table(spark, sf_dir, "orders").select(n.alias("txn_id"), F.get(F.array(*raws), (n % len(raws)).cast("int")).alias("raw"))


_DIGITS = "lpad(CAST(n * {} % {} AS VARCHAR), {}, '4')"
_ROLES = [
    ["CUSTOMER_ID", "cid"],
    ["AMOUNT", (7, 7), "ACCOUNT_ID", (31, 11), "CUSTOMER_ID", "cid"],
    ["INVOICE_ID", (3, 7), "CARD_ID", (5, 8), "CUSTOMER_ID", "cid"],
    ["BANK_REFERENCE", "'9' || " + _DIGITS.format(9, 10**15, 15), "LOCATION_NUMBER", "'2'", "CUSTOMER_ID", "cid"],
    ["BANK_REFERENCE", (11, 9), "CUSTOMER_ID", "cid"],
    ["BANK_REFERENCE", (13, 12), "QUANTITY", "(n % 90 + 1) || 'm3'", "REFERENCE_ID", (17, 6), "CONTRACT_ID", "'ab-' || " + _DIGITS.format(19, 10**6, 6)],
    ["CUSTOMER_ID", "cid", "CUSTOMER_ID", "'035285'", "CUSTOMER_ID", "'046165'", "MIXED_CODE", "'abc' || " + _DIGITS.format(23, 10**3, 3) + " || 'x2'"],
    [*(x for k in "1234" for x in ("BANK_PROTOCOL", f"'{k}'")), "BANK_REFERENCE", (29, 8), "CUSTOMER_ID", "cid", "INVOICE_CODE", "'ab' || " + _DIGITS.format(37, 10**6, 6)],
    ["UNKNOWN_NUMBER", (41, 8), "AMOUNT", "'1.500.000'"],
]


def _roles_sql() -> str:
    value = lambda v: _DIGITS.format(v[0], 10 ** v[1], v[1]) if isinstance(v, tuple) else v
    day = lambda v: f"regexp_full_match({value(v)}, '20[0-9][0-9](0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])')"
    rows = []
    for k, form in enumerate(_ROLES):
        slot = "1"
        for role, v in zip(form[::2], form[1::2], strict=True):
            dated = isinstance(v, tuple) and v[1] == 8 and role in ("BANK_REFERENCE", "UNKNOWN_NUMBER")
            rows.append(f"SELECT n AS txn_id, CAST({slot} AS INTEGER) AS slot, '{role}' AS numeric_type, {value(v)} AS value FROM o WHERE n % {len(_ROLES)} = {k}" + (f" AND NOT {day(v)}" if dated else ""))
            slot += f" + CASE WHEN {day(v)} THEN 0 ELSE 1 END" if dated else " + 1"
    return "WITH o AS (SELECT o_orderkey AS n, lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS cid FROM orders) " + " UNION ALL ".join(rows)


@query("narrative_roles", _roles_sql())
def narrative_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nr.normalized(varied(spark, sf_dir), fields=("numbers",))
    return rows.select("txn_id", F.explode("norm.numbers").alias("n")).select("txn_id", "n.slot", "n.numeric_type", "n.value")


@query(
    "narrative_periods",
    "SELECT o_orderkey AS txn_id, CASE WHEN o_orderkey % 9 IN (0, 2) THEN '07/2026' WHEN o_orderkey % 9 IN (3, 4) THEN '08/2026' ELSE '' END AS periods, "
    "CASE WHEN o_orderkey % 9 IN (0, 2, 3, 4) THEN 'identified' ELSE 'not_found' END AS status FROM orders",
)
def narrative_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nr.normalized(varied(spark, sf_dir), fields=("periods", "period_status")).select("txn_id", F.array_join("norm.periods", ",").alias("periods"), F.col("norm.period_status").alias("status"))


@query("source_offsets")
def source_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of turns with their text as written, found through folded offsets."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("KH 001545 "), "text").alias("raw"))
    return nr.normalized(rows, fields=("numbers",)).select("conv_id", "turn", F.explode("norm.numbers").alias("n")).select("conv_id", "turn", "n.value", "n.raw_value", "n.offset")


@query("identity_signature", f"{_NV} SELECT txn_id, CASE WHEN txn_id % 5 = 0 THEN lower(raw) ELSE 'tt tien nuoc kh ' || cid END AS signature FROM nv")
def identity_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    def signatures(raw):
        return raw.map(nr.identity_signature)

    signature = F.pandas_udf(signatures, "string")
    return billed(spark, sf_dir).select("txn_id", signature(F.col("raw")).alias("signature"))


@query("locate_names", "SELECT p_partkey, p_name AS found FROM part")
def locate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    def located(raw, name):
        return raw.combine(name, lambda r, n: [t for _, _, t in nr.locate_names(r, [n])])

    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat(F.lit("BIDV;5510;"), "p_name", F.lit(" tra tien")).alias("raw"))
    return rows.select("p_partkey", F.explode(F.pandas_udf(located, "array<string>")("raw", F.upper("p_name"))).alias("found"))


@query("mask_names", "SELECT p_partkey, 'tt <NAME> kh ' || p_size AS masked FROM part")
def mask_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    def masked(template, name):
        return template.combine(name, lambda t, n: nr.mask_names(t, [n]))

    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat(F.lit("tt "), "p_name", F.lit(" kh "), F.col("p_size").cast("string")).alias("t"))
    return rows.select("p_partkey", F.pandas_udf(masked, "string")("t", "p_name").alias("masked"))


@query(
    "bank_field_layouts",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 AND o_orderkey % 3 <> 2 THEN lpad(CAST(o_custkey AS VARCHAR), 6, '0') END AS customer_id,
       CASE WHEN o_orderkey % 4 <> 3 AND o_orderkey % 3 <> 2 THEN 'Nguyen Van A' END AS name FROM orders""",
)
def bank_field_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of both layouts; a date that does not exist, another city's receiver or no proper name makes a layout void."""
    n, cid = F.col("o_orderkey"), F.lpad(F.col("o_custkey").cast("string"), 6, "0")
    day = F.when(n % 4 == 3, "20261332").otherwise("20260801")
    receiver = F.when(n % 3 == 2, "CTCP CAP NUOC DA NANG").otherwise("CITY WATER SUPPLY JSC")
    dotted = F.concat(F.lit("MB.1-2-"), day, F.lit("-101112-3."), day, F.lit("."), receiver, F.lit("."), cid, F.lit(".998877.7/2026.Nguyen Van A..1."))
    name = F.when((n % 4 == 3) | (n % 3 == 2), "N2").otherwise("Nguyen Van A")
    hashed = F.concat(F.lit("MA_GD:629957609|"), cid, F.lit(",Nuoc8/2026#"), name, F.lit("#"))

    def fields(raw):
        import pandas as pd

        found = [nr.bank_field(r) for r in raw]
        return pd.DataFrame({"customer_id": [r[slice(*f["customer"])] if f else None for r, f in zip(raw, found, strict=True)], "name": [nr.bank_name(r) for r in raw]})

    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(n % 2 == 0, dotted).otherwise(hashed).alias("raw"))
    got = F.pandas_udf(fields, "customer_id string, name string")("raw")
    return rows.select("o_orderkey", got.alias("f")).select("o_orderkey", "f.customer_id", "f.name")


@query("receipt_key")
def receipt_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narratives(spark, sf_dir).select("txn_id", rt.receipt_key(F.col("raw"), F.col("cid"), F.col("period"), F.col("amount"), F.col("channel"), F.lit("")).alias("receipt"))


@query("sequence_ratio_rerank")
def sequence_ratio_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused candidates (by shared words) of each item, scored by sequence similarity."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(tx.fold(F.col(c)), F.lit("[a-z]{5,}"), F.lit(0)))
    q = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("q"), words("text").alias("words"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("d"), words("text").alias("words"))
    near = postings.top_k(similarity.word_overlap(q, d, "item_id", "doc_id", "words"), ["item_id"], [F.desc("hits"), F.col("doc_id")], 3)
    pairs = near.join(q.select("item_id", "q"), "item_id").join(d.select("doc_id", "d"), "doc_id")
    return pairs.select("item_id", "doc_id", sq.ratio(F.col("q"), F.col("d")).alias("ratio"))


@query("hash_embedding")
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id", em.embedding(F.col("text")).alias("v"))
    return rows.select("item_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4).alias("norm"), F.size("v").alias("dimensions"))


@query("encode_with_cache_join")
def encode_with_cache_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id", "text")
    cache = rows.where("item_id % 2 = 0").select(F.sha2("text", 256).alias("key"), em.embedding(F.col("text")).alias("embedding"))
    return em.with_cache(rows, "text", cache.dropDuplicates(["key"])).select("item_id", F.size("embedding").alias("dimensions"))


# Sources and sinks


@query("csv_confirmed_scan", "SELECT o_orderkey AS row, lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS customer_id, o_totalprice AS amount, strftime(o_orderdate, '%Y-%m-%dT00:00:00') AS date FROM orders")
def csv_confirmed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A confirmed file written and read back by its header words."""
    path = scratch(spark, "csv")
    o = table(spark, sf_dir, "orders")
    o.select(F.col("o_custkey").alias("IDKH"), F.lit("Tên").alias("TENKH"), F.concat(F.lit("TT "), F.col("o_orderkey").cast("string")).alias("NOIDUNG"), F.col("o_totalprice").cast("decimal(20,2)").alias("SOTIEN"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("NGAY")).write.csv(path, header=True)
    rows = ingest.rename_headers(spark.read.csv(path, header=True))
    typed = ingest.transactions(rows.withColumn("row", F.regexp_extract("raw", r"TT (\d+)", 1).cast("long")))
    return typed.select("row", F.get("customer_ids", F.lit(0)).alias("customer_id"), "amount", "date")


@query("typed_transaction_scan", "SELECT o_orderkey AS row, CASE o_orderkey % 5 WHEN 1 THEN 0.0 ELSE o_totalprice END AS amount, CASE o_orderkey % 5 WHEN 1 THEN o_totalprice ELSE 0.0 END AS debit, o_orderkey % 5 = 2 AS failed FROM orders WHERE o_orderkey % 5 NOT IN (3, 4)")
def typed_transaction_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and page footers are no rows, negative amounts are debits, unreadable ids are errors."""
    k, price = F.col("o_orderkey") % 5, F.col("o_totalprice").cast("decimal(20,2)").cast("string")
    pick = lambda *v: F.get(F.array(*v), k.cast("int"))
    none = F.lit("")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row"), pick(F.lit("01/02/2026"), F.lit("01/02/2026"), F.lit("01/02/2026"), none, none).alias("date"), pick(price, F.concat(F.lit("-"), price), price, price, price).alias("amount"), none.alias("debit"),
        pick(F.lit("r"), F.lit("r"), F.lit("r"), none, none).alias("reference"), pick(F.lit("12"), F.lit("12"), F.lit("1234567"), none, none).alias("customer_id"), none.alias("customer_name"),
        pick(F.lit("TT nuoc"), F.lit("TT nuoc"), F.lit("TT nuoc"), F.lit("Tổng cộng"), F.lit("Trang 3")).alias("raw"), F.lit("BIDV").alias("payer"),
    )
    return ingest.transactions(rows).select("row", "amount", "debit", (F.size("validation_errors") > 0).alias("failed"))


def _workbook(spark: SparkSession, sf_dir: str) -> str:
    """A workbook of two sheets made of nations, in the shared folder (a local path: the format is read by tasks)."""
    rows = [[str(r["n_nationkey"]), r["n_name"], f"TT KH {r['n_nationkey']:06d}"] for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]
    folder = tempfile.mkdtemp(prefix="ledgerline-xlsx-") if not os.path.isdir(scratch_root := os.path.dirname(scratch(spark, "x")).removeprefix("file:")) else tempfile.mkdtemp(dir=scratch_root)
    path = os.path.join(folder, "book.xlsx")
    xlsx.write_workbook(path, {"BIDV": [["", "note"], ["IDKH", "TENKH", "NOIDUNG"], *rows], "notes": [["nothing here"]]})
    return path


@query("xlsx_scan", "SELECT CAST(n_nationkey + 3 AS INTEGER) AS row, n_name AS name, CAST(n_nationkey AS VARCHAR) AS id FROM nation")
def xlsx_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    xlsx.register(spark)
    cells = spark.read.format("xlsx").option("path", _workbook(spark, sf_dir)).load()
    at, _, roles = ingest.probe(cells)["BIDV"]
    return cells.where((F.col("sheet") == "BIDV") & (F.col("row") > at)).select("row", F.col("cells")[roles["customer_name"]].alias("name"), F.col("cells")[roles["customer_id"]].alias("id"))


@query("layout_inference", "SELECT 'BIDV' AS sheet, CAST(2 AS INTEGER) AS header_row, 'confirmed' AS layout")
def layout_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    xlsx.register(spark)
    found = ingest.probe(spark.read.format("xlsx").option("path", _workbook(spark, sf_dir)).load())
    return spark.createDataFrame([(s, at, kind) for s, (at, kind, _) in found.items()], "sheet string, header_row int, layout string")


@query("xlsx_sink", "SELECT lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS id, c_name AS name, c_nationkey AS nation FROM customer")
def xlsx_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as workbooks in two appends, after an overwrite of other rows, and read back: identifiers keep their zeros."""
    xlsx.register(spark)
    path = scratch(spark, "workbooks")
    rows = table(spark, sf_dir, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 12, "0").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    for mode, some in (("append", rows), ("overwrite", rows.where("id < '000000000500'")), ("append", rows.where("id >= '000000000500'"))):
        some.write.format("xlsx").option("path", path).option("rowsPerSheet", "400").mode(mode).save()
    cells = spark.read.format("xlsx").option("path", path).load().where("row > 1")
    return cells.select(F.col("cells")["A"].alias("id"), F.col("cells")["B"].alias("name"), F.col("cells")["C"].cast("int").alias("nation"))


@query("sheet_catalog_filter", "SELECT 'notes' AS skipped")
def sheet_catalog_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets without a known layout."""
    xlsx.register(spark)
    cells = spark.read.format("xlsx").option("path", _workbook(spark, sf_dir)).load()
    known = list(ingest.probe(cells))
    return cells.where(~F.col("sheet").isin(known)).select(F.col("sheet").alias("skipped")).distinct()


@query("file_digest")
def file_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each file of a table, read as bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{sf_dir}/region.parquet")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("digest"))


@query("partitioned_csv_sink", "SELECT o_orderstatus AS sheet, CAST(count(*) AS BIGINT) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def partitioned_csv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "sheets")
    table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("sheet")).write.partitionBy("sheet").csv(path, header=True)
    back = spark.read.csv(path, header=True, schema="o_orderkey long, sheet string")
    return back.groupBy("sheet").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("json_append_sink", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT event_id) AS BIGINT) AS ids FROM events")
def json_append_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Working rows appended in two jobs and read back."""
    path, e = scratch(spark, "rows"), table(spark, sf_dir, "events").select("event_id", "event_type")
    for k in (0, 1):
        e.where(F.col("event_id") % 2 == k).write.mode("append").json(path)
    return spark.read.schema("event_id long, event_type string").json(path).agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@query("error_side_output", "SELECT event_type, CAST(count(*) FILTER (WHERE event_id % 9 <> 0) AS BIGINT) AS good, CAST(count(*) FILTER (WHERE event_id % 9 = 0) AS BIGINT) AS bad FROM events GROUP BY 1")
def error_side_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = imports.split_errors(table(spark, sf_dir, "events"), F.col("event_id") % 9 == 0)
    path = scratch(spark, "errors")
    bad.select("event_id", "event_type").write.json(path)
    errors = spark.read.schema("event_id long, event_type string").json(path)
    return good.groupBy("event_type").agg(F.count("*").alias("good")).join(errors.groupBy("event_type").agg(F.count("*").alias("bad")), "event_type", "full").fillna(0)


@query("audit_append", "SELECT 'rename' AS action, 'customer:' || c_custkey AS entity, c_name AS before, upper(c_name) AS after FROM customer")
def audit_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "audit")
    c = table(spark, sf_dir, "customer")
    c.select(F.lit("rename").alias("action"), F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("entity"), F.col("c_name").alias("before"), F.upper("c_name").alias("after")).write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query("overlay_merge_scan", "SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'rejected' WHEN o_orderkey % 3 = 0 THEN 'confirmed' ELSE 'pending' END AS status FROM orders")
def overlay_merge_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Working rows with the latest of their reviews."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    first = o.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit(1).alias("at"), F.lit("confirmed").alias("status"))
    second = o.where("o_orderkey % 6 = 0").select("o_orderkey", F.lit(2).alias("at"), F.lit("rejected").alias("status"))
    return ingest.overlay(o, first.unionByName(second), "o_orderkey")


@query("staging_views", f"{_NV} SELECT CAST(count(*) AS BIGINT) AS raw, CAST(count(*) FILTER (WHERE period < '{HOLDOUT}') AS BIGINT) AS truth FROM nv")
def staging_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = narratives(spark, sf_dir)
    n.createOrReplaceTempView("staged_raw")
    n.where(F.col("period") < HOLDOUT).createOrReplaceTempView("staged_truth")
    return spark.sql("SELECT (SELECT count(*) FROM staged_raw) AS raw, (SELECT count(*) FROM staged_truth) AS truth")


# Streams and user functions


@query("stream_import_exactly_once", "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def stream_import_exactly_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that repeat rows, read as a stream in several batches: each row is learned once."""
    source, state = scratch(spark, "stream"), scratch(spark, "state")
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    e.repartition(3, "event_id").write.parquet(source)
    e.where("event_id % 4 = 0").coalesce(1).write.mode("append").parquet(source)
    learned = imports.import_stream(spark, source, e.schema, state, "event_id")
    return learned.groupBy("event_type").agg(F.count("*").alias("n"))


@query("stream_row_isolation", "SELECT event_id FROM events WHERE event_id % 9 <> 0")
def stream_row_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_id") % 9 == 0, F.lit("x")).otherwise(F.col("value").cast("string"))
    good, _ = imports.split_errors(table(spark, sf_dir, "events").withColumn("amount", text.try_cast("double")), F.col("amount").isNull())
    return good.select("event_id")


@query("snapshot_read", "SELECT CAST(count(*) AS BIGINT) AS n FROM supplier")
def snapshot_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader keeps the version of a table that it opened, whatever is appended meanwhile."""
    path, s = scratch(spark, "snapshot"), table(spark, sf_dir, "supplier")
    s.write.parquet(f"{path}/v=1")
    opened = spark.read.parquet(f"{path}/v=1")
    s.write.parquet(f"{path}/v=2")
    return opened.agg(F.count("*").alias("n"))


@query("ext_watermark_tumbling", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def ext_watermark_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return imports.tumbling_counts(e, "ts", "1 hour", "10 minutes", ["event_type"]).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query(
    "ext_session_window",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, s""",
)
def ext_session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return imports.sessions(e, "ts", "2 hours", "user_id").select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("udf_scalar", f"{_NV} SELECT txn_id, lower(raw) AS folded FROM nv")
def udf_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact fold as a registered vectorised function, called from SQL."""
    from ledgerline.functions.periods import fold

    def folded(s):
        return s.map(fold)

    spark.udf.register("fold_text_exact", F.pandas_udf(folded, "string"))
    narratives(spark, sf_dir).createOrReplaceTempView("late_narratives")
    return spark.sql("SELECT txn_id, fold_text_exact(raw) AS folded FROM late_narratives")


@query("udtf_number_tokens", f"{_NV} SELECT txn_id, unnest(regexp_extract_all(raw, '[0-9]+')) AS number FROM nv")
def udtf_number_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered table function that gives the numbers of a text, joined laterally."""
    from pyspark.sql.functions import udtf

    class NumberTokens:
        def eval(self, raw: str):
            import re

            for m in re.finditer("[0-9]+", raw or ""):
                yield (m.group(),)

    spark.udtf.register("number_tokens", udtf(NumberTokens, returnType="number string"))
    narratives(spark, sf_dir).createOrReplaceTempView("late_narratives")
    return spark.sql("SELECT txn_id, number FROM late_narratives, LATERAL number_tokens(raw)")


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("BIDV;5510000370;"), "p_name", F.lit(" tra tien nuoc"))
    return table(spark, sf_dir, "part").select("p_partkey", F.lit("bidv").alias("channel"), raw.alias("raw"), F.initcap("p_name").alias("name"))


@query("name_slot_extract", "SELECT p_partkey, p_name AS name FROM part")
def name_slot_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions learned from confirmed names, then read without them."""
    rows = _named(spark, sf_dir)
    return names.extract(rows, names.learn_positions(rows), ["p_partkey"])


@query("names_with_positions", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Nguyen Van A' ELSE p_name END AS name, CASE WHEN p_partkey % 2 = 0 THEN 'bank_field' ELSE 'learned_position' END AS source FROM part")
def names_with_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _named(spark, sf_dir)
    field = F.lit("MB.1-2-20260801-101112-3.20260801.CITY WATER SUPPLY JSC.123456.998877.7/2026.Nguyen Van A..1.")
    mixed = rows.withColumn("raw", F.when(F.col("p_partkey") % 2 == 0, field).otherwise(F.col("raw")))
    return names.with_positions(mixed, names.learn_positions(rows), "p_partkey")


@query(
    "classify_narratives",
    f"""{_NV}, f AS (SELECT *, CASE WHEN txn_id % 5 = 0 THEN regexp_extract(raw, 'HD ([0-9]+)', 1) ELSE '' END AS hd FROM nv),
    k AS (SELECT * FROM f WHERE period < '{HOLDOUT}'), q AS (SELECT * FROM f WHERE period >= '{HOLDOUT}'),
    own AS (SELECT DISTINCT cid, channel, TRUE AS mine FROM k WHERE hd = ''), people AS (SELECT cid, TRUE AS seen, bool_or(hd = '') AS written FROM k GROUP BY cid),
    alike AS (SELECT hd, channel, count(DISTINCT cid) AS m, min(cid) AS owner FROM k WHERE hd <> '' GROUP BY hd, channel),
    c AS (SELECT hd, count(DISTINCT cid) AS owners, min(cid) AS holder FROM k WHERE hd <> '' GROUP BY hd),
    r AS (SELECT txn_id, cid, owner, holder, written, CASE
        WHEN amount <= 0 THEN 'not_credit' WHEN hd = '' AND mine THEN 'memory' WHEN hd = '' AND seen THEN 'id' WHEN hd = '' THEN 'unknown_id'
        WHEN m > 1 THEN 'memory_shared' WHEN m = 1 THEN 'memory' WHEN owners IS NULL THEN 'unknown_contract' WHEN owners = 1 THEN 'contract' ELSE 'guarded' END AS reason, hd
      FROM q LEFT JOIN own USING (cid, channel) LEFT JOIN people USING (cid) LEFT JOIN alike USING (hd, channel) LEFT JOIN c USING (hd))
    SELECT txn_id AS query_id, reason, CASE WHEN reason = 'not_credit' THEN 'reject' WHEN reason IN ('memory', 'id', 'contract') THEN 'auto_accept' ELSE 'manual_check' END AS decision,
           CASE WHEN reason IN ('memory', 'id') AND hd = '' THEN cid WHEN reason = 'memory' THEN owner WHEN reason IN ('contract', 'guarded') THEN holder END AS customer_id,
           CAST(CASE reason WHEN 'memory' THEN 0.97 WHEN 'id' THEN CASE WHEN written THEN 0.98 ELSE 0.9675 END WHEN 'contract' THEN 0.96 WHEN 'guarded' THEN 0.5251 ELSE 0 END AS DOUBLE) AS score,
           CASE reason WHEN 'id' THEN cid WHEN 'contract' THEN holder WHEN 'guarded' THEN holder ELSE '' END AS leading, '' AS allocation, '' AS unallocated FROM r""",
)
def classify_narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole classification: everything before the holdout is learned, everything after it decided."""
    n = billed(spark, sf_dir).withColumn("mode", F.lit("unknown"))
    known = classify.build(n.where(F.col("period") < HOLDOUT))
    decided = classify.classify(n.where(F.col("period") >= HOLDOUT).withColumnRenamed("txn_id", "query_id"), known)
    return decided.select("query_id", "reason", "decision", "customer_id", "score", F.split("alternatives", ",")[0].alias("leading"), "allocation", "unallocated")


@query(
    "recommend_fallback",
    f"""{_NV}, f AS (SELECT *, CASE WHEN txn_id % 5 = 0 THEN regexp_extract(raw, 'HD ([0-9]+)', 1) ELSE '' END AS hd FROM nv),
    k AS (SELECT DISTINCT hd, cid FROM f WHERE period < '{HOLDOUT}'), q AS (SELECT * FROM f WHERE period >= '{HOLDOUT}'),
    first AS (SELECT hd, cid, row_number() OVER (PARTITION BY hd ORDER BY cid) AS rank FROM k WHERE hd <> '' QUALIFY rank <= 6)
    SELECT txn_id AS query_id, cid AS customer_id, CAST(CASE WHEN cid IN (SELECT cid FROM k WHERE hd = '') THEN 0.65 ELSE 0.59 END AS DOUBLE) AS score, CAST(1 AS INTEGER) AS rank FROM q WHERE hd = '' AND cid IN (SELECT cid FROM k)
    UNION ALL SELECT txn_id, first.cid, 0.55, CAST(rank AS INTEGER) FROM q JOIN first USING (hd)""",
)
def recommend_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What speaks for a customer of each held-out narrative without any candidate: written ids, confirmed texts, else the contract's first owners."""
    n = billed(spark, sf_dir).withColumn("mode", F.lit("unknown"))
    known = classify.build(n.where(F.col("period") < HOLDOUT))
    asked = classify.parsed(n.where(F.col("period") >= HOLDOUT).withColumnRenamed("txn_id", "query_id"), "query_id")
    return classify.recommend(asked, known).select("query_id", "customer_id", "score", "rank")
