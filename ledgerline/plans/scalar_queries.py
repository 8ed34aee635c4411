"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import text as tx
from ledgerline.functions import values as vl
from ledgerline.plans.registry import query
from ledgerline.plans.views import FOLD, NV, narratives, stop_list, table

_FOLDED = FOLD.format("text")
_SQUEEZED = f"trim(regexp_replace({_FOLDED}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"


@query("fold_text", f"SELECT doc_id, {_FOLDED} AS folded FROM documents")
def fold_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.fold(F.col("text")).alias("folded"))


@query("reconciliation_key", f"SELECT doc_id, sha256({_SQUEEZED}) AS key FROM documents")
def reconciliation_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.reconciliation_key(F.col("text")).alias("key"))


@query("fingerprint_sha256", "SELECT doc_id, sha256(text) AS fingerprint FROM documents")
def fingerprint_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.fingerprint(F.col("text")).alias("fingerprint"))


@query(
    "text_tokens",
    f"""SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all({_FOLDED}, '[a-z]{{2,}}')),
        lambda w: w NOT IN ({stop_list(tx.STOP_WORDS)}))), ' ') AS tokens FROM documents""",
)
def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.text_tokens(F.col("text")), " ").alias("tokens"))


@query(
    "word_ngrams",
    f"""WITH w AS (SELECT item_id, regexp_extract_all({_FOLDED}, '[a-z]+') AS w FROM benchmark)
SELECT DISTINCT item_id, CAST(n AS INTEGER) AS n, array_to_string(w[i : i + n - 1], ' ') AS gram
FROM (SELECT item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM w, generate_series(2, 6) AS g(n))""",
)
def word_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select("item_id", tx.letter_words(F.col("text")).alias("w"))
    grams = words.select("item_id", F.explode(tx.word_ngrams(F.col("w"))).alias("gram"))
    return grams.select("item_id", F.size(F.split("gram", " ")).alias("n"), "gram")


@query(
    "longest_words",
    f"""WITH w AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_FOLDED}, '[a-z]+')) AS w FROM benchmark)
SELECT item_id, string_agg(w, ' ' ORDER BY length(w) DESC, w) AS words
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY length(w) DESC, w) AS r FROM w) WHERE r <= 8 GROUP BY item_id""",
)
def longest_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tx.longest_words(tx.letter_words(F.col("text")))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(words, " ").alias("words"))


@query("name_key", "SELECT p_partkey, array_to_string(regexp_extract_all(lower(p_name), '[a-z]+'), ' ') AS key FROM part")
def name_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", tx.name_key(F.col("p_name")).alias("key"))


#: Labels of banks as they are written, by order key.
_LABELS = ["Vietcombank CN", "NH TMCP VP Bank", "VP Bank Hue", "Quân Đội", "BIDV", "An Bình", "MoMo", "Công thương VN", "NN PTNT", "", "Ngân hàng lạ 12", "ShopeePay"]
_LABEL_SQL = "([" + ", ".join(f"'{x}'" for x in _LABELS) + "])[o_orderkey % 12 + 1]"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.array(*map(F.lit, _LABELS))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.get(labels, (F.col("o_orderkey") % 12).cast("int")).alias("label"))


_CHANNEL_SQL = (
    "CASE WHEN len(w) = 0 THEN 'unknown' "
    + " ".join(f"WHEN k = '{p}' OR starts_with(k, '{p} ') THEN '{c}'" for p, c in tx.CHANNEL_PHRASES.items())
    + " ELSE coalesce(CASE w[1] "
    + " ".join(f"WHEN '{a}' THEN '{c}'" for a, c in tx.CHANNELS.items())
    + " END, k) END"
)


@query(
    "channel_key",
    f"""WITH l AS (SELECT o_orderkey, regexp_extract_all({FOLD.format(_LABEL_SQL)}, '[a-z]+') AS w FROM orders),
k AS (SELECT *, array_to_string(w, ' ') AS k FROM l)
SELECT o_orderkey, {_CHANNEL_SQL} AS channel FROM k""",
)
def channel_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).select("o_orderkey", tx.channel_key(F.col("label")).alias("channel"))


@query(
    "collection_channel",
    f"""SELECT o_orderkey, CASE array_to_string(regexp_extract_all({FOLD.format(_LABEL_SQL)}, '[a-z]+'), ' ')
{" ".join(f"WHEN '{a}' THEN '{c}'" for a, c in tx.COLLECTION_CHANNELS.items())} END AS kind FROM orders""",
)
def collection_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).select("o_orderkey", tx.collection_channel(F.col("label")).alias("kind"))


_ID_TEXT = "CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN ' ' || o_custkey || ' ' WHEN 2 THEN 'KH' || o_custkey ELSE CAST(1000000 + o_custkey AS VARCHAR) END"


@query("id_key_pad", f"SELECT o_orderkey, CASE WHEN regexp_full_match(trim(v), '[0-9]{{1,6}}') THEN lpad(trim(v), 6, '0') ELSE trim(v) END AS id FROM (SELECT o_orderkey, {_ID_TEXT} AS v FROM orders)")
def id_key_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cust = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    value = F.when(key == 0, cust).when(key == 1, F.concat(F.lit(" "), cust, F.lit(" "))).when(key == 2, F.concat(F.lit("KH"), cust)).otherwise((F.col("o_custkey") + 1000000).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.id_key(value).alias("id"))


@query(
    "confirmed_ids_split",
    r"""WITH v AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_custkey || ',' || (o_orderkey % 1000) || '; ' || o_custkey
 WHEN 1 THEN o_custkey || '.0' ELSE 'ko ' || o_custkey END AS v FROM orders),
p AS (SELECT o_orderkey, list_transform(list_filter(regexp_split_to_array(trim(v), '[\s,;/+&]+'), lambda x: x <> ''),
  lambda x: regexp_replace(x, '^([0-9]{1,6})\.0+$', '\1')) AS p FROM v)
SELECT o_orderkey, CASE WHEN len(list_filter(p, lambda x: NOT regexp_full_match(x, '[0-9]{1,6}'))) = 0
  THEN (SELECT string_agg(i, ',' ORDER BY k) FROM (SELECT lpad(x, 6, '0') AS i, min(k) AS k FROM (SELECT unnest(p) AS x, generate_subscripts(p, 1) AS k) GROUP BY 1)) END AS ids FROM p""",
)
def confirmed_ids_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    value = F.when(key % 3 == 0, F.concat(cust, F.lit(","), (key % 1000).cast("string"), F.lit("; "), cust)).when(key % 3 == 1, F.concat(cust, F.lit(".0"))).otherwise(F.concat(F.lit("ko "), cust))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(tx.confirmed_ids(value), ",").alias("ids"))


@query(
    "date_parse_coalesce",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN 'ngay ' || strftime(o_orderdate, '%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT07:30:00')
 ELSE strftime(o_orderdate, '%Y-%m-%dT00:00:00') END AS iso FROM orders""",
)
def date_parse_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    forms = [F.date_format(d, "dd/MM/yyyy"), F.concat(F.date_format(d, "dd-MM-yyyy"), F.lit(" 07:30")), F.date_format(d, "dd.MM.yyyy"), F.date_format(d, "yyyy-MM-dd"), F.concat(F.lit("ngay "), F.date_format(d, "dd"))]
    value = F.get(F.array(*forms), (F.col("o_orderkey") % 5).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", vl.date_text(value).alias("iso"))


@query("excel_serial_date", "SELECT o_orderkey, strftime(DATE '1899-12-30' + CAST(o_orderkey % 60000 AS INTEGER), '%Y-%m-%d') AS day FROM orders")
def excel_serial_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", vl.serial_date(F.col("o_orderkey") % 60000).cast("string").alias("day"))


@query(
    "period_of",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m') END AS period,
 o_orderkey % 7 <> 0 AND (o_orderkey % 3 = 0 OR strftime(o_orderdate, '%Y-%m') > '1998-06') AS newer FROM orders""",
)
def period_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.when(F.col("o_orderkey") % 7 == 0, F.lit("thang 7")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    previous = F.when(F.col("o_orderkey") % 3 == 0, F.lit("unknown")).otherwise("1998-06")
    period = vl.period_of(day)
    return table(spark, sf_dir, "orders").select("o_orderkey", period.alias("period"), vl.newer_period(period, previous).alias("newer"))


@query(
    "valid_date",
    """SELECT o_orderkey, o_orderkey % 3 = 0 AS valid FROM orders""",
)
def valid_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    value = F.get(F.array(F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "dd/MM/yyyy"), F.date_format(d, "yyyy-'13'-dd")), (F.col("o_orderkey") % 3).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", vl.valid_date(value).alias("valid"))


@query(
    "month_range_expand",
    """WITH r AS (SELECT o_orderkey, date_trunc('month', o_orderdate) AS a, CAST(o_orderkey % 30 - 3 AS INTEGER) AS n FROM orders)
SELECT o_orderkey, strftime(a + to_months(CAST(k AS INTEGER)), '%m/%Y') AS month FROM (SELECT *, unnest(generate_series(0, n)) AS k FROM r WHERE n BETWEEN 0 AND 23)""",
)
def month_range_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("a"), (F.col("o_orderkey") % 30 - 3).cast("int").alias("n"))
    return o.select("o_orderkey", F.explode(vl.month_range(F.col("a"), F.add_months(F.trunc("a", "month"), F.col("n")))).alias("month"))


@query(
    "payment_period_scan",
    f"""WITH {NV} SELECT txn_id, CASE WHEN txn_id % 5 <> 0 THEN substr(raw, length(raw) - 6, 7) END AS payment_period FROM nv""",
)
def payment_period_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.regexp_extract("raw", r"(?:ky|thang)\s*((?:0[1-9]|1[0-2])/20\d{2}|(?:0[1-9]|1[0-2])/19\d{2})", 1)
    return narratives(spark, sf_dir).select("txn_id", F.when(month != "", month).alias("payment_period"))


@query(
    "parse_money_locale",
    """SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 4 THEN NULL WHEN 3 THEN -cents / 100.0 WHEN 2 THEN CAST(cents // 100 AS DOUBLE) ELSE cents / 100.0 END AS amount
FROM (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem)""",
)
def parse_money_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    whole, rest = F.floor(cents / 100).cast("long"), F.lpad((cents % 100).cast("string"), 2, "0")
    grouped = F.regexp_replace(whole.cast("string"), r"\B(?=(\d{3})+$)", ",")
    dotted = F.regexp_replace(whole.cast("string"), r"\B(?=(\d{3})+$)", ".")
    forms = [F.concat(grouped, F.lit("."), rest), F.concat(dotted, F.lit(","), rest), F.concat(dotted, F.lit(" VND")), F.concat(F.lit("("), whole.cast("string"), F.lit(","), rest, F.lit(")")), F.concat(F.lit("1.23,45"), rest)]
    value = F.get(F.array(*forms), F.col("l_linenumber") % 5)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", vl.parse_money(value).alias("amount"))


@query("csv_injection_guard", "SELECT doc_id, CASE WHEN regexp_matches(v, '^\\s*[=+@-]') THEN '''' || v ELSE v END AS safe FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '=' WHEN 1 THEN '  +' WHEN 2 THEN '@' ELSE '' END || text AS v FROM documents)")
def csv_injection_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = F.get(F.array(*map(F.lit, ("=", "  +", "@", ""))), (F.col("doc_id") % 4).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", tx.csv_safe(F.concat(lead, "text")).alias("safe"))


@query(
    "wilson_interval",
    """WITH s AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS hits, count(*) AS total FROM events GROUP BY 1),
w AS (SELECT user_id, hits, total, hits / total AS p, 1.96::DOUBLE AS z FROM s)
SELECT user_id, CAST(hits AS BIGINT) AS hits, CAST(total AS BIGINT) AS total,
 round((p + z*z/(2*total) - z * sqrt(p*(1-p)/total + z*z/(4.0*total*total))) / (1 + z*z/total), 9) AS low,
 round((p + z*z/(2*total) + z * sqrt(p*(1-p)/total + z*z/(4.0*total*total))) / (1 + z*z/total), 9) AS high,
 'unknown' AS kind FROM w""",
)
def wilson_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("hits"), F.count("*").alias("total"))
    low, high = vl.wilson(F.col("hits"), F.col("total"))
    return s.select("user_id", "hits", "total", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"), vl.slot_kind(F.col("hits"), F.col("total")).alias("kind"))


@query(
    "cosine_clipped",
    """SELECT a.vec_id, b.vec_id AS other_id, round(least(1.0, greatest(0.0, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))))), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def cosine_clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", "other_id", F.round(vl.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query(
    "vector_buckets",
    """WITH c AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(x) DESC, i) AS r FROM c)
SELECT vec_id, string_agg('v:' || i || ':' || CASE WHEN x >= 0 THEN 1 ELSE 0 END, ' ' ORDER BY r) AS buckets FROM r WHERE r <= 8 AND x <> 0 GROUP BY vec_id""",
)
def vector_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(vl.vector_buckets(F.col("embedding")), " ").alias("buckets"))


@query("round_half_up", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * l_discount / 3, 4) AS rounded FROM lineitem")
def round_half_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * F.col("l_discount") / 3, 4).alias("rounded"))


@query(
    "history_score",
    f"""WITH {NV}, s AS (SELECT cid, count(*) AS seen, count(DISTINCT period) AS months FROM nv GROUP BY cid)
SELECT cid, round(least(1.0, 0.5 * (1 - 0.8 * pow(0.7, months - 1)) + 0.5 * least(1.0, ln(1.0 + seen) / ln(10.0))), 9) AS score FROM s""",
)
def history_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = narratives(spark, sf_dir).groupBy("cid").agg(F.count("*").alias("seen"), F.count_distinct("period").alias("months"))
    return s.select("cid", F.round(vl.history_score(vl.confidence_after(F.col("months") - 1), F.col("seen")), 9).alias("score"))


@query(
    "weighted_score",
    """SELECT l_orderkey, l_linenumber, round(least(1.0, greatest(0.0, 0.30 * (l_quantity / 50) + 0.10 * (l_discount * 10) + 0.20 * (1 - l_tax) + 0.15 * (l_quantity / 100)
 + 0.15 * l_discount + 0.10 * l_tax)), 9) AS score FROM lineitem""",
)
def weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    score = vl.weighted_score(customer=q / 50, payer=d * 10, text=1 - t, structure=q / 100, number=d, history=t)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(score, 9).alias("score"))


@query("ordered_distinct", "SELECT conv_id, string_agg(role, ',' ORDER BY t) AS roles FROM (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY ALL) GROUP BY conv_id")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("t"))
    roles = F.transform(F.array_sort(F.collect_list(F.struct("t", "role"))), lambda x: x["role"])
    return turns.groupBy("conv_id").agg(F.array_join(F.array_distinct(roles), ",").alias("roles"))


@query(
    "alias_key",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE lower(p_name) || CASE WHEN p_partkey % 3 = 1 THEN ' (' || p_size || ')' ELSE '' END END AS alias FROM part""",
)
def alias_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.get(F.array(F.lit("  "), F.concat(F.lit("  ("), F.col("p_size").cast("string"), F.lit(")")), F.lit(" #!")), (F.col("p_partkey") % 3).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.alias_key(F.concat(F.lit(" "), F.col("p_name"), tail)).alias("alias"))


@query(
    "allocation_names",
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || ';' || p_brand WHEN 1 THEN p_name || '|' || p_brand ELSE '|' END AS names FROM part""",
)
def allocation_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = (F.col("p_partkey") % 3).cast("int")
    ids = F.when(kind == 0, F.array(F.lit("000001"))).otherwise(F.array(F.lit("000001"), F.lit("000002")))
    names = F.get(F.array(F.concat("p_name", F.lit(";"), "p_brand"), F.concat("p_name", F.lit(" ; "), "p_brand"), F.concat("p_name", F.lit(";a;b"))), kind)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(tx.allocation_names(ids, names), "|").alias("names"))


@query(
    "compare_names",
    """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'match' WHEN 1 THEN 'mismatch' ELSE 'missing' END AS status FROM customer""",
)
def compare_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = (F.col("c_custkey") % 3).cast("int")
    query_names = F.array(F.lit("Nguyễn Văn A"), F.col("c_mktsegment"))
    history = F.when(kind == 0, F.array(F.upper("c_mktsegment"), F.lit("nguyen van a"))).when(kind == 1, F.array(F.lit("Nguyen Van"))).otherwise(F.array(F.lit("123")))
    return table(spark, sf_dir, "customer").select("c_custkey", tx.compare_names(query_names, history).alias("status"))


@query(
    "valid_name",
    """SELECT p_partkey, p_partkey % 4 <> 1 AND p_partkey % 4 <> 3 AS valid, p_partkey % 4 = 3 AS receiver FROM part""",
)
def valid_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.get(F.array(F.col("p_name"), F.col("p_brand"), F.concat(F.lit("Đỗ Thị "), F.col("p_name")), F.lit("City Water Supply")), (F.col("p_partkey") % 4).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.valid_name(value).alias("valid"), tx.water_receiver(value).alias("receiver"))


@query(
    "portable_filename",
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name || '_' || p_size || '_.xlsx' WHEN 1 THEN '_CON.' || p_size WHEN 2 THEN repeat('é', (180 - 1 - length(p_size::VARCHAR)) // 2) || '.' || p_size
       WHEN 3 THEN 'upload' ELSE 'a_b' || p_size || '.tar.gz' END AS name FROM part""",
)
def portable_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    raws = [
        F.concat("p_name", F.lit(":"), size, F.lit("?.xlsx")), F.concat(F.lit("CON."), size), F.concat(F.lit("é" * 120), F.lit("."), size),
        F.lit(" .. "), F.concat(F.lit("a/b"), size, F.lit(".tar.gz. ")),
    ]
    raw = F.get(F.array(*raws), (F.col("p_partkey") % 5).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.portable_filename(raw).alias("name"))


@query(
    "branch_markers",
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'cs:' || p_size || ',kv:1' WHEN 1 THEN 'school:' || p_size ELSE '' END AS markers FROM part""",
)
def branch_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    value = F.get(F.array(F.concat(F.lit("KV1 Cơ sở "), size, F.lit(" cs"), size), F.concat(F.lit("Trường tiểu học số "), size), F.lit("csx 5")), (F.col("p_partkey") % 3).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(tx.branch_markers(value), ",").alias("markers"))


@query(
    "set_equality",
    """WITH a AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus)) AS s FROM orders GROUP BY 1), b AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus)) AS s FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1)
SELECT o_custkey, coalesce(a.s = b.s, FALSE) AS equal FROM a LEFT JOIN b USING (o_custkey)""",
)
def set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderstatus")).alias("a"), F.array_sort(F.collect_set(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")))).alias("b"))
    return o.select("o_custkey", (F.col("a") == F.col("b")).alias("equal"))


@query("json_codec_roundtrip", """SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || '}' AS json, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")
def json_codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.from_json("props", "k int")
    return table(spark, sf_dir, "events").select("event_id", F.to_json(parsed).alias("json"), parsed["k"].alias("k"))
