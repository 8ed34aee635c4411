from pyspark.sql import functions as F

from ledgerline.functions import text as tx


def test_long_names_are_cut_between_characters_without_a_search(spark):
    rows = [("é" * 120 + ".1",), ("漢" * 80 + ".xlsx",), ("😀" * 60,), ("a" + "é" * 100,), ("x" * 400 + ".txt",), ("short.txt",), ("x." + "y" * 300,), (None,)]
    got = spark.createDataFrame(rows, "s string").select("s", tx.portable_filename(F.col("s")).alias("name"))
    assert "lambdafunction" not in got._jdf.queryExecution().executedPlan().toString()
    want = ["é" * 89 + ".1", "漢" * 58 + ".xlsx", "😀" * 45, "a" + "é" * 89, "x" * 176 + ".txt", "short.txt", None, None]
    assert [r.name for r in got.collect()] == want
