"""Streaming imports: exactly-once learning in micro-batches, row isolation, and windowed extensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def import_stream(spark: SparkSession, source: str, schema, state_dir: str, key: str, files_per_batch: int = 1) -> DataFrame:
    """Learns every row of a folder of Parquet files once, batch by batch, and returns the accumulated receipts.

    A batch writes to a folder of its own number, so a batch that is replayed after a failure replaces itself; rows whose
    receipt an earlier batch has are left out. The checkpoint holds what was read.
    """
    receipts = f"{state_dir}/receipts"

    def learn(batch: DataFrame, number: int) -> None:
        fresh = batch.withColumn("receipt", F.sha2(F.col(key).cast("string"), 256)).dropDuplicates(["receipt"])
        if number:
            before = spark.read.option("basePath", receipts).schema(fresh.select("receipt").schema.add("batch", "long")).parquet(receipts).where(F.col("batch") < number)
            fresh = fresh.join(before.select("receipt"), "receipt", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{receipts}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    run = stream.writeStream.foreachBatch(learn).option("checkpointLocation", f"{state_dir}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.option("basePath", receipts).parquet(receipts)


def tumbling_counts(events: DataFrame, ts: str, size: str, late: str, keys: list[str]) -> DataFrame:
    """Counts per event-time window; on a stream, rows later than ``late`` are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), *keys).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, ts: str, gap: str, key: str) -> DataFrame:
    """Sessions of each key, parted by gaps."""
    return events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))


def split_errors(rows: DataFrame, failed) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows: a bad row is set aside and stops nothing."""
    return rows.where(~failed), rows.where(failed)


