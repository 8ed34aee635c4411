"""What the corpus operators share: reading, staging, batches and bounded samples."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once in a Python worker, in bytes; a longer single text is handled alone and whole.
BATCH_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a local one only in local mode, where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="ledgerline-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Writes ``df`` to a new folder in the shared one; the table read back from there, and the folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: later plans start from files that outlive executors."""
    return written(df, label)[0]


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes folders of ``written`` that no later plan reads."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """Deals out the rows where the scan has fewer partitions than the session has cores (a single small file)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def slices(batch: pa.RecordBatch, text: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object) -> DataFrame:
    """``mapInArrow`` on batches of about ``BATCH_BYTES``.

    By its default Spark sends up to 10,000 rows or 64 MB at once, of which the executor and the worker hold copies. The session's limit is
    read when a plan runs, so it is lowered for the whole session; a lower one in plain bytes stays.
    """
    conf, limit = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(limit).lower().removesuffix("b")
    if not (now.isdigit() and 0 < int(now) <= BATCH_BYTES):
        conf.set(limit, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def map_texts(df: DataFrame, f: Callable[[pa.RecordBatch], dict[str, list]], schema: str, arrow: pa.Schema, text: str = "text") -> DataFrame:
    """``f`` turns a batch of rows into columns; batches are bounded by bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield pa.RecordBatch.from_pydict(f(part), schema=arrow)

    return in_batches(df, run, schema)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; null ids count as fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)), F.lit(0)).cast("int")


def stratified_ids(rows: DataFrame, label: str, per_label: int, most: int) -> list[tuple[int, object]]:
    """At most ``per_label`` ids of each label and ``most`` in all: the least id in each of ``per_label`` hash buckets.

    Runs as a hash aggregation of longs, so no label's rows meet in one task.
    """
    h = F.xxhash64("doc_id")
    picked = (
        rows.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col(label).alias("label"), F.pmod(h, F.lit(per_label)).alias("bucket"))
        .agg(F.min(F.col("doc_id")).alias("doc_id"))
        .orderBy("bucket", "label")
        .limit(most)
    )
    return [(r["doc_id"], r["label"]) for r in picked.collect()]


def texts_of(docs: DataFrame, ids: list[int], most_chars: int) -> dict[int, str]:
    """The texts of a bounded list of ids, without those over ``most_chars``; the least text where an id repeats."""
    kept = docs.where(F.col("doc_id").isin(ids) & F.col("text").isNotNull() & (F.length("text") <= most_chars))
    return {r["doc_id"]: r["text"] for r in kept.groupBy("doc_id").agg(F.min("text").alias("text")).collect()}


def keep_texts(df: DataFrame, keep: Callable[[list[str | None]], list[bool]], text: str = "text") -> DataFrame:
    """The rows of ``df`` whose text ``keep`` accepts, with all their columns and without a shuffle."""
    rows = spread(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield part.filter(pa.array(keep(part.column(text).to_pylist()), pa.bool_()))

    return in_batches(rows, run, rows.schema)
