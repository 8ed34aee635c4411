"""Learning as keyed state of a stream: counts, confidence and the months of each key, kept by the engine between batches.

The rules are those of ``knowledge.learn``: counts grow with every row, confidence only with strictly newer months, late
months count and change nothing else. Within one micro-batch the months of a key are taken in order. State is as large as the
distinct keys and their months; a key's rows are counted by month before anything else, so their number does not matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ledgerline.functions.values import confidence_after

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "seen long, advances long, last_period string, months long, dormant boolean"


class Learner(StatefulProcessor):
    """The state of one key: one value (seen, advances, last month, and the months with their counts).

    The months lie in the value, since each look into the state is a call out of the worker: a key costs one read and one write
    a batch, whatever its months. With ``dormant_ms`` a timer is set anew by each batch that has the key; the first later batch
    after it expires gives the key once more, as dormant, and empties its months, which frees the space of keys that no one pays
    for any more; the totals stay.
    """

    def __init__(self, keys: list[str], dormant_ms: int | None = None) -> None:
        self.keys, self.dormant_ms = keys, dormant_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", "seen long, advances long, last string, months map<string,long>")
        self.row = Row(*self.keys, "seen", "advances", "last_period", "months", "dormant")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        counts = Counter("unknown" if r["period"] is None else r["period"] for r in rows)
        seen, advances, last, months = self.total.get() or (0, None, "unknown", {})
        months = Counter(months)
        for period in sorted(counts):
            newer = period != "unknown" and (last == "unknown" or period > last)
            if advances is None:
                advances = 0
            elif newer:
                advances += 1
            last = period if newer else last
        seen += counts.total()
        months.update(counts)
        self.total.update((seen, advances, last, dict(months)))
        if self.dormant_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.dormant_ms)
        yield self.row(*key, seen, advances, last, len(months), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        seen, advances, last, _ = self.total.get()
        self.total.update((seen, advances, last, {}))
        yield self.row(*key, seen, advances, last, 0, True)

    def close(self) -> None:
        pass


def learned_stream(rows: DataFrame, keys: list[str], dormant_ms: int | None = None) -> DataFrame:
    """The changed keys of each micro-batch of a stream of (keys, period): (keys, seen, advances, last_period, months, dormant)."""
    types = StructType([rows.schema[k] for k in keys])
    out = StructType([*types, *StructType.fromDDL(_STATE)])
    grouped = rows.select(*keys, "period").groupBy(*keys)
    return grouped.transformWithState(Learner(keys, dormant_ms), out, "update", "None" if dormant_ms is None else "processingTime")


def learn_stream(spark: SparkSession, source: str, schema, keys: list[str], state_dir: str, files_per_batch: int | None = 1, dormant_ms: int | None = None, before_commit=None) -> DataFrame:
    """Learns a folder of Parquet files as a stream until none is left, and gives the state of each key.

    Each micro-batch writes its changed keys to a folder of its own number, so a batch that runs again after a failure replaces
    itself; the engine's state and the folder of what was read are in the checkpoint. ``before_commit`` is called with the
    number of a batch that has been written (for tests of failures). Without ``files_per_batch`` all new files are one batch.
    """
    changed = f"{state_dir}/changed"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{changed}/batch={number}")
        if before_commit:
            before_commit(number)

    # timers are looked at by batches with data only: with others, a run until no file is left would never end
    settings = {_PROVIDER: _ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        reader = spark.readStream.schema(schema)
        stream = (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(source)
        run = learned_stream(stream, keys, dormant_ms).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{state_dir}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return state_of(spark, state_dir, keys)


def state_of(spark: SparkSession, state_dir: str, keys: list[str]) -> DataFrame:
    """The last state of each key that a stream has written: (keys, seen, advances, last_period, months, dormant, confidence)."""
    rows = spark.read.option("basePath", f"{state_dir}/changed").parquet(f"{state_dir}/changed")
    values = F.struct(*(c for c in rows.columns if c not in (*keys, "batch")))
    # a batch gives a key once by its rows, and once more where its timer expires
    last = rows.groupBy(*keys).agg(F.max_by(values, F.struct("batch", "dormant")).alias("s")).select(*keys, "s.*")
    return last.withColumn("confidence", F.round(confidence_after(F.col("advances")), 9))
