"""Imports that survive a kill at any point: a log of intents before the store, and marks in it.

A micro-batch is first written as an intent, then applied in one commit of the store that carries the batch's number as a
mark. After a restart the importer takes over the store in a new generation, applies what intents are left without a mark,
in order, and only then goes on reading; a batch that the source gives again is known by its mark. So whether a run dies
before the intent, after it, after the commit or before the stream's own checkpoint, each batch is applied once. A run that
was given up but still lives belongs to an older generation and cannot commit.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from ledgerline.operators.store import Snapshot, Store

Apply = Callable[[Snapshot, DataFrame], tuple[dict[str, DataFrame], dict[str, DataFrame]]]


class Importer:
    """Applies batches of a stream to a store; ``apply`` gives the upserts and deletes of a batch against a snapshot."""

    def __init__(self, store: Store, stream: str, apply: Apply) -> None:
        self.store, self.stream, self.apply = store, stream, apply
        self.intents = f"{store.path}/intents/{stream}"

    def recover(self) -> list[int]:
        """Takes over the store and applies pending intents; their numbers."""
        self.store.take_over()
        done = self.pending()
        for number in done:
            self._apply(number)
        return done

    def pending(self) -> list[int]:
        """Numbers of whole intents that no commit carries."""
        mark = self.store.snapshot().mark(self.stream)
        return [n for n in self._numbers() if n > mark]

    def take(self, batch: DataFrame, number: int) -> None:
        """One micro-batch: intent, commit, and the intent's end."""
        if number <= self.store.snapshot().mark(self.stream):
            return
        if number not in self._numbers():
            # an intent without its success file was never whole, and is written again
            batch.write.mode("overwrite").parquet(self._path(number))
        self._apply(number)

    def _apply(self, number: int) -> None:
        base = self.store.snapshot()
        rows = self.store.spark.read.parquet(self._path(number))
        upserts, deletes = self.apply(base, rows)
        self.store.commit(base, upserts, deletes, {self.stream: number})
        self.finish()

    def finish(self) -> None:
        """Deletes the intents whose batches are in the store."""
        mark = self.store.snapshot().mark(self.stream)
        for n in self._numbers():
            if n <= mark:
                self.store.fs.delete(self.store.hadoop.Path(self._path(n)), True)

    def _path(self, number: int) -> str:
        return f"{self.intents}/batch-{number:012d}"

    def _numbers(self) -> list[int]:
        path, fs = self.store.hadoop.Path, self.store.fs
        if not fs.exists(path(self.intents)):
            return []
        found = [s.getPath() for s in fs.listStatus(path(self.intents))]
        return sorted(int(m[1]) for p in found if (m := re.fullmatch(r"batch-(\d+)", p.getName())) and fs.exists(path(p, "_SUCCESS")))


def run(importer: Importer, source: str, schema, checkpoint: str, files_per_batch: int = 1) -> Snapshot:
    """Recovers, then imports a folder of Parquet files as a stream until none is left."""
    importer.recover()
    stream = importer.store.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(importer.take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return importer.store.snapshot()
