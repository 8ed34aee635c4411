"""Progress of imports: counters that the engine collects while rows pass, without a job of their own."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: What an import can do with a row.
STATUSES = ("learned", "skipped", "unresolved", "failed", "duplicate")


def _counters(by: str, values: list[str], statuses: tuple[str, ...]) -> list[Column]:
    """Counts for each pair of a known value and status, and of all rows; names are places, since values can be any text."""
    one = lambda c: F.coalesce(c, F.lit(False))
    pairs = [F.count_if(one((F.col(by) == v) & (F.col("status") == s))).alias(f"c{i}_{k}") for i, v in enumerate(values) for k, s in enumerate(statuses)]
    return [F.count(F.lit(1)).alias("processed"), *pairs]


def _named(row: dict[str, int], values: list[str], statuses: tuple[str, ...]) -> dict[tuple[str, str], int]:
    return {(v, s): row[f"c{i}_{k}"] for i, v in enumerate(values) for k, s in enumerate(statuses) if row[f"c{i}_{k}"]}


class BatchProgress:
    """Counters of a batch job by ``by`` (sheets, known from the catalog) and status: read them when an action has run."""

    def __init__(self, by: str, values: list[str], statuses: tuple[str, ...] = STATUSES) -> None:
        self.by, self.values, self.statuses = by, values, statuses
        self.observation = Observation()

    def observe(self, rows: DataFrame) -> DataFrame:
        return rows.observe(self.observation, *_counters(self.by, self.values, self.statuses))

    def counts(self) -> dict[tuple[str, str], int]:
        return _named(self.observation.get, self.values, self.statuses)

    def processed(self) -> int:
        return self.observation.get["processed"]


class StreamProgress(StreamingQueryListener):
    """The same counters of a stream, by micro-batch: a batch that runs again replaces its own counts."""

    def __init__(self, name: str, by: str, values: list[str], statuses: tuple[str, ...] = STATUSES) -> None:
        self.name, self.by, self.values, self.statuses = name, by, values, statuses
        self.batches: dict[int, dict[str, int]] = {}
        self.ended = False

    def observe(self, rows: DataFrame) -> DataFrame:
        return rows.observe(self.name, *_counters(self.by, self.values, self.statuses))

    def onQueryStarted(self, event) -> None:
        self.ended = False

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(self.name)
        if found is not None:
            self.batches[event.progress.batchId] = found.asDict()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended = True

    def counts(self) -> dict[tuple[str, str], int]:
        out: Counter[tuple[str, str]] = Counter()
        for row in self.batches.values():
            out.update(_named(row, self.values, self.statuses))
        return dict(out)

    def processed(self) -> int:
        return sum(row["processed"] for row in self.batches.values())
