"""Versioned keyed tables under one manifest.

A table is a list of segments (Parquet folders): a base and the upserts and deletions of later commits; its rows are the last
ones of each key. What a version of the whole store holds is one small manifest file, and a commit publishes a new one by a
rename that fails where the name exists already. So readers of a version see all of its tables as they were, a write that
fails on the way leaves the old version, and of two writers that started from one version the second fails. Manifests carry
marks (the last batch of each stream) and a generation: a writer that was superseded cannot commit any more.

A commit writes the rows that it changes, not the tables. ``compact`` folds segments into one, ``vacuum`` deletes folders and
manifests that no kept version needs.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_GONE, _AT = "_deleted", "_version"
#: Segments from which on a commit folds a table into one.
MOST_SEGMENTS = 8
#: Tables that a commit writes at once.
WRITERS = 4


class Conflict(RuntimeError):
    """Another writer has published a version since this one's was read."""


@dataclass(frozen=True)
class Segment:
    path: str
    version: int


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    generation: int = 0
    tables: dict[str, list[Segment]] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)
    marks: dict[str, int] = field(default_factory=dict)

    def dumps(self) -> str:
        return json.dumps(self.__dict__ | {"tables": {k: [s.__dict__ for s in v] for k, v in self.tables.items()}})

    @staticmethod
    def loads(text: str) -> Manifest:
        found = json.loads(text)
        return Manifest(**found | {"tables": {k: [Segment(**s) for s in v] for k, v in found["tables"].items()}})


class Snapshot:
    """One version of the store; tables read through it never change."""

    def __init__(self, store: Store, manifest: Manifest) -> None:
        self.store, self.manifest = store, manifest

    @property
    def version(self) -> int:
        return self.manifest.version

    def mark(self, stream: str) -> int:
        return self.manifest.marks.get(stream, -1)

    def __contains__(self, name: str) -> bool:
        return bool(self.manifest.tables.get(name))

    def table(self, name: str) -> DataFrame:
        """The rows of a table, one for each key."""
        keys = self.store.keys[name]
        rows = self._segments(name)
        if len(self.manifest.tables[name]) > 1:
            values = F.struct(*(c for c in rows.columns if c != _AT))
            rows = rows.groupBy(*keys).agg(F.max_by(values, _AT).alias("_row")).select("_row.*")
        return rows.where(~F.col(_GONE)).drop(_GONE, _AT)

    def _segments(self, name: str) -> DataFrame:
        schema = StructType.fromJson(json.loads(self.manifest.schemas[name]))
        whole = None
        for s in self.manifest.tables[name]:
            part = self.store.spark.read.schema(schema).parquet(s.path).withColumn(_AT, F.lit(s.version))
            whole = part if whole is None else whole.unionByName(part)
        return whole


class Store:
    def __init__(self, spark: SparkSession, path: str, keys: dict[str, list[str]]) -> None:
        """``keys`` names the tables and their key columns; ``path`` is a folder that the driver and all executors share."""
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.generation: int | None = None
        self.fs, self.hadoop = self._fs()

    def _fs(self):
        jvm = self.spark._jvm
        hadoop = jvm.org.apache.hadoop.fs
        return hadoop.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    # Manifests

    def _manifest_path(self, version: int) -> str:
        return f"{self.path}/manifests/{version:012d}.json"

    def versions(self) -> list[int]:
        folder = self.hadoop.Path(f"{self.path}/manifests")
        if not self.fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The version that is asked for, or the last one; an empty store is version 0."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return Snapshot(self, Manifest())
        source = self.fs.open(self.hadoop.Path(self._manifest_path(version)))
        try:
            text = bytes(source.readAllBytes()).decode()
        finally:
            source.close()
        return Snapshot(self, Manifest.loads(text))

    def publish(self, manifest: Manifest) -> Snapshot:
        """Makes a manifest the last version, or raises Conflict if its version exists."""
        part = self.hadoop.Path(f"{self.path}/manifests/_{uuid.uuid4().hex}.part")
        out = self.fs.create(part, True)
        try:
            out.write(bytearray(manifest.dumps().encode()))
        finally:
            out.close()
        context = self.hadoop.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(part, self.hadoop.Path(self._manifest_path(manifest.version)), options)
        except Exception as e:
            self.fs.delete(part, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {manifest.version} exists") from e
            raise
        return Snapshot(self, manifest)

    def take_over(self) -> Snapshot:
        """Begins a new generation: writers of earlier ones cannot commit any more."""
        now = self.snapshot().manifest
        self.generation = now.generation + 1
        return self.publish(Manifest(**now.__dict__ | {"version": now.version + 1, "generation": self.generation}))

    # Commits

    def commit(self, base: Snapshot, upserts: dict[str, DataFrame], deletes: dict[str, DataFrame] | None = None, marks: dict[str, int] | None = None) -> Snapshot:
        """Publishes the version after ``base``: rows of ``upserts`` (one for each key) replace those of their keys, keys of
        ``deletes`` go. All tables change at once or none does."""
        old = base.manifest
        if self.generation is not None and old.generation != self.generation:
            raise Conflict(f"generation {self.generation} was superseded by {old.generation}")
        version = old.version + 1
        tables, schemas = dict(old.tables), dict(old.schemas)
        changed = {name: self._changed(name, upserts.get(name), (deletes or {}).get(name), schemas) for name in {**upserts, **(deletes or {})}}
        written = {name: f"{self.path}/{name}/{version:012d}-{uuid.uuid4().hex}" for name in changed}
        try:
            # many of these jobs are small; a few at once fill the cluster
            with ThreadPoolExecutor(WRITERS) as pool:
                list(pool.map(lambda name: changed[name].write.parquet(written[name]), changed))
            for name, rows in changed.items():
                schemas[name] = rows.schema.json()
                tables[name] = [*tables.get(name, []), Segment(written[name], version)]
            done = self.publish(Manifest(version, old.generation, tables, schemas, old.marks | (marks or {})))
        except BaseException:
            for path in written.values():
                self.fs.delete(self.hadoop.Path(path), True)
            raise
        full = [n for n, s in tables.items() if len(s) >= MOST_SEGMENTS]
        return self.compact(full) if full else done

    def _changed(self, name: str, upserts: DataFrame | None, deletes: DataFrame | None, schemas: dict[str, str]) -> DataFrame:
        keys = self.keys[name]
        rows = None if upserts is None else upserts.withColumn(_GONE, F.lit(False))
        if deletes is not None:
            gone = deletes.select(*keys).distinct()
            if rows is not None:
                gone = gone.join(rows.select(*keys), keys, "left_anti")
            schema = StructType.fromJson(json.loads(schemas[name])) if name in schemas else rows.schema
            gone = gone.select(*(F.col(f.name) if f.name in keys else F.lit(f.name == _GONE).alias(_GONE) if f.name == _GONE else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
            rows = gone if rows is None else rows.unionByName(gone)
        return rows

    def compact(self, names: list[str]) -> Snapshot:
        """Folds the segments of tables into one each; versions before it keep theirs."""
        base = self.snapshot()
        tables, version = dict(base.manifest.tables), base.version + 1
        for name in names:
            path = f"{self.path}/{name}/{version:012d}-{uuid.uuid4().hex}"
            base.table(name).withColumn(_GONE, F.lit(False)).write.parquet(path)
            tables[name] = [Segment(path, version)]
        return self.publish(Manifest(**base.manifest.__dict__ | {"version": version, "tables": tables}))

    def vacuum(self, keep: int = 2) -> None:
        """Deletes all versions but the last ``keep``, and the folders that none of these needs."""
        versions = self.versions()
        kept, gone = versions[-keep:], versions[:-keep]
        needed = {self.hadoop.Path(s.path).getName() for v in kept for segments in self.snapshot(v).manifest.tables.values() for s in segments}
        for v in gone:
            self.fs.delete(self.hadoop.Path(self._manifest_path(v)), False)
        for name in self.keys:
            folder = self.hadoop.Path(f"{self.path}/{name}")
            for status in self.fs.listStatus(folder) if self.fs.exists(folder) else []:
                # a folder of a version that is not published yet may be another writer's
                if status.getPath().getName() not in needed and int(status.getPath().getName()[:12]) <= versions[-1]:
                    self.fs.delete(status.getPath(), True)
