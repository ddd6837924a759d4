"""Tables that are merged into: immutable folders of Parquet, and manifests that publish them.

A manifest lists, for every table and partition value, the folders that hold it. A merge reads the partitions that its rows
touch, writes them anew beside the old ones and publishes the next manifest by a rename that fails if somebody
else was first; then the merge is done again on what they left. Readers keep the snapshot that they began with,
whole merges of several tables appear at once, and an interrupted merge leaves nothing but unlisted folders, which
vacuum() deletes. A writer's batches are numbered, so one that is repeated after a failure changes nothing.

Partition values are few, such as node labels and edge types; their number, not that of rows, bounds a manifest.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Times that a merge is done again because another was published first.
RETRIES = 20
_MANIFEST = re.compile(r"^(\d{20})\.json$")


class Outdated(RuntimeError):
    """Another merge was published first."""


@dataclass
class Snapshot:
    """A published state: version, folders by table and partition value, schemas by table, and the last batch of each writer."""

    version: int = 0
    tables: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    schemas: dict[str, dict] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


@dataclass
class Change:
    """Rows for a table, merged by `keys` within the partitions of column `by`.

    Of rows with equal keys the one with the largest seq counts. With `keep`, a null says nothing: each
    property has its last value that isn't null, old ones included. Without, the whole row is replaced. Without keys,
    rows are appended as they are. New rows may lack columns of the table, and bring new ones.
    """

    table: str
    rows: DataFrame
    by: str
    keys: Sequence[str] = ()
    seq: str | None = None
    keep: bool = False


class Versions:
    """The tables under a path that the driver and all executors reach."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = self.jvm.org.apache.hadoop.fs.Path(self.path)
        self.files = self.root.getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        folder = self._path("_manifests")
        if not self.files.exists(folder):
            return []
        return sorted(int(m[1]) for s in self.files.listStatus(folder) if (m := _MANIFEST.match(s.getPath().getName())))

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The last published state, or that of a version; version 0 has no tables."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version == 0:
            return Snapshot()
        stream = self.files.open(self._path(f"_manifests/{version:020d}.json"))
        try:
            return Snapshot(**json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()))
        finally:
            stream.close()

    def read(self, table: str, parts: Sequence[str] | None = None, at: Snapshot | None = None) -> DataFrame:
        """A table, or those partition values of it, in a snapshot."""
        at = at or self.snapshot()
        schema = StructType.fromJson(at.schemas[table])
        own = at.tables.get(table, {})
        folders = [f"{self.path}/{f}" for part in (own if parts is None else [p for p in parts if p in own]) for f in own[part]]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _publish(self, state: Snapshot) -> None:
        target = self._path(f"_manifests/{state.version:020d}.json")
        draft = self._path(f"_drafts/{uuid.uuid4().hex}.json")
        stream = self.files.create(draft, True)
        stream.write(bytearray(json.dumps(state.__dict__).encode()))
        stream.close()
        self.files.mkdirs(target.getParent())
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.root.toUri(), self.conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self.files.makeQualified(draft), self.files.makeQualified(target), none)
        except Py4JJavaError as e:
            self.files.delete(draft, False)
            if "FileAlreadyExistsException" in str(e.java_exception) or self.files.exists(target):
                raise Outdated(f"version {state.version} of {self.path} is published") from None
            raise

    def _merged(self, change: Change, state: Snapshot) -> tuple[DataFrame, list[str]]:
        """The new rows of all partitions that the change touches, and the values of these."""
        rows = change.rows.filter(F.col(change.by).isNotNull())
        parts = sorted(str(r[0]) for r in rows.select(change.by).distinct().collect())
        seq = change.seq
        fresh = rows.drop(seq) if seq else rows
        if change.keys:
            rest = [c for c in fresh.columns if c not in (*change.keys, change.by)]
            order = F.col(seq) if seq else F.lit(0)
            last = {c: F.max_by(c, F.when(F.col(c).isNotNull() | F.lit(not change.keep), order)) for c in rest}
            fresh = rows.groupBy(change.by, *change.keys).agg(*[v.alias(c) for c, v in last.items()], F.lit(True).alias("__new"))
        if not change.keys:
            return fresh, parts
        if change.table not in state.schemas:
            return fresh.drop("__new"), parts
        old = self.read(change.table, parts, state)
        on = [change.by, *change.keys]
        a, b = old.alias("a"), fresh.alias("b")
        met = a.join(b, [F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in on], "full_outer")

        def value(c: str):
            if c not in old.columns:
                return F.col(f"b.`{c}`")
            if c not in fresh.columns:
                return F.col(f"a.`{c}`")
            mine, theirs = F.col(f"b.`{c}`"), F.col(f"a.`{c}`")
            return F.coalesce(mine, theirs) if c in on or change.keep else F.when(F.col("b.__new"), mine).otherwise(theirs)

        names = [*old.columns, *[c for c in fresh.columns if c not in old.columns and c != "__new"]]
        return met.select(*[value(c).alias(c) for c in names]), parts

    def merge(self, changes: Sequence[Change], writer: str | None = None, batch: int = 0) -> int:
        """Publish all changes together and return the version; a batch of a writer that is known already changes nothing."""
        for _ in range(RETRIES):
            state = self.snapshot()
            if writer is not None and state.batches.get(writer, -1) >= batch:
                return state.version
            tables = {t: dict(p) for t, p in state.tables.items()}
            schemas = dict(state.schemas)
            for change in changes:
                rows, parts = self._merged(change, state)
                name = f"{change.table}/{uuid.uuid4().hex}"
                # sorted by key, so row groups can be skipped
                ordered = rows.sortWithinPartitions(change.by, *(change.keys or ()))
                ordered.withColumn("__part", F.col(change.by)).write.partitionBy("__part").parquet(f"{self.path}/{name}")
                own = tables.setdefault(change.table, {})
                escaped = {r: f"{name}/{r}" for r in (s.getPath().getName() for s in self.files.listStatus(self._path(name)) if s.isDirectory())}
                for part in parts:
                    folder = escaped[f"__part={self.jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(part)}"]
                    own[part] = [folder] if change.keys else [*own.get(part, []), folder]
                known = StructType.fromJson(schemas[change.table]) if change.table in schemas else StructType()
                schemas[change.table] = StructType([*known.fields, *[f for f in rows.schema.fields if f.name not in known.names]]).jsonValue()
            batches = state.batches | ({writer: batch} if writer is not None else {})
            try:
                self._publish(Snapshot(state.version + 1, tables, schemas, batches))
                return state.version + 1
            except Outdated:
                continue
        raise Outdated(f"{self.path} was changed by others {RETRIES} times in a row")

    def vacuum(self, keep: int = 1) -> int:
        """Forget all but the last versions and delete what only these listed, or nobody; how many folders went. No merge may run meanwhile."""
        known = self.versions()
        for version in known[:-keep] if keep else known:
            self.files.delete(self._path(f"_manifests/{version:020d}.json"), False)
        used = {f.split("/")[1] for v in self.versions() for parts in self.snapshot(v).tables.values() for folders in parts.values() for f in folders}
        gone = 0
        for top in self.files.listStatus(self.root):
            if not top.getPath().getName().startswith("_"):
                for folder in self.files.listStatus(top.getPath()):
                    if folder.getPath().getName() not in used:
                        self.files.delete(folder.getPath(), True)
                        gone += 1
        self.files.delete(self._path("_drafts"), True)
        return gone


def merge_available(spark: SparkSession, source: str, tables: Versions, table: str, by: str, keys: Sequence[str], seq: str, checkpoint: str, keep: bool = True, fmt: str = "parquet") -> None:
    """Merge the rows of new files in source into a table, a batch of the stream after the other; one that is repeated after a failure changes nothing."""
    schema = spark.read.format(fmt).load(source).schema

    def put(rows: DataFrame, number: int) -> None:
        tables.merge([Change(table, rows, by, keys, seq, keep)], checkpoint, number)

    query = spark.readStream.format(fmt).schema(schema).load(source).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
