"""Versioned Parquet storage of managed tables.

A table is a list of immutable segments (Parquet folders). A commit writes new segments and
then one numbered file of the log, ``_log/<version>.json``, which names all segments of all
tables; creating that file fails if it exists, so of two writers one wins and the other gets
``ConcurrentCommit``. Appending writes only the new rows; updates and deletes rewrite only the
segments that hold an affected row. Every path goes through Hadoop's file system interface,
so the folder may be in any store that Spark writes to.
"""

from __future__ import annotations

import json
import uuid
from copy import deepcopy
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A change: its number in the order of commits, table, operation and row.
CHANGES = "change_id long, tbl string, op string, row_id long"


class ConcurrentCommit(RuntimeError):
    """Another writer committed this version first."""


@dataclass
class TableState:
    segments: list[str] = field(default_factory=list)
    next_id: int = 1
    schema: str = ""


@dataclass
class State:
    version: int = 0
    next_change: int = 1
    tables: dict[str, TableState] = field(default_factory=dict)
    #: Folders of this commit's changes, which may still have to be published.
    changes: list[str] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps({"version": self.version, "next_change": self.next_change, "changes": self.changes, "tables": {k: vars(t) for k, t in self.tables.items()}})

    @classmethod
    def from_json(cls, text: str) -> "State":
        d = json.loads(text)
        return cls(d["version"], d["next_change"], {k: TableState(**t) for k, t in d["tables"].items()}, d["changes"])

    def copy(self) -> "State":
        return deepcopy(self)


class Files:
    """The few operations on a Hadoop file system that commits need."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self.root = root
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, folder: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(folder))) if self.exists(folder) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """False if the file exists. The text is staged and then renamed, so that a reader
        sees all of it or nothing."""
        staged = f"_staging/{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(staged), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self._fs.mkdirs(self._path(name).getParent())
        try:  # the claim: an exclusive create
            self._fs.create(self._path(f"{name}.claim"), False).close()
        except Exception:
            self._fs.delete(self._path(staged), False)
            return False
        return bool(self._fs.rename(self._path(staged), self._path(name)))

    def rename(self, a: str, b: str) -> bool:
        self._fs.mkdirs(self._path(b).getParent())
        return bool(self._fs.rename(self._path(a), self._path(b)))

    def mkdirs(self, name: str) -> None:
        self._fs.mkdirs(self._path(name))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


class Store:
    """The segments, log and changes under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.files = Files(spark, root)
        self.files.mkdirs("_changes")
        self.state = self.latest()
        self.publish()

    def latest(self) -> State:
        versions = [x for x in self.files.names("_log") if x.endswith(".json") and not x.startswith(".")]
        return State.from_json(self.files.read(f"_log/{versions[-1]}")) if versions else State()

    def commit(self, state: State) -> None:
        state.version = self.state.version + 1
        if not self.files.create(f"_log/{state.version:012d}.json", state.to_json()):
            raise ConcurrentCommit(f"version {state.version} was committed by another writer")
        self.state = state
        self.publish()

    def publish(self) -> None:
        """Makes committed changes visible to listeners. A crash between commit and this is
        mended by the next open."""
        waiting = set(self.files.names("_pending")) if self.state.changes else set()
        for name in self.state.changes:
            if name in waiting:
                self.files.rename(f"_pending/{name}", f"_changes/{name}")
        self.state.changes = []  # the next commit need not name them again

    # segments

    def write(self, df: DataFrame, table: str, indexes: tuple[tuple[str, ...], ...] = ()) -> str:
        """Writes a segment. Files are sorted by the first index, which makes its row group
        statistics selective; columns of all indexes get bloom filters for point lookups."""
        name = f"{table}/{uuid.uuid4().hex}"
        if indexes:
            df = df.sortWithinPartitions(*indexes[0])
        writer = df.write
        for column in sorted({c for names in indexes for c in names}):
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.parquet(f"{self.root}/{name}")
        return name

    def read(self, segments: list[str], schema: T.StructType, with_segment: bool = False) -> DataFrame:
        """The rows of segments; columns that a segment lacks are null. With ``with_segment``
        there is a column _segment, the segment's place in the list."""
        if not segments:
            out = self.spark.createDataFrame([], schema)
            return out.withColumn("_segment", F.lit(0)) if with_segment else out
        out = self.spark.read.schema(schema).parquet(*(f"{self.root}/{x}" for x in segments))
        if not with_segment:
            return out
        place = F.regexp_extract(F.col("_metadata.file_path"), r"([0-9a-f]{32})/[^/]*$", 1)
        known = self.spark.createDataFrame([(x.rsplit("/", 1)[1], i) for i, x in enumerate(segments)], "_name string, _segment int")
        return out.withColumn("_name", place).join(F.broadcast(known), "_name").drop("_name")

    # numbering

    def number(self, df: DataFrame, first: int, name: str, table: str) -> tuple[DataFrame, int]:
        """The rows with consecutive numbers from ``first`` in a column, and their count.

        Rows are written once with their place in their partition; the only thing that
        reaches the driver is one count for each partition."""
        staged = f"_staging/{uuid.uuid4().hex}"
        df.withColumn("_place", F.monotonically_increasing_id()).write.parquet(f"{self.root}/{staged}")
        rows = self.spark.read.parquet(f"{self.root}/{staged}")
        sizes = sorted((r[0], r[1]) for r in rows.groupBy(F.shiftright("_place", 33).alias("p")).count().collect())
        begins, at = [], first
        for p, n in sizes:
            begins.append((p, at))
            at += n
        offsets = F.broadcast(self.spark.createDataFrame(begins, "_part long, _begin long")) if begins else None
        if offsets is None:
            return rows.withColumn(name, F.lit(None).cast("long")).drop("_place"), 0
        joined = rows.withColumn("_part", F.shiftright("_place", 33)).join(offsets, "_part")
        return joined.withColumn(name, F.col("_begin") + F.col("_place").bitwiseAND((1 << 33) - 1)).drop("_place", "_part", "_begin"), at - first

    def log_changes(self, state: State, changes: DataFrame) -> int:
        """Stages the (tbl, op, row_id) rows of a commit under consecutive change numbers."""
        rows, n = self.number(changes, state.next_change, "change_id", "_changes")
        if n:
            name = f"{state.next_change:015d}-{uuid.uuid4().hex[:8]}"
            rows.select("change_id", "tbl", "op", "row_id").write.parquet(f"{self.root}/_pending/{name}")
            state.changes = [*state.changes, name]
            state.next_change += n
        return n

    def log_rows(self, state: State, rows: list[tuple[str, str, int]]) -> None:
        """The same for a few rows of the driver, in one file."""
        if rows:
            name = f"{state.next_change:015d}-{uuid.uuid4().hex[:8]}"
            numbered = [(state.next_change + i, *r) for i, r in enumerate(rows)]
            self.spark.createDataFrame(numbered, CHANGES).coalesce(1).write.parquet(f"{self.root}/_pending/{name}")
            state.changes = [*state.changes, name]
            state.next_change += len(rows)

    def trim_changes(self, before: int) -> None:
        """Deletes change folders whose numbers all lie below ``before``."""
        starts = [(int(x.split("-")[0]), x) for x in self.files.names("_changes") if not x.startswith((".", "_"))]
        ends = [s for s, _ in starts[1:]] + [self.state.next_change]
        gone = [x for (_, x), end in zip(starts, ends) if end <= before]
        for x in gone:
            self.files.delete(f"_changes/{x}")

    def vacuum(self) -> int:
        """Deletes segments and staged data that the latest version doesn't name; returns how
        many. Readers of older versions must be done."""
        kept = {s for t in self.state.tables.values() for s in t.segments}
        gone = 0
        for table in self.state.tables:
            for x in self.files.names(table):
                if f"{table}/{x}" not in kept:
                    self.files.delete(f"{table}/{x}")
                    gone += 1
        self.files.delete("_staging")
        return gone
