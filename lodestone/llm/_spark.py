"""Spark helpers of the corpus operators: shared scratch tables, sizes, components."""

from __future__ import annotations

import atexit
import math
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from itertools import chain
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_made: list[tuple[SparkSession, str]] = []
_scratch: list["Scratch"] = []
_owner: ContextVar[str] = ContextVar("owner", default="")


def ship(spark: SparkSession) -> None:
    """Make this package importable by Python workers, once for a context."""
    sc = spark.sparkContext
    if getattr(sc, "_lodestone_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    if root.is_dir():
        to = os.path.join(tempfile.mkdtemp(prefix="lodestone-"), "lodestone_pkg.zip")
        with zipfile.ZipFile(to, "w") as z:
            for p in chain(root.rglob("*.py"), root.rglob("license_texts/*.txt")):
                z.write(p, str(p.relative_to(root.parent)))
        sc.addPyFile(to)
    sc._lodestone_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in a session without
    one, if its master is local, a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(spark.sparkContext, "_lodestone_scratch", None)
        if not base:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = spark.sparkContext._lodestone_scratch = f"file://{tempfile.mkdtemp(prefix='lodestone-shared-')}"
            _made.append((spark, base))
    return base


def drop_path(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    import shutil

    for x in _scratch:  # what the program has read of these, it has read
        if x.spark.sparkContext._jsc is not None:
            drop_path(x.spark, x.root)
        elif x.root.startswith(("/", "file:")):
            shutil.rmtree(x.root.removeprefix("file://"), ignore_errors=True)
    for _, path in _made:
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


@contextmanager
def owned(name: str) -> Iterator[None]:
    """Scratch tables written inside belong to the run ``name``, or to the run that is under
    way already."""
    before = _owner.get()
    token = _owner.set(before or name)
    try:
        yield
    finally:
        _owner.reset(token)


def clean(unless_read_by: DataFrame | None = None) -> None:
    """Deletes the scratch tables that the run under way (``owned``; outside of any, all calls
    outside) has written so far, but for those that a frame reads. Results of that run that
    weren't stored yet can't be read afterwards; those of others can."""
    read = unless_read_by.inputFiles() if unless_read_by is not None else []
    for x in list(_scratch):
        name = x.root.rsplit("/", 1)[1]
        if x.owner == _owner.get() and not any(name in f for f in read):
            _scratch.remove(x)
            drop_path(x.spark, x.root)


class Scratch:
    """Tables written to the shared folder to cut lineage: losing an executor then costs no
    more than the stage that runs."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/lodestone-{uuid.uuid4().hex}"
        self.owner = _owner.get()
        _scratch.append(self)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        drop_path(self.spark, f"{self.root}/{name}")


def fields(df: DataFrame, keep: tuple[str, ...], ddl: str) -> T.StructType:
    """The schema of kept columns of a frame followed by new ones."""
    return T.StructType([*df.select(*keep).schema.fields, *T._parse_datatype_string(ddl).fields])


def made(name: str) -> str:
    return f"made_{name}"


def carried(df: DataFrame, keep: tuple[str, ...], results: str, **columns: Column) -> tuple[DataFrame, list[str], T.StructType]:
    """A frame of the kept columns, under neutral names, and then ``made(name)`` for each of
    ``columns``; the kept columns' own names; and the schema of them followed by ``results``
    (DDL). A kept column with the name of a result gives way to it, so that no name of the
    input can clash."""
    new = T._parse_datatype_string(results).fields
    names = [c for c in keep if c.lower() not in {x.name.lower() for x in new}]
    types = df.select(*names).schema.fields
    rows = df.select(*(F.col(c).alias(f"kept_{i}") for i, c in enumerate(names)), *(c.alias(made(n)) for n, c in columns.items()))
    return rows, names, T.StructType([*types, *new])


def stored_bytes(df: DataFrame, text: str = "text") -> float:
    """About how many bytes of (compressed) storage the rows take: the plan's estimate if it
    reads one table, and measured otherwise, since estimates of joins multiply."""
    plan = df._jdf.queryExecution().optimizedPlan()
    size = float(plan.stats().sizeInBytes())
    if plan.collectLeaves().size() == 1 and size < 1e15:
        return size
    return float(df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]) / 2


def parts_for(size: float, each: float, spark: SparkSession) -> int:
    """A partition count that keeps a partition near ``each`` bytes."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(size / each))


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component): the smallest node reachable, for the nodes of (a, b) edges.

    Alternating large-star and small-star steps, each a distributed aggregation; the number
    of rounds grows with the logarithm of a component's diameter. The edge set never leaves
    the executors. Hot centres are pre-aggregated on the map side by min(), and the
    remaining per-centre rows meet in a join that Spark can split.
    """
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = scratch.put(e, f"{name}-0")

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
        joined = both.join(least, both.a == least.node).select("a", "b", "m")
        if large:  # larger neighbours point to the smallest
            return joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))  # smaller neighbours and the node itself
        own = least.select(F.col("node").alias("a"), F.col("m").alias("b"))
        return moved.union(own).where("a <> b").distinct()

    done, k = False, 0
    before = None
    while not done:
        k += 1
        e = scratch.put(star(star(e, True), False), f"{name}-{k}")
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).cast("string")).first()
        done, before = now == before, now
        scratch.drop(f"{name}-{k - 1}")
    return e.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").union(
        e.select("b", "b").distinct().toDF("node", "component")
    )
