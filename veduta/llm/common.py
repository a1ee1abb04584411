"""Helpers shared by the training-data operators: shared-folder tables, size checks, components."""

from __future__ import annotations

import ctypes
import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a broadcast table may hold, by its rows' text form; beyond them the same join shuffles.
BROADCAST_BYTES = 32 << 20
#: Set while a table is written: its shuffle files go when it is done.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or, in one local process only, one of our own where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="veduta-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: Rows of an Arrow batch: documents are wide, and a batch is held on both sides of the Python boundary.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch to ``BATCH_ROWS`` rows, unless it is lower already; Python workers then hold little."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def tidy() -> None:
    """Give back what a Python worker no longer holds: workers live on from stage to stage, and so would their peaks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A task body that tidies up after its last batch."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            tidy()

    return body


class Scratch:
    """Tables written to the shared folder. They cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/veduta/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, tag: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{tag}"

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        """Write ``df`` once and read it back. The shuffle files that this takes are removed when it is written."""
        path, before = self.path(tag), self.spark.conf.get(_CLEAN_UP, "false")
        self.spark.conf.set(_CLEAN_UP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_CLEAN_UP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._veduta_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables no longer read."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table._veduta_path)
            path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan_bytes(df: DataFrame) -> int:
    """The planner's size of the plan's leaves in bytes (for a Parquet scan, its files); leaves of unknown size count as 0."""
    leaves, total = df._jdf.queryExecution().optimizedPlan().collectLeaves(), 0
    for i in range(leaves.size()):
        size = int(str(leaves.apply(i).stats().sizeInBytes()))
        total += size if size < 1 << 60 else 0
    return total


def parts_for(df: DataFrame, small: int = 2 << 20, large: int = 64 << 20, many: int = 4096, least: int = 1) -> int:
    """Partitions for a shuffle of ``df``: one per ``small`` bytes up to ``many``, then one per ``large``; never fewer than ``least``."""
    size = scan_bytes(df)
    return max(least, min(math.ceil(size / small), many), math.ceil(size / large))


def bounded(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a stored table for broadcast if its rows, measured, are within the bound in bytes."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))) + 16 * len(df.columns))).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text (bytes = characters) takes the fast built-in."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


def meet(scratch: Scratch, queries: DataFrame, targets: DataFrame, body, schema: str, block: int, load: Column | None = None) -> DataFrame:
    """``body`` on the queries and targets of each (g, tb).

    Targets of one (g, tb) are few; its queries may be many, so they are cut by id hash in blocks of about ``block`` rows (or of that much
    ``load``, a number for each row), each with its copy of the targets: no group of queries meets in one task.
    """
    n = queries.groupBy("g", "tb").agg(F.ceil(F.sum(F.lit(1.0) if load is None else load) / block).cast("long").alias("nq"))
    n = bounded(scratch.keep(n, "blocks"))
    left = queries.join(n, ["g", "tb"]).withColumn("qb", F.pmod(F.xxhash64("id"), F.col("nq"))).drop("nq")
    right = targets.join(n, ["g", "tb"]).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq") - 1))).drop("nq")
    # New column ids: both sides may come from the same table.
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)
    return left.groupBy("g", "tb", "qb").cogroup(right.groupBy("g", "tb", "qb")).applyInArrow(body, schema)


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (a > b)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    inner = large.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return inner.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b: long) as (id, root), root the smallest id.

    Alternating large-star and small-star steps, each written to the shared folder; ids without an edge have no row.
    Nothing is collected but a count and a checksum per round.
    """
    cur = scratch.keep(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges"
    )
    seen = None
    while True:
        mark = tuple(cur.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())
        if mark == seen or mark[0] == 0:
            break
        seen, old = mark, cur
        cur = scratch.keep(_stars(cur), "stars")
        scratch.drop(old)
    return cur.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(
        cur.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    )
