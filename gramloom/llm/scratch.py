"""Shared-folder tables and connected components, used by several operators."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_own: dict[str, str] = {}
_written: set[str] = set()
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a fresh one of our own only under a local master where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is unset: executors and driver need a folder they share")
        app = spark.sparkContext.applicationId
        found = _own.get(app) or "file://" + tempfile.mkdtemp(prefix="spark-gramloom-")
        _own[app] = found
    return found.rstrip("/")


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession):
    """While a table is written, its own shuffle files go as soon as it is complete; the caller's setting returns."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors.

    The table stays until ``discard`` or the end of the driver's Python, which removes all that are left.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gramloom-{name}-{uuid.uuid4().hex}"
    _written.add(path)
    with _shuffles_dropped(spark):
        df.write.options(**options).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``materialize`` that nothing reads any more."""
    for table in tables:
        _remove(table.sparkSession, table.written_to)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _written.discard(path)


@atexit.register
def _remove_all() -> None:
    spark = SparkSession.getActiveSession()
    for path in list(_written) if spark is not None else []:
        with contextlib.suppress(Exception):  # the session may be gone already
            _remove(spark, path)


def spread(df: DataFrame) -> DataFrame:
    """A scanned table of texts with a task per core at least, for per-row work in Python.

    Arrow batches need no setting of ours: Spark bounds them in bytes
    (``spark.sql.execution.arrow.maxBytesPerBatch``), so long texts come a few at a time.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def with_carried(docs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """``doc_id, text`` in the operators' types, and the other columns named in ``carry``."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *[c for c in carry if c not in ("doc_id", "text")])


def carried_schema(docs: DataFrame, carry: tuple[str, ...]) -> str:
    kinds = dict(docs.dtypes)
    return "".join(f", {name} {kinds[name]}" for name in carry)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(v, component)`` for every end of an edge.

    Each round maps every vertex to the smallest vertex among itself and its
    neighbours and contracts the edges along that map, so a path at least
    halves per round.  A vertex reaches the smallest id of its component.
    Hubs cost one partially aggregated row per map task, never a group.
    """
    live = materialize(edges.where("a <> b").select("a", "b").distinct(), "edges")
    vertices = live.select(F.col("a").alias("v")).union(live.select(F.col("b").alias("v"))).distinct()
    labels = vertices.select("v", F.col("v").alias("component"))
    while not live.isEmpty():
        both = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("to")), "hook")
        labels = labels.join(step, labels.component == step.u, "left").select("v", F.coalesce("to", "component").alias("component"))
        labels = materialize(labels, "labels")
        moved = (
            live.join(step, live.a == step.u).select(F.col("to").alias("a"), "b")
            .join(step.withColumnRenamed("to", "to_b"), F.col("b") == step.u).select("a", F.col("to_b").alias("b"))
        )
        live = materialize(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return labels
