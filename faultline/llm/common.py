"""Helpers that the operators share: shared-folder tables, Arrow batches, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch handed to Python. Texts may be long, so batches are short.
BATCH_ROWS = 1000


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a local master (tests) gets a new local folder for
    each application; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _LOCAL[context.applicationId]


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what one Arrow batch holds in a Python worker.

    Spark reads this setting when a query runs, so it has to stay set for the
    session; it only ever gets smaller, and it changes no result.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def per_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` with one output batch for each input batch."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield fn(batch)

    return df.mapInArrow(run, schema)


def spread(spark: SparkSession) -> int:
    """Partitions for a shuffle of this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable vertex of every vertex that has an edge: ``(node, root)``.

    ``edges`` has long columns ``a`` and ``b``. Each round points a vertex at
    its smallest neighbour, jumps one pointer, and contracts the edges onto
    those targets, so the graph shrinks by a constant factor at least and hot
    vertices vanish in the first round. Nothing is collected; the only value
    the driver sees is whether edges are left. Null ends and self-loops are
    ignored; no edges give an empty table.
    """
    cur = stored(
        edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    steps = []
    for _ in range(max_rounds):
        if cur.isEmpty():
            break
        down = cur.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))
        # Vertices with a smaller neighbour point at it; the others are roots of this round.
        jump = down.alias("x").join(down.alias("y"), F.col("x.up") == F.col("y.node"), "left")
        step = stored(jump.select(F.col("x.node").alias("node"), F.coalesce("y.up", "x.up").alias("up")))
        steps.append(step)
        sa, sb = step.select(F.col("node").alias("a"), F.col("up").alias("ua")), step.select(
            F.col("node").alias("b"), F.col("up").alias("ub")
        )
        moved = (
            cur.join(sb, "b", "left")
            .join(sa, "a", "left")
            .select(F.coalesce("ua", "a").alias("a"), F.coalesce("ub", "b").alias("b"))
            .filter("a <> b")
        )
        cur = stored(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if not steps:
        return edges.sparkSession.createDataFrame([], "node long, root long")
    # Follow the pointers from the last round back to the first. A vertex that others jumped to while it
    # moved itself has pointers in several rounds; they end at the same root.
    done = steps[-1].select("node", F.col("up").alias("root"))
    for step in reversed(steps[:-1]):
        later = done.select(F.col("node").alias("up"), "root")
        first = step.join(later, "up", "left").select("node", F.coalesce("root", "up").alias("root"))
        done = stored(first.unionByName(done).groupBy("node").agg(F.min("root").alias("root")))
    roots = done.select(F.col("root").alias("node")).distinct()
    return done.unionByName(roots.select("node", F.col("node").alias("root")))
