"""Helpers shared by the training-data operators: shared folder, columns, components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that all executors see.

    The cluster names it in ``spark.checkpoint.dir``; a session without that setting (a test) uses its warehouse,
    which is shared as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/work-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The same rows read back from the shared folder: later jobs neither recompute them nor need the executors that made them."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have (names are compared without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of the edges ``(a, b)`` as ``(node, component)``; the component is its smallest node.

    Alternating large-star and small-star steps: each keeps the components, never lets a node's edges multiply and ends in
    stars after about log^2 steps, so long chains are no trouble. Minima are combined map-side and joined back, so that a
    hub's edges are never gathered in one task. Nodes without an edge do not appear.
    """

    def minima(e: DataFrame) -> DataFrame:
        return e.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))

    def signature(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()

    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = signature(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (both.join(minima(both), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = minima(large)  # every edge of ``large`` leads to a smaller node
        small = (large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
                                             F.col("m").alias("b")).filter("a <> b").distinct())
        edges = written(small)
        now = signature(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
