"""Connected components of large graphs: local union-find, then large-star and small-star rounds."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors; the warehouse's where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return at.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Cut lineage by a table in the shared folder."""
    path = f"{checkpoint_dir(df.sparkSession)}/grid-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    def stars() -> pa.RecordBatch:
        nodes = [x for x in list(parent) if root(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 2_000_000:  # bounded memory; a forest may go out in parts
            yield stars()
            parent.clear()
    yield stars()


def _stars(e: DataFrame) -> bool:
    """Whether every node has one edge and no root has any; then each star is a component."""
    if e.groupBy("a").count().where("count > 1").limit(1).count():
        return False
    return not e.select("b").distinct().join(e.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge (a, b); the root is the smallest node reached."""
    e = edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    e = written(e.mapInArrow(_forest, "a long, b long").distinct())
    while not _stars(e):
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        e = written(small.distinct())
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
