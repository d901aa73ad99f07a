"""Shared helpers: durable intermediate tables, connected components, text access."""

from __future__ import annotations

import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill.sources.storage import shared_dir


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Cut the lineage with a table in the shared folder, which survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgermill-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table made by materialize() that nothing reads any more."""
    spark = df.sparkSession
    folders = {x.rpartition("/")[0] for x in df.inputFiles()}
    for folder in folders:
        if folder.rpartition("/")[2].startswith("ledgermill-"):
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's context cleaner drop shuffle files of jobs whose results are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id of every node of an undirected graph.

    ``edges`` has two bigint columns ``a`` and ``b``; nulls and self-loops are ignored.
    Returns ``node``, ``component`` for nodes with at least one link. Each round points
    every node at its smallest neighbour, halves pointer chains, and contracts the edges;
    the edge set shrinks geometrically. Aggregates combine before the shuffle and the
    joins are plain equi-joins, so a hub is split by adaptive execution.
    """
    spark = edges.sparkSession
    live = materialize(
        edges.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    labels = None
    while not live.isEmpty():
        both = live.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(live.select(F.col("b").alias("node"), F.col("a").alias("other")))
        up = both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("up"))
        for _ in range(2):
            nxt = up.select(F.col("node").alias("up"), F.col("up").alias("up2"))
            up = up.join(nxt, "up", "left").select("node", F.coalesce("up2", "up").alias("up"))
        up = materialize(up)
        pa_, pb_ = (up.select(F.col("node").alias(c), F.col("up").alias(f"p{c}")) for c in ("a", "b"))
        live = materialize(
            live.join(pa_, "a").join(pb_, "b").filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        )
        if labels is None:
            labels = up.select("node", F.col("up").alias("component"))
        else:
            step = up.select(F.col("node").alias("component"), "up")
            labels = labels.join(step, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
    if labels is None:
        return spark.createDataFrame([], "node bigint, component bigint")
    return materialize(labels)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null gives empty bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest member) that connect what the links a-b connect."""
    if not len(a):
        return a, b
    nodes, idx = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = idx[: len(a)], idx[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]
