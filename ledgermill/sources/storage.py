"""Tables in and out: labelled CSV, model weights, metrics, optional models."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir; a temporary one only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="ledgermill-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, schema: StructType | None = None) -> DataFrame:
    """Cut the lineage with a table in the shared folder, which survives a lost executor; ``schema`` may name what is written as a user type."""
    path = f"{shared_dir(df.sparkSession)}/ledgermill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """A scan for work that costs much more than reading: dealt to all cores where its files are too few for them.

    Only files count, since one may be a single row group, which one task reads whatever the
    number of the scan's partitions. A table of many files is read as it is, without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(max(cores, scan.rdd.getNumPartitions())) if len(scan.inputFiles()) < cores else scan


def dealt(rows: DataFrame, many: int, each: int, *keys: str) -> DataFrame:
    """Rows by keys in partitions of about ``each`` of their ``many`` rows, at least one for each core: what a task sorts doesn't grow with the table."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(cores, -(-many // each)), *keys)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"')


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_metrics(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def save_model(path: str, **tables: DataFrame) -> None:
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame] | None:
    """The model's tables, or None where there is no model: categories then stay null."""
    try:
        return {n: spark.read.parquet(f"{path}/{n}") for n in names}
    except AnalysisException:
        return None
