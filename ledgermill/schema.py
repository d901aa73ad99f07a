"""Schemas of transactions and statements, defaults for absent columns, spend predicates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
TX_SCHEMA = T.StructType(
    [
        T.StructField("statement", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("raw_description", T.StringType()),
        T.StructField("clean_description", T.StringType()),
        T.StructField("amount", MONEY),
        T.StructField("currency", T.StringType()),
        T.StructField("installment_no", T.IntegerType()),
        T.StructField("installment_total", T.IntegerType()),
        T.StructField("transaction_type", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)
TRANSACTION_TYPES = ("EXPENSE", "INSTALLMENT", "REFUND", "PAYMENT", "FINANCING_FEE", "POINT_REDEMPTION")
#: What analytics assume for a column that a table lacks.
DEFAULTS: dict[str, tuple[object, str]] = {
    "statement": ("", "string"),
    "date": (None, "date"),
    "clean_description": ("", "string"),
    "category": ("Diğer / Belirsiz", "string"),
    "amount": (0, "decimal(18,2)"),
    "installment_no": (None, "int"),
    "installment_total": (None, "int"),
    "transaction_type": ("EXPENSE", "string"),
}


def ensure_columns(df: DataFrame, defaults: dict[str, tuple[object, str]] = DEFAULTS) -> DataFrame:
    """The table with absent columns filled by defaults; the others stay as they are."""
    return df.withColumns({c: F.lit(v).cast(t) for c, (v, t) in defaults.items() if c not in df.columns})


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# The spend predicates differ on purpose; each belongs to one consumer.


def _no_type(*kinds: str) -> Column:
    return ~F.coalesce(F.col("transaction_type"), F.lit("")).isin(*kinds)


def dashboard_spend() -> Column:
    return F.col("amount") > 0


def copilot_spend() -> Column:
    return (F.col("amount") > 0) & _no_type("PAYMENT", "POINT_REDEMPTION")


def copilot_refund() -> Column:
    return (F.col("amount") < 0) & _no_type("PAYMENT")


def forecast_population() -> Column:
    return F.col("date").isNotNull() & F.col("amount").isNotNull() & (F.col("amount") > 0) & _no_type("REFUND", "PAYMENT", "POINT_REDEMPTION")


def anomaly_spend() -> Column:
    return (F.col("amount") > 0) & F.col("transaction_type").isin("EXPENSE", "INSTALLMENT", "FINANCING_FEE")


def checksum_rows(has_previous_balance: Column) -> Column:
    return has_previous_balance | _no_type("PAYMENT")


def tx_of(spark: SparkSession, sf_dir: str, spread: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Transactions bound to the order tables; ``row_id`` columns break ties. ``spread`` may deal the lines out for work that costs much."""
    lines = read(spark, sf_dir, "lineitem")
    lines = spread(lines) if spread else lines
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(parts, lines["l_partkey"] == parts["p_partkey"])
    kind = (
        F.when(F.col("l_returnflag") == "R", "REFUND")
        .when(F.col("o_orderpriority") == "1-URGENT", "INSTALLMENT")
        .when(F.col("o_orderpriority") == "5-LOW", "FINANCING_FEE")
        .otherwise("EXPENSE")
    )
    most = F.expr("max(l_linenumber) over (partition by l_orderkey)")
    return joined.withColumn("transaction_type", kind).withColumn("lines", most).select(
        F.col("o_custkey").cast("string").alias("statement"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("p_name").alias("clean_description"),
        F.col("p_type").alias("category"),
        F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice").cast(MONEY)).otherwise(F.col("l_extendedprice").cast(MONEY)).cast(MONEY).alias("amount"),
        "transaction_type",
        F.when(F.col("transaction_type") == "INSTALLMENT", F.col("l_linenumber")).cast("int").alias("installment_no"),
        F.when(F.col("transaction_type") == "INSTALLMENT", F.col("lines")).cast("int").alias("installment_total"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    )


TX_SQL = """
tx AS (
  SELECT statement, date, clean_description, category, amount, transaction_type,
         CAST(CASE WHEN transaction_type = 'INSTALLMENT' THEN l_linenumber END AS INTEGER) AS installment_no,
         CAST(CASE WHEN transaction_type = 'INSTALLMENT' THEN n_lines END AS INTEGER) AS installment_total,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice
  FROM (
    SELECT CAST(o_custkey AS VARCHAR) AS statement, CAST(l_shipdate AS DATE) AS date, p_name AS clean_description, p_type AS category,
           CAST(CASE WHEN l_returnflag = 'R' THEN -CAST(l_extendedprice AS DECIMAL(18,2)) ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS DECIMAL(18,2)) AS amount,
           CASE WHEN l_returnflag = 'R' THEN 'REFUND' WHEN o_orderpriority = '1-URGENT' THEN 'INSTALLMENT'
                WHEN o_orderpriority = '5-LOW' THEN 'FINANCING_FEE' ELSE 'EXPENSE' END AS transaction_type,
           max(l_linenumber) OVER (PARTITION BY l_orderkey) AS n_lines, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  )
)
"""
