"""Aggregates of transactions for every entity at once: ``by`` names the entity's columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import copilot_refund, copilot_spend, dashboard_spend

WIDE = "decimal(38,2)"
OTHER = "Other"


def total(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast(WIDE)


def kpis(tx: DataFrame, by: list[str]) -> DataFrame:
    """Spend, rows, flagged rows where there is a flag, and the category with the highest spend."""
    flagged = F.count_if(F.col("is_anomaly")) if "is_anomaly" in tx.columns else F.lit(None).cast("bigint")
    counts = tx.groupBy(*by).agg(total(F.when(dashboard_spend(), F.col("amount"))).alias("spend"), F.count(F.lit(1)).alias("n"), flagged.alias("n_anomalies"))
    top = spend_by(tx.filter(dashboard_spend()), by, "category").groupBy(*by).agg(F.min_by("category", F.struct((-F.col("total")).alias("t"), F.col("category"))).alias("top_category"))
    return counts.join(top, by, "left") if by else counts.join(F.broadcast(top), F.lit(True), "left")


def spend_by(tx: DataFrame, by: list[str], key: str) -> DataFrame:
    return tx.groupBy(*by, key).agg(total(F.col("amount")).alias("total"), F.count(F.lit(1)).alias("n"))


def ranked(totals: DataFrame, by: list[str], key: str) -> DataFrame:
    """Adds ``rank`` by falling total within an entity, ties by key."""
    return totals.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("total"), key)))


def top_k(totals: DataFrame, by: list[str], key: str, k: int) -> DataFrame:
    """The k largest totals with their rank; without ``by`` only those k rows meet in one task."""
    if by:
        return ranked(totals, by, key).filter(F.col("rank") <= k)
    few = totals.orderBy(F.desc("total"), key).limit(k)
    return few.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total"), key)))


def top_n_with_other(totals: DataFrame, by: list[str], key: str, n: int = 7) -> DataFrame:
    """The n largest totals and one row for the rest, last and named after their number."""
    if not by:
        top = top_k(totals, by, key, n)
        sums = lambda rows, tag: rows.agg(F.count(F.lit(1)).alias(f"n_{tag}"), F.coalesce(F.sum("total"), F.lit(0)).alias(f"t_{tag}"))
        rest = sums(totals, "all").join(F.broadcast(sums(top, "top")), F.lit(True)).filter("n_all > n_top")
        name = F.concat(F.lit(OTHER + " ("), F.col("n_all") - F.col("n_top"), F.lit(")")).alias(key)
        return top.select("rank", key, "total").unionByName(rest.select(F.lit(n + 1).alias("rank"), name, (F.col("t_all") - F.col("t_top")).cast(WIDE).alias("total")))
    every = Window.partitionBy(*by)
    rows = ranked(totals, by, key).withColumn("_left", F.greatest(F.count(F.lit(1)).over(every) - n, F.lit(0)))
    label = F.when(F.col("rank") <= n, F.col(key)).otherwise(F.concat(F.lit(OTHER + " ("), F.col("_left"), F.lit(")")))
    return rows.groupBy(*by, F.least("rank", F.lit(n + 1)).alias("rank"), label.alias(key)).agg(F.sum("total").cast(WIDE).alias("total"))


def colour_slots(top: DataFrame, key: str, n: int = 7) -> DataFrame:
    """A palette place (from 0) for each rank, round the palette; the row for the rest takes none."""
    return top.withColumn("slot", F.when(~F.col(key).startswith(OTHER), F.pmod(F.col("rank") - 1, F.lit(n))))


def top_merchants(tx: DataFrame, by: list[str], n: int) -> DataFrame:
    spent = spend_by(tx, by, "clean_description")
    return top_k(spent, by, "clean_description", n).drop("rank")


def with_aggregates(rows: DataFrame, by: list[str], **values: Column) -> DataFrame:
    """Adds each entity's aggregates to its rows; null is an entity, and without ``by`` all rows are one."""
    keys = [f"_by{k}" for k in range(len(by))]
    sums = rows.groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]).agg(*[v.alias(n) for n, v in values.items()])
    if not by:
        return rows.join(F.broadcast(sums), F.lit(True))
    same = F.lit(True)
    for c, k in zip(by, keys, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(k))
    return rows.join(sums, same).drop(*keys)


def relative_frequency(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """Each key's share of its entity's rows."""
    counts = df.groupBy(*by, key).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def summary(tx: DataFrame, by: list[str]) -> DataFrame:
    """Spend, refunds and rows."""
    return tx.groupBy(*by).agg(total(F.when(copilot_spend(), F.col("amount"))).alias("total_spend"), total(F.when(copilot_refund(), -F.col("amount"))).alias("total_refunds"), F.count(F.lit(1)).alias("transaction_count"))


def category_spend(tx: DataFrame, by: list[str]) -> DataFrame:
    """Gross, refunds, net, rows and percent of all spend, for each category."""
    rows = tx.groupBy(*by, "category").agg(
        total(F.when(copilot_spend(), F.col("amount"))).alias("gross_spend"), total(F.when(copilot_refund(), -F.col("amount"))).alias("refunds"), F.count_if(copilot_spend()).alias("transaction_count")
    )
    whole = F.sum("gross_spend").over(Window.partitionBy(*by)).cast("double")
    share = F.when(whole > 0, F.round(100 * F.col("gross_spend").cast("double") / whole, 1)).otherwise(F.lit(0.0))
    return rows.withColumn("net_spend", (F.col("gross_spend") - F.col("refunds")).cast(WIDE)).withColumn("share_pct", share)
