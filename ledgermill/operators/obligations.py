"""Instalments, subscriptions and the calendar of discretionary spend, for each entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse_digits, contains_ignoring_case
from ..schema import forecast_population

# Days between charges of a subscription, its spread, days that an instalment stays recent.
RHYTHM, SPREAD, RECENT = (25, 35), 0.10, 35


def rhythms(rows: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """Groups of two or more charges, all gaps within the rhythm: n, least and most, is_stable."""
    order = Window.partitionBy(*by, *key).orderBy("date")
    gaps = rows.withColumn("_gap", F.datediff("date", F.lag("date").over(order)))
    groups = gaps.groupBy(*by, *key).agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.col("_gap").between(*RHYTHM)).alias("_all"), F.min("amount").alias("least"), F.max("amount").alias("most")
    )
    stable = (F.col("most") - F.col("least")) <= F.col("most") * F.lit(SPREAD).cast("decimal(4,2)")
    return groups.filter((F.col("n") >= 2) & F.col("_all")).withColumn("is_stable", stable).drop("_all")


def components(tx: DataFrame, by: list[str]) -> DataFrame:
    """The forecast population with ``component``: installment, subscription, fee or discretionary."""
    rows = tx.filter(F.coalesce(forecast_population(), F.lit(False)))
    free = rows.filter("installment_no is null")
    keys = rhythms(free, by, ["clean_description"]).filter("is_stable").select(*by, "clean_description").withColumn("_rhythm", F.lit(True))
    joined = rows.join(keys, [*by, "clean_description"], "left")
    subscribed = F.coalesce(contains_ignoring_case(F.col("category"), "abonelik"), F.lit(False)) | F.col("_rhythm").isNotNull()
    label = F.when(F.col("installment_no").isNotNull(), "installment").when(subscribed, "subscription").when(F.col("transaction_type") == "FINANCING_FEE", "fee").otherwise("discretionary")
    return joined.withColumn("component", label).drop("_rhythm")


def _last(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def latest_installments(labelled: DataFrame, by: list[str], ties: list[str]) -> DataFrame:
    """The furthest instalment of each purchase seen within 35 days of the entity's newest one."""
    rows = labelled.filter("component = 'installment'")
    newest = rows.groupBy(*by).agg(F.max("date").alias("_newest"))
    recent = (rows.join(newest, by) if by else rows.join(F.broadcast(newest), F.lit(True))).filter(F.col("date") >= F.date_sub("_newest", RECENT))
    keyed = recent.withColumns({"_text": collapse_digits(F.col("clean_description")), "_size": F.bround("amount", 0), "_total": F.coalesce("installment_total", F.lit(-1))})
    return _last(keyed, [*by, "_text", "_total", "_size"], [F.desc("installment_no"), F.desc("date"), *[F.col(t) for t in ties]]).drop("_newest", "_text", "_size", "_total")


def known_obligations(labelled: DataFrame, by: list[str], ties: list[str]) -> DataFrame:
    """What falls due next: kind, description, amount, next_installment, installment_total, remaining_after_next."""
    none = F.lit(None).cast("int")
    parts = latest_installments(labelled, by, ties).filter(F.col("installment_total").isNull() | (F.col("installment_no") < F.col("installment_total")))
    due = parts.select(
        *by, F.lit("installment").alias("kind"), F.col("clean_description").alias("description"), "amount", (F.col("installment_no") + 1).cast("int").alias("next_installment"),
        "installment_total", (F.col("installment_total") - F.col("installment_no") - 1).cast("int").alias("remaining_after_next"),
    )
    subs = _last(labelled.filter("component = 'subscription'"), [*by, "clean_description"], [F.desc("date"), *[F.col(t) for t in ties]])
    rest = subs.select(*by, F.lit("subscription").alias("kind"), F.col("clean_description").alias("description"), "amount", none.alias("next_installment"), none.alias("installment_total"), none.alias("remaining_after_next"))
    return due.unionByName(rest)


def obligation_totals(due: DataFrame, by: list[str]) -> DataFrame:
    part = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("amount"))), F.lit(0)).cast("decimal(38,2)")
    return due.groupBy(*by).agg(part("installment").alias("installments_total"), part("subscription").alias("subscriptions_total"))


def complete_calendar(rows: DataFrame, by: list[str], day: str, value: str, span: DataFrame | None = None) -> DataFrame:
    """key, day, y: sums of ``value`` with true zeros, from the first to the last day of ``span`` (or of the rows)."""
    ends = (span if span is not None else rows).groupBy(*by).agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    days = ends.select(*by, F.explode(F.sequence("lo", "hi")).alias("day"))
    sums = rows.groupBy(*by, F.col(day).alias("day")).agg(F.sum(value).cast("double").alias("_sum"))
    return days.join(sums, [*by, "day"], "left").select(*by, "day", F.coalesce("_sum", F.lit(0.0)).alias("y"))
