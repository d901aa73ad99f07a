"""Scenario mathematics: real rates, monthly rates, and regular saving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Assumed inflation, nominal yearly returns, safe withdrawal rate.
INFLATION, WITHDRAWAL = 0.30, 0.03
RETURNS = {"BIST 100 Hisse Fonu": 0.52, "Gram Altın (Darphane / Fon)": 0.45, "Para Piyasası / Mevduat Fonu": 0.40, "S&P 500 / Global Teknoloji": 0.35}


def assumptions(spark: SparkSession, returns: dict[str, float] | None = None) -> DataFrame:
    return spark.createDataFrame(list((returns or RETURNS).items()), "asset string, nominal double")


def real_rate(nominal: Column, inflation: Column) -> Column:
    """Fisher: (1 + n) / (1 + i) - 1."""
    return (1 + nominal) / (1 + inflation) - 1


def monthly_rate(yearly: Column) -> Column:
    return F.pow(1 + yearly, F.lit(1.0 / 12)) - 1


def grow(saving: Column, rate: Column, months: Column) -> Column:
    """Value after each month of paying in ``saving`` at its start: an array."""
    start = F.struct(F.lit(0.0).alias("now"), F.array().cast("array<double>").alias("curve"))

    def step(acc: Column, _: Column) -> Column:
        now = (acc["now"] + saving) * (1 + rate)
        return F.struct(now.alias("now"), F.concat(acc["curve"], F.array(now)).alias("curve"))

    return F.aggregate(F.sequence(F.lit(1), months.cast("int")), start, step, lambda acc: acc["curve"])


def final_value(saving: Column, rate: Column, months: Column) -> Column:
    """The last value of ``grow`` without its curve."""
    return F.aggregate(F.sequence(F.lit(1), months.cast("int")), F.lit(0.0), lambda acc, _: (acc + saving) * (1 + rate))


def simulate(plans: DataFrame, years: int, inflation: float = INFLATION, withdrawal: float = WITHDRAWAL, returns: dict[str, float] | None = None) -> DataFrame:
    """Each plan (``saving`` a month, ``expense`` a month or null) with each asset.

    Adds invested, nominal and real final values, passive income and the days of a month
    that it pays for. Savings must not be negative and years at least one.
    """
    if years < 1:
        raise ValueError("years must be at least 1")
    saving = F.when(F.col("saving") >= 0, F.col("saving")).otherwise(F.raise_error(F.lit("saving must not be negative")).cast("double"))
    months = F.lit(12 * years)
    # The assumptions are a parameter of a few rows.
    both = plans.withColumn("saving", saving).join(F.broadcast(assumptions(plans.sparkSession, returns)), F.lit(True))
    grown = both.withColumns(
        {
            "invested": F.round(F.col("saving") * 12 * years, 2),
            "final_nominal": F.round(final_value(F.col("saving"), monthly_rate(F.col("nominal")), months), 2),
            "final_real": F.round(final_value(F.col("saving"), monthly_rate(real_rate(F.col("nominal"), F.lit(inflation))), months), 2),
        }
    )
    income = F.col("final_real") * withdrawal / 12
    days = F.when(F.col("expense") > 0, F.least(F.lit(30.0), income / (F.col("expense") / 30)))
    return grown.withColumns({"passive_income": F.round(income, 2), "life_days": F.round(days, 2)})


def best_asset(simulated: DataFrame, by: list[str]) -> DataFrame:
    """The asset with the highest real value of each plan; ties go to the smaller name."""
    ordered = simulated.groupBy(*by).agg(F.max("final_real").alias("final_real"), F.min_by("asset", F.struct((-F.col("final_real")).alias("v"), F.col("asset"))).alias("asset"))
    return ordered.select(*by, "asset", "final_real")
