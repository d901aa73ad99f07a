"""Forecast of daily spend for each entity: candidates, walk-forward choice, bootstrap interval.

A series is a table of the entity's columns, ``day`` and ``y``, complete (see
complete_calendar). Folds, scores and the bootstrap are joins and aggregates; only the
seasonal smoothing is a vectorised function.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Days that forecasts and candidates need, folds, horizons, bootstrap.
MIN_DAYS, MIN_WEEKDAY, MIN_SEASONAL, SPLITS, HORIZON, NEXT, SIMULATIONS, BLOCK = 14, 28, 56, 3, 14, 30, 2000, 7
MEAN, WEEKDAY, SEASONAL = "run_rate", "weekday_mean", "holt_winters"
ORDER = [(MEAN, 0, MIN_DAYS), (WEEKDAY, 1, MIN_WEEKDAY), (SEASONAL, 2, MIN_SEASONAL)]
# Where the search for the weights of level and season begins, and the steps by which it closes in.
_GRID = [(a, g) for a in (0.02, 0.1, 0.2, 0.4, 0.7) for g in (0.02, 0.1, 0.3)]
_STEPS = [0.08, 0.04, 0.02, 0.01, 0.004]
_BOUNDS = (1e-4, 1 - 1e-4)
#: Series that are fitted together, of one length.
_TOGETHER = 64


def _responses(y: np.ndarray, a: np.ndarray, g: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
    """How the fitted values, and the states after the last day, follow from the first states and from y.

    ``y`` is (series, days), ``a`` and ``g`` (series, candidates). Smoothing is linear in its first
    level and seasons, so each of them, and y itself, is carried along as a column of its own:
    (days, series, candidates, 2 + period) and the same for level and seasons at the end.
    """
    n, days = y.shape
    width = period + 2
    level, season = np.zeros((*a.shape, width)), np.zeros((period, *a.shape, width))
    level[..., 0] = 1.0
    for k in range(period):
        season[k, ..., 1 + k] = 1.0
    fit = np.zeros((days, *a.shape, width))
    a, g = a[..., None], g[..., None]
    for t in range(days):
        s = season[t % period]
        fit[t] = level + s
        now = (1 - a) * level - a * s
        now[..., -1] += a[..., 0] * y[:, t, None]
        new = (1 - g) * s - g * now
        new[..., -1] += g[..., 0] * y[:, t, None]
        level, season[t % period] = now, new
    return fit, np.concatenate([level[None], season])


def _solved(y: np.ndarray, a: np.ndarray, g: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(squared error, first states, fitted values, last states) of each series and candidate, the first states by least squares.

    A level and seasons that differ by a constant fit alike; a slight pull to zero picks one.
    """
    fit, end = _responses(y, a, g, period)
    x, rest = np.moveaxis(fit[..., :-1], 0, 2), y[:, None, :] - np.moveaxis(fit[..., -1], 0, 2)
    gram = np.einsum("ncti,nctj->ncij", x, x) + 1e-9 * np.eye(period + 1)
    first = np.linalg.solve(gram, np.einsum("ncti,nct->nci", x, rest)[..., None])[..., 0]
    fitted = np.einsum("ncti,nci->nct", x, first)
    error = ((rest - fitted) ** 2).sum(-1)
    last = np.einsum("knci,nci->nck", end[..., :-1], first) + np.moveaxis(end[..., -1], 0, -1)
    return error, first, y[:, None, :] - rest + fitted, last


def fit_seasonal(y: np.ndarray, period: int = 7) -> dict[str, np.ndarray]:
    """Additive seasonal smoothing without trend for all rows of ``y`` (series, days): weights, errors, fits and last states.

    For given weights of level and season the first states are a least-squares problem, solved
    exactly; the two weights come from a search that begins on a grid, moves to the best
    neighbour and halves its step, within bounds. The error is never above the grid's.
    """
    n = len(y)
    a, g = (np.tile(np.array(x, float), (n, 1)) for x in zip(*_GRID, strict=True))
    rows = np.arange(n)
    error, _, _, _ = _solved(y, a, g, period)
    best = error.argmin(1)
    at = np.stack([a[rows, best], g[rows, best]], axis=1)
    moves = np.array([(i, j) for i in (0, -1, 1) for j in (0, -1, 1)], float)
    for step in _STEPS:
        for _ in range(3):
            near = np.clip(at[:, None, :] + step * moves, *_BOUNDS)
            error, _, _, _ = _solved(y, near[..., 0], near[..., 1], period)
            best = error.argmin(1)
            at = near[rows, best]
            if not best.any():
                break
    error, _, fitted, last = _solved(y, at[:, :1], at[:, 1:], period)
    return {"weights": at, "error": error[:, 0], "fitted": fitted[:, 0], "last": last[:, 0]}


def holt_winters(y: np.ndarray, horizon: int, period: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Fitted values of one series and its forecast, which isn't below zero."""
    got = fit_seasonal(np.asarray(y, float)[None], period)
    return got["fitted"][0], _ahead(got["last"], np.array([len(y)]), horizon, period)[0]


def _ahead(last: np.ndarray, days: np.ndarray, horizon: int, period: int = 7) -> np.ndarray:
    at = (days[:, None] + np.arange(horizon)) % period
    return np.maximum(last[:, :1] + np.take_along_axis(last[:, 1:], at, axis=1), 0.0)


@F.arrow_udf(returnType=T.StructType([T.StructField("fitted", T.ArrayType(T.DoubleType())), T.StructField("ahead", T.ArrayType(T.DoubleType()))]))
def _smooth(y: pa.Array, horizon: pa.Array) -> pa.Array:
    """Fits and forecasts of a batch of series; those of one length are fitted together."""
    values, ahead = y.to_pylist(), horizon.to_pylist()
    alike: dict[int, list[int]] = {}
    for k, v in enumerate(values):
        if v is not None and len(v) >= MIN_SEASONAL:
            alike.setdefault(len(v), []).append(k)
    got: list[tuple[list[float] | None, list[float] | None]] = [(None, None)] * len(values)
    for days, rows in alike.items():
        for part in (rows[k : k + _TOGETHER] for k in range(0, len(rows), _TOGETHER)):
            fits = fit_seasonal(np.array([values[k] for k in part], float))
            for k, fitted, last in zip(part, fits["fitted"], fits["last"], strict=True):
                got[k] = fitted.tolist(), _ahead(last[None], np.array([days]), ahead[k])[0].tolist()
    kind = pa.list_(pa.float64())
    return pa.StructArray.from_arrays([pa.array([x[k] for x in got], kind) for k in (0, 1)], ["fitted", "ahead"])


def numbered(series: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``t`` (0, 1, …) and ``n_days``; days are complete, so both follow from the span."""
    span = series.groupBy(*by).agg(F.min("day").alias("_lo"), F.count(F.lit(1)).alias("n_days"))
    joined = series.join(span, by) if by else series.join(F.broadcast(span), F.lit(True))
    return joined.withColumn("t", F.datediff("day", "_lo")).drop("_lo")


def folds(series: DataFrame, by: list[str], splits: int = SPLITS, horizon: int = HORIZON) -> DataFrame:
    """Entity, fold, cut, h, n_folds: training is t < cut, testing the h days from there.

    As many folds as leave 14 days to train on; failing that one of 7 days from 21 days up.
    """
    sizes = series.groupBy(*by).agg(F.count(F.lit(1)).cast("int").alias("n_days"))
    fit = F.least(F.lit(splits), F.floor((F.col("n_days") - MIN_DAYS) / horizon).cast("int"))
    sizes = sizes.withColumn("n_folds", F.when(fit >= 1, fit).when(F.col("n_days") >= MIN_DAYS + 7, 1)).withColumn("h", F.when(fit >= 1, F.lit(horizon)).otherwise(F.lit(7)))
    return sizes.filter("n_folds is not null").select(*by, "n_folds", "h", "n_days", F.explode(F.sequence(F.lit(1), "n_folds")).alias("fold")).withColumn("cut", F.col("n_days") - F.col("fold") * F.col("h")).drop("n_days")


def fold_predictions(series: DataFrame, by: list[str], seasonal: bool = True) -> DataFrame:
    """Entity, fold, n_folds, candidate, t, y, pred for every test day of every fold."""
    rows = numbered(series, by)
    plan = folds(series, by)
    paired = rows.join(plan, by) if by else rows.join(F.broadcast(plan), F.lit(True))
    paired = paired.withColumn("dow", F.weekday("day")).filter(F.col("t") < F.col("cut") + F.col("h"))
    key = [*by, "fold"]
    train, test = paired.filter("t < cut"), paired.filter("t >= cut")
    means = train.groupBy(*key).agg(F.avg("y").alias("mean"))
    weekdays = train.groupBy(*key, "dow").agg(F.avg("y").alias("dow_mean"))
    base = test.join(means, key).join(weekdays, [*key, "dow"], "left")
    common = [*by, "fold", "n_folds", "t", "y"]
    out = base.select(*common, F.lit(MEAN).alias("candidate"), F.col("mean").alias("pred"))
    out = out.unionByName(base.filter(F.col("cut") >= MIN_WEEKDAY).select(*common, F.lit(WEEKDAY).alias("candidate"), F.coalesce("dow_mean", "mean").alias("pred")))
    if seasonal:
        long = train.filter(F.col("cut") >= MIN_SEASONAL).groupBy(*key, "cut", "h").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "y"))), lambda x: x["y"]).alias("ys"))
        ahead = long.select(*key, "cut", F.posexplode(_smooth("ys", "h")["ahead"]).alias("_step", "pred")).withColumn("t", F.col("cut") + F.col("_step")).select(*key, "t", "pred")
        out = out.unionByName(test.join(ahead, [*key, "t"]).select(*common, F.lit(SEASONAL).alias("candidate"), "pred"))
    return out


def scores(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Entity, candidate, folds, n_folds and means over folds of daily MAE, daily RMSE, error of the total."""
    gap = F.col("y") - F.col("pred")
    each = predictions.groupBy(*by, "candidate", "fold", "n_folds").agg(
        F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"), (F.abs(F.sum("y") - F.sum("pred")) / F.greatest(F.sum("y"), F.lit(1.0))).alias("ape")
    )
    return each.groupBy(*by, "candidate", "n_folds").agg(F.count(F.lit(1)).alias("folds"), F.avg("mae").alias("daily_mae"), F.avg("rmse").alias("daily_rmse"), F.avg("ape").alias("horizon_total_ape"))


def select_candidate(scored: DataFrame, by: list[str]) -> DataFrame:
    """Entity, selected: the least mean daily RMSE among candidates that every fold has; ties in their order."""
    place = F.create_map(*[x for name, k, _ in ORDER for x in (F.lit(name), F.lit(k))])
    return scored.filter("folds = n_folds").groupBy(*by).agg(F.min_by("candidate", F.struct("daily_rmse", place[F.col("candidate")].alias("k"))).alias("selected"))


def residuals(series: DataFrame, by: list[str]) -> DataFrame:
    """Adds in-sample residuals of the run-rate and of the weekday mean."""
    dow = series.withColumn("dow", F.weekday("day"))
    return dow.withColumns({"res_mean": F.col("y") - F.avg("y").over(Window.partitionBy(*by)), "res_dow": F.col("y") - F.avg("y").over(Window.partitionBy(*by, "dow"))})


def forecast(series: DataFrame, by: list[str], seed: int = 42, simulations: int = SIMULATIONS) -> DataFrame:
    """One row for each entity: status, method, daily means and bands for 30 days, total and its 95 % interval.

    The total's interval is that of moving-block bootstrap totals, never the sum of daily
    bounds. Under 14 days there are no numbers. ``by`` names at least one column.
    """
    rows = numbered(series, by)
    best = select_candidate(scores(fold_predictions(series, by), by), by)
    state = rows.groupBy(*by).agg(
        F.max("n_days").alias("n_days"), F.max("day").alias("last"), F.transform(F.array_sort(F.collect_list(F.struct("t", "y", F.weekday("day").alias("dow")))), lambda x: F.struct(x["y"].alias("y"), x["dow"].alias("dow"))).alias("s")
    )
    state = state.join(best, by, "left").withColumn("method", F.when(F.col("n_days") >= MIN_DAYS, F.coalesce("selected", F.lit(MEAN))))
    ys = F.transform("s", lambda x: x["y"])
    smooth = _smooth(F.when(F.col("method") == SEASONAL, ys), F.lit(NEXT))
    state = state.withColumn("hw", smooth).withColumn("mean", F.aggregate(ys, F.lit(0.0), lambda a, x: a + x) / F.size("s"))
    by_dow = F.map_from_entries(
        F.transform(F.sequence(F.lit(0), F.lit(6)), lambda d: F.struct(d, F.aggregate(F.filter("s", lambda x: x["dow"] == d), F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("n")), lambda acc, x: F.struct((acc["a"] + x["y"]).alias("a"), (acc["n"] + 1).alias("n")), lambda acc: F.when(acc["n"] > 0, acc["a"] / acc["n"]))))
    )
    state = state.withColumn("dows", by_dow)
    future = F.sequence(F.lit(1), F.lit(NEXT))
    pick = lambda d: F.coalesce(F.try_element_at(F.col("dows"), d), F.col("mean"))
    pred = F.when(F.col("method") == SEASONAL, F.col("hw.ahead")).when(F.col("method") == WEEKDAY, F.transform(future, lambda k: pick(F.weekday(F.date_add("last", k))))).otherwise(F.transform(future, lambda k: F.col("mean")))
    fitted = F.when(F.col("method") == SEASONAL, F.col("hw.fitted")).when(F.col("method") == WEEKDAY, F.transform("s", lambda x: pick(x["dow"]))).otherwise(F.transform("s", lambda x: F.col("mean")))
    state = state.withColumns({"daily_mean": F.transform(pred, lambda x: F.greatest(x, F.lit(0.0))), "res": F.zip_with(ys, fitted, lambda a, b: a - b)})
    known = state.filter("method is not null")
    block = F.least(F.lit(BLOCK), F.size("res"))
    sims = known.select(*by, "daily_mean", "res", block.alias("b"), F.explode(F.sequence(F.lit(1), F.lit(simulations))).alias("sim"))
    start = lambda k: F.pmod(F.xxhash64(F.lit(seed), *by, F.col("sim"), F.floor(k / F.col("b"))), F.size("res") - F.col("b") + 1).cast("int")
    draw = F.transform("daily_mean", lambda m, k: F.greatest(F.lit(0.0), m + F.get("res", start(k) + F.pmod(k, F.col("b")))))
    totals = sims.select(*by, F.aggregate(draw, F.lit(0.0), lambda a, x: a + x).alias("total")).groupBy(*by).agg(F.expr("percentile(total, array(0.025, 0.975))").alias("band"))
    quantile = known.select(*by, F.explode("res").alias("r")).groupBy(*by).agg(F.expr("percentile(r, array(0.025, 0.975))").alias("q"))
    out = state.join(totals, by, "left").join(quantile, by, "left")
    band = lambda k: F.transform("daily_mean", lambda x: F.greatest(F.lit(0.0), x + F.col("q")[0]) if k == 0 else x + F.col("q")[1])
    ok = F.col("method").isNotNull()
    return out.select(
        *by, F.when(ok, "ok").otherwise("insufficient_data").alias("status"), "method", "n_days", F.when(ok, F.col("daily_mean")).alias("daily_mean"), F.when(ok, band(0)).alias("daily_lower"), F.when(ok, band(1)).alias("daily_upper"),
        F.when(ok, F.aggregate("daily_mean", F.lit(0.0), lambda a, x: a + x)).alias("discretionary"), F.col("band")[0].alias("risk_lower"), F.col("band")[1].alias("risk_upper"),
    )


def with_obligations(forecasts: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """Adds committed payments to the total and its interval; unknown totals stay null."""
    joined = forecasts.join(totals, by, "left")
    committed = F.coalesce((F.col("installments_total") + F.col("subscriptions_total")).cast("double"), F.lit(0.0))
    return joined.withColumns({"committed": committed, "total_expected": committed + F.col("discretionary"), "total_lower": committed + F.col("risk_lower"), "total_upper": committed + F.col("risk_upper")})
