"""Seasonal smoothing against a plain recursion, a fine grid and series whose answer is known."""

import datetime as dt

import numpy as np
import pytest

from ledgermill.operators import forecast


def plain(y, a, g, level, season):
    season, fit = list(season), []
    for t, v in enumerate(y):
        s = season[t % 7]
        fit.append(level + s)
        now = a * (v - s) + (1 - a) * level
        season[t % 7] = g * (v - now) + (1 - g) * s
        level = now
    return np.array(fit), np.array([level, *season])


def heuristic(y):
    """The least error on the grid with first states from the first two weeks."""
    level = y[:14].mean()
    season = np.array([(y[k::7][:2] - level).mean() for k in range(7)])
    season -= season.mean()
    return min(((plain(y, a, g, level, season)[0] - y) ** 2).sum() for a, g in forecast._GRID)


def series(n=90, seed=0, noise=20):
    rng = np.random.default_rng(seed)
    return np.maximum(0, 300 + 80 * np.sin(2 * np.pi * np.arange(n) / 7) + np.cumsum(rng.normal(0, 4, n)) + rng.normal(0, noise, n))


def test_fit_is_a_run_of_the_recursion():
    y = np.stack([series(seed=k) for k in range(5)])
    got = forecast.fit_seasonal(y)
    for k, row in enumerate(y):
        error, first, fitted, last = (x[0, 0] for x in forecast._solved(row[None], got["weights"][k : k + 1, :1], got["weights"][k : k + 1, 1:], 7))
        fit, end = plain(row, *got["weights"][k], first[0], first[1:])
        assert fit == pytest.approx(fitted) and end == pytest.approx(last) and got["fitted"][k] == pytest.approx(fit)
        assert got["error"][k] == pytest.approx(((fit - row) ** 2).sum())


@pytest.mark.parametrize("seed", range(6))
def test_error_is_never_above_the_grids_and_close_to_the_least(seed):
    y = series(70 + 7 * seed, seed, noise=5 + 15 * seed)
    got = forecast.fit_seasonal(y[None])
    fine = np.array([(a, g) for a in np.linspace(0.001, 0.98, 25) for g in np.linspace(0.001, 0.98, 25)])
    error = forecast._solved(y[None], fine[None, :, 0], fine[None, :, 1], 7)[0]
    assert got["error"][0] <= heuristic(y) + 1e-6 and got["error"][0] <= error.min() * 1.01
    assert (got["weights"] >= 1e-4).all() and (got["weights"] <= 1 - 1e-4).all()


def test_known_series():
    week = np.array([10.0, 0, 0, 50, 20, 5, 90])
    fitted, ahead = forecast.holt_winters(np.tile(week, 12), 10)
    assert fitted == pytest.approx(np.tile(week, 12), abs=1e-3) and ahead == pytest.approx(np.tile(week, 2)[:10], abs=1e-3)
    _, flat = forecast.holt_winters(np.zeros(60), 5)
    assert flat == pytest.approx(np.zeros(5), abs=1e-9)
    step = np.concatenate([np.full(60, 10.0), np.full(40, 30.0)])
    assert forecast.holt_winters(step, 7)[1] == pytest.approx(np.full(7, 30.0), abs=2)


def test_series_of_all_lengths_in_one_batch(spark):
    rows = {k: series(n, k) for k, n in enumerate([30, 56, 57, 90, 90, 120])}
    frame = spark.createDataFrame([(k, dt.date(2026, 1, 1) + dt.timedelta(int(t)), float(v[t])) for k, v in rows.items() for t in range(len(v))], "k int, day date, y double")
    scored = forecast.scores(forecast.fold_predictions(frame, ["k"]), ["k"])
    seasonal = {r.k: r for r in scored.filter("candidate = 'holt_winters'").collect()}
    for k, y in rows.items():
        n = len(y)
        splits = min(3, (n - 14) // 14)
        cuts = [n - f * 14 for f in range(1, splits + 1) if n - f * 14 >= forecast.MIN_SEASONAL]
        assert (k in seasonal) == bool(cuts)
        if cuts:
            mae = [np.abs(forecast.holt_winters(y[:c], 14)[1] - y[c : c + 14]).mean() for c in cuts]
            assert seasonal[k].daily_mae == pytest.approx(np.mean(mae)) and seasonal[k].folds == len(cuts)
