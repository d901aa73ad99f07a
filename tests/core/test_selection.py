"""Order statistics and quantiles of groups of all sizes against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgermill.operators import selection


def table(spark, seed=0):
    rng = np.random.default_rng(seed)
    groups = {
        ("a", 1): rng.normal(size=700), ("a", 2): np.repeat(3.5, 400), (None, 1): np.round(rng.exponential(size=501), 1), ("b", None): 10.0 ** rng.uniform(-12, 12, 300),
        ("c", 1): np.array([2.0]), ("d", 1): np.concatenate([np.zeros(300), rng.normal(size=2)]),
    }
    rows = [(k, n, float(x)) for (k, n), v in groups.items() for x in v]
    return groups, spark.createDataFrame([*rows, ("e", 1, None), ("a", 1, None)], "k string, n int, x double").repartition(5)


@pytest.mark.parametrize("small,bins", [(10_000, 1024), (20, 8)])
def test_ranks_of_every_group(spark, small, bins):
    groups, rows = table(spark)
    ranks = lambda n: F.array(F.lit(0).cast("bigint"), F.floor(n / 3).cast("bigint"), n - 1)
    got = {((r.k, r.n_), r.rank): (r.n, r.kth) for r in selection.order_statistics(rows.withColumnRenamed("n", "n_"), ["k", "n_"], "x", ranks, small, bins).collect()}
    want = {(g, k): (len(v), np.sort(v)[k]) for g, v in groups.items() for k in {0, len(v) // 3, len(v) - 1}}
    assert got == want


@pytest.mark.parametrize("small", [10_000, 50])
def test_quantiles(spark, small):
    groups, rows = table(spark, 1)
    rows = rows.withColumn("y", -F.col("x"))
    got = {(r.k, r.n): r for r in selection.quantiles(rows, ["k", "n"], {"p": "x", "q": "y"}, [0.5, 0.9, 1.0], small).collect()}
    assert got.keys() == {*groups, ("e", 1)} and got["e", 1].p is None
    for g, v in groups.items():
        assert got[g].p == pytest.approx(np.quantile(v, [0.5, 0.9, 1.0])) and got[g].q == pytest.approx(np.quantile(-v, [0.5, 0.9, 1.0]))
    whole = selection.quantiles(rows.filter("k = 'a'"), [], {"m": "x"}, [0.25], small).collect()
    assert [r.m for r in whole] == [[pytest.approx(np.quantile(np.concatenate([groups["a", 1], groups["a", 2]]), 0.25))]]


def test_shares_of_long_keys(spark):
    rows = spark.range(5000).select(F.pmod("id", F.lit(3)).alias("c"), F.expr("xxhash64(id) & 1152921504606846975").alias("h"))
    limits = {r.c: r.limit for r in selection.smallest_share(rows, ["c"], "h", 0.2).collect()}
    for r in rows.groupBy("c").agg(F.collect_list("h").alias("h")).collect():
        assert sum(x <= limits[r.c] for x in r.h) == math.floor(len(r.h) * 0.2 + 0.5)
    assert selection.smallest_share(rows.limit(2), ["c"], "h", 0.2).count() == 0


def test_outliers_are_the_same_by_windows_and_by_rank(spark):
    from ledgermill.operators import anomaly

    rng = np.random.default_rng(5)
    rows = [(e, i, "AB"[i % 2], float(np.round(rng.lognormal(4, 1), 2))) for e, n in (("x", 300), ("y", 60), (None, 40), ("z", 3)) for i in range(n)]
    frame = spark.createDataFrame(rows, "e string, i int, category string, amount double")
    found = []
    for small in (4096, 50):
        got = anomaly.amount_outliers(frame, ["e"], small)
        found.append({(r.e, r.i): (r.z, r.median, r.ratio, r.is_outlier, r.in_category) for r in got.collect()})
        z = {(r.e, r.i): (r.z, r.z_n, r.z_median) for r in anomaly.robust_z(frame, "amount", ["e", "category"], small=small).collect()}
        found.append(z)
    assert found[0].keys() == found[2].keys() and len(found[0]) == len(rows)
    for a, b in ((found[0], found[2]), (found[1], found[3])):
        assert all(a[k] == pytest.approx(b[k]) for k in a)


def test_large_entities_are_selected_from_twice_and_as_a_whole_only_where_asked(spark, monkeypatch):
    """Once for the medians of categories, once for their gaps; of all amounts only where a category has under five."""
    from ledgermill.operators import anomaly

    rng = np.random.default_rng(6)
    plan = [("x", "A", 120), ("x", "B", 90), ("y", "A", 80), (None, "B", 70), (None, None, 60), ("z", "A", 9)]
    rows = [(e, f"{e}{c}{i}", c, float(np.round(rng.lognormal(4, 1), 2))) for e, c, n in plan for i in range(n)]
    few = [("y", f"few{c}{i}", c, x) for c, x in (("C", 900.0), (None, 7.5)) for i in range(3)]
    calls, order = [], selection.order_statistics
    monkeypatch.setattr(selection, "order_statistics", lambda *a, **k: calls.append(a[1]) or order(*a, **k))
    for table, many in ((rows, 2), ([*rows, *few, ("x", "none", "A", None)], 4)):
        frame = spark.createDataFrame(table, "e string, i string, category string, amount double").repartition(3)
        found = []
        for small in (4096, 50):
            del calls[:]
            got = anomaly.amount_outliers(frame, ["e"], small, rows_as="n").collect()
            found.append({r.i: (r.z, r.median, r.ratio, r.is_outlier, r.in_category, r.n) for r in got})
        assert len(calls) == many and len(found[1]) == len(table) and found[0].keys() == found[1].keys()
        for key, want in found[0].items():
            assert [x is None for x in found[1][key]] == [x is None for x in want]
            assert found[1][key] == pytest.approx(want) if None not in want else found[1][key][4:] == want[4:]


def test_small_forests_that_grow_together_score_as_alone():
    """Equal to the last bit, with equal rows, constant axes, one row and as many rows as a word has bits."""
    from ledgermill.operators import isolation

    rng = np.random.default_rng(3)
    pools = [rng.normal(size=(n, 5)) for n in (1, 2, 30, 33, 64)]
    pools += [np.ones((31, 5)), np.round(rng.normal(size=(64, 5))), np.column_stack([np.arange(40.0), *np.zeros((4, 40))])]
    for pool, got in zip(pools, isolation.own_scores(pools), strict=True):
        assert np.array_equal(got, isolation.forest_score(pool, isolation.grow_forest(pool)))


def test_forests_of_entities_of_all_sizes(spark, monkeypatch):
    """Entities that stand together in a partition, over batches' ends, small ones and large ones."""
    from ledgermill.operators import isolation

    monkeypatch.setattr(isolation, "CHUNK", 300)
    rng = np.random.default_rng(4)
    rows = [(f"e{n}", k, *map(float, rng.normal(size=2))) for n in (5, 30, 31, 64, 65, 290, 700) for k in range(n)]
    frame = spark.createDataFrame(rows, "e string, k int, a double, b double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    got = {(r.e, r.k): r.iforest_score for r in isolation.forest_scores(frame, ["e"], ["a", "b"], ["k"], 30).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    ordered = frame.withColumn("h", isolation.hash_key(isolation.SEED, "k")).orderBy("e", "h", "k").toPandas()
    for name, mine in ordered.groupby("e"):
        x = mine[["a", "b"]].to_numpy()
        want = isolation.forest_score(x, isolation.grow_forest(x[: isolation.POOL])) if len(x) >= 30 else np.zeros(len(x))
        assert [got[name, k] for k in mine["k"]] == pytest.approx(want)
