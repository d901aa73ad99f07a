"""Reasons in words, with the forest's kind among them."""

import datetime as dt

import duckdb
import numpy as np

from ledgermill.plans import transactions


def made(spark, folder):
    """A customer with a history and forty like charges, and one that is odd in amount, merchant and day together but under the amounts' own limit."""
    rng = np.random.default_rng(3)
    orders = [(k, 7, "3-MEDIUM") for k in range(100)]
    parts = [(1, "usual", "kind"), (2, "odd", "kind")]
    day = lambda k: dt.datetime(1996, 1, 1) + dt.timedelta(days=int(k))
    gap = np.concatenate([np.linspace(-0.45, 0.45, 40), [0.0]])
    lines = [(k, 1, 1, 1, 1.0, round(float(np.exp(5 + gap[k])), 2), "N", day(7 * k)) for k in range(40)]
    mad = float(np.median(np.abs(gap)))
    lines.append((40, 1, 2, 1, 1.0, round(float(np.exp(5 + 3.3 / 0.6745 * mad)), 2), "N", day(7 * 20 + 3)))
    lines += [(50 + k, 1, 1, 1, 1.0, round(float(rng.uniform(50, 900)), 2), "N", day(-7 * k - 7)) for k in range(25)]
    tables = {
        "orders": (orders, "o_orderkey bigint, o_custkey bigint, o_orderpriority string"),
        "part": (parts, "p_partkey bigint, p_name string, p_type string"),
        "lineitem": (lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate timestamp"),
    }
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
        con.sql(f"create view {name} as select * from '{folder}/{name}.parquet/*.parquet'")
    return con


def test_reasons_name_what_only_the_forest_finds_odd(spark, tmp_path):
    con = made(spark, str(tmp_path))
    frame = transactions.win_anomaly_reasons(spark, str(tmp_path))
    rows = frame.collect()
    odd = [r for r in rows if "multivariate" in r.anomaly_type]
    assert [r.l_orderkey for r in odd] == [40] and "amount_outlier" not in odd[0].anomaly_type and "izolasyon skoru 0," not in odd[0].anomaly_reason and "izolasyon skoru 0." in odd[0].anomaly_reason
    want = con.sql(transactions.ORACLE_SQL["win_anomaly_reasons"])
    at = [want.columns.index(c) for c in frame.columns]
    assert sorted(repr(tuple(r)) for r in rows) == sorted(repr(tuple(r[k] for k in at)) for r in want.fetchall())


def test_the_forest_counts_an_entitys_rows_once(spark, monkeypatch):
    """The number of an entity's rows comes with its outliers; only merchants are counted again, and rows are as by counting."""
    from ledgermill.operators import anomaly, isolation

    rows = [("ab"[k % 2], k, float(k % 7), f"m{k % 3}", dt.date(2024, 1, 1 + k % 28)) for k in range(90)] + [("c", 1, 1.0, "m", None), (None, 2, 3.0, "m", None)]
    frame = spark.createDataFrame(rows, "e string, i int, amount double, m string, date date")
    counted = anomaly.with_aggregates(frame, ["e"], _many=anomaly.F.count(anomaly.F.lit(1)))
    calls, names = [], ["log_amount", "merchant_frequency"]
    for module in (anomaly, isolation):
        monkeypatch.setattr(module, "with_aggregates", lambda rows, by, real=module.with_aggregates, **more: calls.append(tuple(by)) or real(rows, by, **more))
    score = lambda rows, **more: sorted((str(r.e), r.i, r.merchant_frequency, r.iforest_score) for r in isolation.forest_scores(anomaly.forest_features(rows, ["e"], "m", **more), ["e"], names, ["i"], 30, **more).collect())
    told = score(counted, many="_many")
    assert calls == [("e", "m")] and told == score(frame) and len(told) == 92
