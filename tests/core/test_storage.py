"""Tables in and out, errors apart, repeatable orders, free amounts."""

import json
from decimal import Decimal

from pyspark.sql import functions as F

from ledgermill.functions import money
from ledgermill.operators import merging
from ledgermill.sources import storage


def test_csv_keeps_quotes_commas_and_line_breaks(spark, tmp_path):
    rows = [("MARKET, ŞİŞLİ", "Market"), ('AD "X"', "Giyim"), ("iki\nsatır", "Diğer")]
    storage.write_csv(spark.createDataFrame(rows, "text string, label string"), f"{tmp_path}/labelled")
    got = storage.read_csv(spark, f"{tmp_path}/labelled", "text string, label string").collect()
    assert sorted(map(tuple, got)) == sorted(rows)


def test_a_missing_model_is_none_and_a_saved_one_comes_back(spark, tmp_path):
    where = f"{tmp_path}/model"
    assert storage.load_model(spark, where, "weights") is None
    storage.save_model(where, weights=spark.createDataFrame([("a", 0.5)], "term string, weight double"))
    assert [tuple(r) for r in storage.load_model(spark, where, "weights")["weights"].collect()] == [("a", 0.5)]
    assert storage.load_model(spark, where, "weights", "idf") is None


def test_metrics_are_json_rows(spark, tmp_path):
    storage.write_metrics(spark.createDataFrame([("accuracy", 0.9)], "name string, value double"), f"{tmp_path}/m")
    lines = [json.loads(x) for f in (tmp_path / "m").glob("*.json") for x in f.read_text().splitlines()]
    assert lines == [{"name": "accuracy", "value": 0.9}]


def test_errors_stand_apart(spark):
    good, bad = merging.split_errors(spark.createDataFrame([("a", None), ("b", "too large")], "path string, error string"))
    assert [tuple(r) for r in good.collect()] == [("a",)]
    assert [tuple(r) for r in bad.collect()] == [("b", "too large")]


def test_shuffle_repeats_by_seed_whatever_the_partitions(spark):
    rows = spark.range(50)
    order = lambda n, seed: [r["id"] for r in merging.shuffled(rows.repartition(n), seed, ["id"]).collect()]
    assert order(1, 7) == order(5, 7)
    assert order(1, 7) != order(1, 8)
    assert sorted(order(3, 7)) == list(range(50))


def test_dates_sort_with_their_ties(spark):
    rows = spark.createDataFrame([("2024-01-02", 1), ("2024-01-01", 2), ("2024-01-01", 1)], "day string, n int").select(F.to_date("day").alias("date"), "n")
    assert [(str(r["date"]), r["n"]) for r in merging.by_date(rows, ["n"]).collect()] == [("2024-01-01", 1), ("2024-01-01", 2), ("2024-01-02", 1)]


def test_first_amount_of_a_text(spark):
    rows = spark.createDataFrame([(1, "Borç 1.234,56 TL, 10,00"), (2, "tutar yok")], "k int, text string")
    got = {r["k"]: (r["a"]["value"], r["a"]["negative"]) for r in rows.select("k", money.first_amount(F.col("text")).alias("a")).collect()}
    assert got == {1: (Decimal("1234.56"), False), 2: (Decimal("0.00"), False)}


def test_rhythms_sort_few_rows_in_each_task(spark, monkeypatch):
    """The partitions grow with the table, and keys stay whole."""
    from ledgermill.plans import transactions

    whole = sorted(map(tuple, transactions.obl_rhythms(spark, "/root/testdata/sf0.001").collect()))
    monkeypatch.setattr(transactions, "KEY_ROWS", 500)
    got = transactions.obl_rhythms(spark, "/root/testdata/sf0.001")
    many = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert "hashpartitioning(l_partkey" in (plan := got._jdf.queryExecution().executedPlan().toString()) and f", {-(-many // 500)}), REPARTITION_BY_NUM" in plan and plan.count("Exchange") == 1
    assert sorted(map(tuple, got.collect())) == whole
