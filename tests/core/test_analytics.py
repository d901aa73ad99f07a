import datetime as dt
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgermill.functions import finance
from ledgermill.operators import aggregates, anomaly, copilot, features, forecast, obligations
from ledgermill.operators.isolation import forest_score, forest_scores, grow_forest
from ledgermill.plans.pipeline import run_pipeline
from ledgermill.schema import copilot_spend, ensure_columns
from ledgermill.sources import documents

TX = "statement string, date date, clean_description string, category string, amount decimal(18,2), transaction_type string, installment_no int, installment_total int"


def day(k, start=dt.date(2026, 1, 1)):
    return start + dt.timedelta(days=int(k))


def sample(spark):
    rows = [
        ("s", day(1), "MIGROS", "Market", Decimal("450.00"), "EXPENSE", None, None), ("s", day(3), "A101", "Market", Decimal("320.00"), "EXPENSE", None, None), ("s", day(4), "KOFTECI", "Restoran", Decimal("150.00"), "EXPENSE", None, None),
        ("s", day(5), "KAFE", "Restoran", Decimal("80.00"), "EXPENSE", None, None), ("s", day(6), "BERSHKA", "Giyim", Decimal("1850.00"), "EXPENSE", None, None), ("s", day(9), "BERSHKA IADE", "Giyim", Decimal("-350.00"), "REFUND", None, None),
        ("s", day(9), "TEKNO (03/06)", "Elektronik", Decimal("12500.00"), "INSTALLMENT", 3, 6), ("s", day(12), "NETFLIX", "Dijital / Abonelik", Decimal("199.99"), "EXPENSE", None, None), ("s", day(13), "ODEME", "Diğer", Decimal("-500.00"), "PAYMENT", None, None),
    ]
    return spark.createDataFrame(rows, TX)


def test_copilot_numbers_and_routes(spark):
    tx = copilot.normalise(sample(spark))
    got = {r.category: r for r in aggregates.category_spend(tx, []).collect()}
    assert (got["Market"].gross_spend, got["Giyim"].net_spend) == (Decimal("770.00"), Decimal("1500.00"))
    questions = ["Markete ne kadar harcadım?", "Markete mi restorana mı daha çok harcadım?", "Migros'a ne kadar gitti?", "Geçen ay ne kadar?", "Şüpheli işlem var mı?", "İadelerim ne kadar?", "Gelecek ay taksitlerim ne kadar?", "Nasıl tasarruf ederim?", "En çok nereye harcadım?", "Toplam borcum?", "", "hava nasıl"]
    want = ["category_spend", "compare_categories", "merchant_spend", "unsupported_temporal", "anomalies", "refunds", "obligations", "savings", "top_merchants", "summary", "unknown", "unknown"]
    asked = copilot.route(spark.createDataFrame([(q,) for q in questions], "question string"), copilot.merchant_tokens(tx.filter(copilot_spend())))
    assert {r.question: r.intent for r in asked.collect()} == dict(zip(questions, want, strict=True))
    assert "770,00 TL" in copilot.ask(sample(spark), "Markete ne kadar harcadım?", [])[1]
    assert "350,00 TL" in copilot.ask(sample(spark), "İadelerim ne kadar?", ["clean_description"])[1]


def test_obligations(spark):
    rows = [("s", day(30 * k), "KIRA", "Ev", Decimal("900.00"), "EXPENSE", None, None) for k in range(3)]
    rows += [("s", day(60 + 6 * k), "MARKET", "Gıda", Decimal("50.00"), "EXPENSE", None, None) for k in range(2)]
    rows += [("s", day(10 * k), f"TV ({k}/4)", "Tek", Decimal("600.00"), "INSTALLMENT", k, 4) for k in (1, 2, 3)]
    rows += [("s", day(31), "ESKI (6/6)", "Tek", Decimal("70.00"), "INSTALLMENT", 6, 6), ("s", day(0) - dt.timedelta(60), "COK ESKI (1/2)", "Tek", Decimal("9.00"), "INSTALLMENT", 1, 2)]
    due = obligations.known_obligations(obligations.components(spark.createDataFrame(rows, TX), ["statement"]), ["statement"], ["clean_description"]).collect()
    assert sorted((r.kind, r.description, r.next_installment, r.remaining_after_next) for r in due) == [("installment", "TV (3/4)", 4, 0), ("subscription", "KIRA", None, None)]


def test_anomalies(spark):
    rng = np.random.default_rng(1)
    rows = [("s", day(k // 2), f"ISYERI {k % 15}", "ABCD"[k % 4], Decimal(f"{rng.lognormal(5.3, 0.45):.2f}"), "EXPENSE", None, None) for k in range(60)]
    rows += [("s", day(20), "OUT", "A", Decimal("9500.00"), "EXPENSE", None, None), ("s", day(21), "CIFT", "B", Decimal("77.10"), "EXPENSE", None, None), ("s", day(22), "CIFT", "B", Decimal("77.10"), "EXPENSE", None, None)]
    rows += [("s", day(22), "IADE", "B", Decimal("-20.00"), "REFUND", None, None), ("t", day(2), "X", "A", Decimal("10.00"), "EXPENSE", None, None), ("t", None, None, None, None, None, None, None)]
    got = anomaly.detect_anomalies(spark.createDataFrame(rows, TX), ["statement"], ["clean_description"]).collect()
    assert len(got) == len(rows)
    kinds = {(r.clean_description, r.date): r.anomaly_type for r in got if r.anomaly_type}
    assert "amount_outlier" in kinds[("OUT", day(20))] and kinds[("CIFT", day(22))] == "duplicate_charge" and ("CIFT", day(21)) not in kinds
    assert sum(r.is_anomaly for r in got) <= 4
    assert {r.anomaly_reason for r in got if r.statement == "t"} == {anomaly.TOO_FEW, anomaly.NOT_SPEND}


def test_zero_deviation_and_isolation(spark):
    z = {r.x: r.z for r in anomaly.robust_z(spark.createDataFrame([(5.0,), (5.0,), (5.0,), (5.0,), (50.0,)], "x double"), "x", []).collect()}
    assert z[5.0] == 0 and z[50.0] == pytest.approx(45 / (1.253314 * 9))
    x = np.random.default_rng(0).normal(size=(80, 3))
    x[0] = 9
    s = forest_score(x, grow_forest(x))
    assert s[0] == s.max() > 0.65 and s[1:].mean() < 0.55


def test_forest_scores_do_not_depend_on_the_tasks_that_score(spark, monkeypatch):
    from ledgermill.operators import isolation

    rng = np.random.default_rng(3)
    rows = [(e, i, float(rng.normal()), float(rng.normal())) for e, n in (("a", 1500), ("b", 40), ("c", 5), (None, 60)) for i in range(n)]
    frame = spark.createDataFrame([*rows, ("a", 9999, 30.0, -30.0)], "e string, i int, x double, y double")
    score = lambda: {(r.e, r.i): r.iforest_score for r in forest_scores(frame, ["e"], ["x", "y"], ["i"], 30).collect()}
    whole = score()
    monkeypatch.setattr(isolation, "CHUNK", 100)
    assert score() == whole and len(whole) == 1606
    assert whole["a", 9999] == max(whole.values()) > 0.65 and whole["c", 0] == 0 < whole[None, 0]
    assert forest_scores(frame.drop("e"), [], ["x", "y"], ["i"], 30).filter("iforest_score > 0").count() == 1606


def series(spark, n, keys=("a",), seed=0, noise=60):
    rng = np.random.default_rng(seed)
    rows = [(k, day(t), float(max(1.0, 300 + 80 * np.sin(2 * np.pi * t / 7) + rng.normal(0, noise)))) for k in keys for t in range(n)]
    return spark.createDataFrame(rows, "k string, day date, y double")


@pytest.mark.parametrize("n,folds", [(13, None), (20, None), (21, 1), (27, 1), (28, 1), (42, 2), (56, 3), (120, 3)])
def test_folds_leave_enough_to_train(spark, n, folds):
    got = forecast.folds(series(spark, n), ["k"]).collect()
    assert (got[0].n_folds if got else None) == folds
    assert all(r.cut >= 14 for r in got)


def test_forecast_statuses_and_coverage(spark):
    short = forecast.forecast(series(spark, 10), ["k"]).first()
    assert (short.status, short.daily_mean, short.risk_upper) == ("insufficient_data", None, None)
    n, keys = 90, [f"k{i}" for i in range(40)]
    rng = np.random.default_rng(4)
    full = {k: np.maximum(0, 300 + 80 * np.sin(2 * np.pi * np.arange(n + 30) / 7) + rng.normal(0, 120, n + 30)) for k in keys}
    frame = spark.createDataFrame([(k, day(t), float(v[t])) for k, v in full.items() for t in range(n)], "k string, day date, y double")
    rows = forecast.forecast(frame, ["k"], simulations=400).collect()
    hits = [r.risk_lower <= full[r.k][n:].sum() <= r.risk_upper for r in rows]
    assert all(r.status == "ok" and len(r.daily_mean) == 30 for r in rows) and np.mean(hits) >= 0.85


def test_scenarios(spark):
    got = finance.simulate(spark.createDataFrame([(1, 1000.0, 20000.0), (2, 0.0, None)], "id int, saving double, expense double"), 3).collect()
    fund = next(r for r in got if r.id == 1 and r.asset.startswith("Para"))
    rate, now = 1.4 ** (1 / 12) - 1, 0.0
    for _ in range(36):
        now = (now + 1000) * (1 + rate)
    assert fund.final_nominal == pytest.approx(now, abs=0.01) and {r.life_days for r in got if r.id == 2} == {None}
    assert finance.simulate(spark.createDataFrame([(1.0,)], "saving double").withColumn("expense", F.lit(None).cast("double")), 1).select(finance.grow(F.col("saving"), F.lit(0.0), F.lit(3)).alias("c")).first().c == [1.0, 2.0, 3.0]
    with pytest.raises(ValueError):
        finance.simulate(spark.createDataFrame([(1.0, 1.0)], "saving double, expense double"), 0)


def test_features_and_classifiers(spark):
    grams = spark.createDataFrame([("ab",), ("a",)], "w string").select("w", features.char_wb_ngrams(F.col("w")).alias("g"))
    assert {r.w: r.g for r in grams.collect()} == {"ab": [" a", "ab", "b ", " ab", "ab ", " ab "], "a": [" a", "a ", " a "]}
    texts = [(i, "market gida ekmek" if i % 2 else "benzin yakit pompa", "m" if i % 2 else "b") for i in range(20)]
    rows = spark.createDataFrame(texts, "row_id bigint, text string, label string")
    counts = features.terms(rows, "row_id", "text")
    weights = features.tfidf(counts, features.vocabulary(counts, 20))
    norms = [r.n for r in weights.groupBy("row_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("n")).collect()]
    assert norms == pytest.approx([1.0] * 20)
    got = features.predict(features.class_scores(weights, *features.fit_naive_bayes(weights, rows.select("row_id", "label"))), "other").collect()
    assert all(r.label == ("m" if r.row_id % 2 else "b") and not r.abstained for r in got)
    model = features.fit_logistic(rows, "text", "label", size=1 << 10)
    assert model.transform(features.with_ngrams(rows, "text")).filter("prediction <> y").count() == 0


def test_documents_and_pipeline(spark, tmp_path):
    good = "Akbank Axess\nDönem Borcu: 30,00\n01.02.2026 MARKET 10,00\n03.02.2026 HAVALE AYŞE KAYA 20,00"
    for name, body in (("a.pdf", good), ("b.pdf", good), ("c.pdf", "x"), ("d.pdf", "BAD")):
        (tmp_path / name).write_bytes(body.encode())
    files = documents.read_files(spark, str(tmp_path))

    def extractor(content):
        if content == b"BAD":
            raise ValueError("broken")
        return [content.decode()]

    docs, errors = documents.checked(files, documents.extract_pages(files, extractor))
    assert sorted(r.error for r in errors.collect()) == ["ValueError: broken", "scanned"]
    strangers, _, none = run_pipeline(docs, forest=False)  # nobody knows whose they are, so none repeats another
    assert strangers.count() == 2 and none.count() == 0 and strangers.select("customer").distinct().count() == 2
    statements, transactions, repeated = run_pipeline(docs, forest=False, owner="me")
    assert statements.count() == 1 and statements.first().checksum_valid and repeated.count() == 1
    assert sorted(r.clean_description for r in transactions.collect()) == ["HAVALE [KİŞİ]", "MARKET"]
    import zlib

    two = spark.createDataFrame([("1", "p", [good]), ("2", "q", [good]), ("3", "q", [good]), ("4", "q", ["x"]), ("5", "q", ["x"])], "doc string, customer string, pages array<string>")
    kept, rows, repeated = run_pipeline(two, forest=False)
    assert sorted(r.doc for r in kept.collect()) == ["1", "2", "4", "5"] and [r.doc for r in repeated.collect()] == ["3"]
    assert rows.filter("doc IN ('1', '2')").count() == 4
    raw = spark.createDataFrame([("p", bytearray(zlib.compress(b"0" * 5000)), True), ("p", bytearray(b"junk"), True), ("p", bytearray(b"raw!!"), False)], "path string, raw binary, is_deflated boolean")
    assert documents.over_budget(raw).first().total == 5009


def test_defaults_and_top_n(spark):
    assert ensure_columns(spark.createDataFrame([(1,)], "x int")).first().transaction_type == "EXPENSE"
    totals = spark.createDataFrame([(f"c{i}", Decimal(10 - i)) for i in range(10)], "c string, total decimal(18,2)")
    top = aggregates.top_n_with_other(totals, [], "c", 7).orderBy("rank").collect()
    assert len(top) == 8 and top[-1].c == "Other (3)" and sum(r.total for r in top) == 55
    assert aggregates.top_n_with_other(totals.limit(7), [], "c", 7).count() == 7


def test_equal_questions_are_looked_up_once(spark):
    tokens = spark.createDataFrame([("bolt", "hot bolt"), ("ring", "large ring")], "token string, merchant string")
    asked = spark.createDataFrame([(1, "Hot Bolt'a ne?"), (2, "Hot Bolt'a ne?"), (3, None), (4, "rings ve bolt")], "id int, question string")
    got = copilot.route(asked, tokens)
    assert sorted((r.id, r.intent, r.merchant_token) for r in got.collect()) == [(1, "merchant_spend", "bolt"), (2, "merchant_spend", "bolt"), (3, "unknown", None), (4, "merchant_spend", "bolt")]
    assert "monotonically" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_descriptions_are_cleaned_once_each_and_rows_read_twice(spark, tmp_path):
    """Judging reads spend and the rest, no third time for entities of few rows, which it still tells apart; null descriptions too."""
    from ledgermill.operators import anomaly

    rows = [(s, "2024-01-%02d" % (k + 1), d, 10.0 + k % 3, k) for s, n, d in (("a", 9, "Shop A.Ş. 1"), ("b", 3, None), (None, 6, "Kafe")) for k in range(n)]
    spark.createDataFrame(rows, "statement string, day string, clean_description string, x double, k int").write.parquet(f"{tmp_path}/rows")
    tx = spark.read.parquet(f"{tmp_path}/rows").select("statement", F.to_date("day").alias("date"), "clean_description", F.col("x").cast("decimal(18,2)").alias("amount"), "k")
    got = anomaly.detect_anomalies(tx, ["statement"], ["k"], forest=False)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and plan.count("k#") > 0 and sum("Relation [statement" in x for x in plan.splitlines()) == 2
    told = {(r.statement, r.anomaly_reason == anomaly.TOO_FEW): r["count"] for r in got.groupBy("statement", "anomaly_reason").count().collect()}
    assert len(got.collect()) == len(rows) and told["b", True] == 3 and ("a", True) not in told and (None, True) not in told
