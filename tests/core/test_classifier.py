"""Classifiers, what they save, splits and the training protocol."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgermill.operators import classifier, features
from ledgermill.operators.classifier import TextClassifier, TextClassifierModel

WORDS = {"m": ["market", "gida", "ekmek", "manav"], "b": ["benzin", "yakit", "pompa", "petrol"], "r": ["restoran", "kebap", "pide", "lokanta"]}


def table(spark, n=90):
    rows = []
    for i in range(n):
        label = "mbr"[i % 3]
        w = WORDS[label]
        rows.append((i, f"{w[i % 4]} {w[(i // 3) % 4]} {w[(i // 7) % 4]} {i % 11}", label, f"g{i % 15}", "brand" if i % 2 else None))
    return spark.createDataFrame(rows, "id bigint, text string, label string, grp string, source string").repartition(3)


@pytest.mark.parametrize("kind", classifier.KINDS)
def test_kinds_learn_save_and_load(spark, tmp_path, kind):
    rows = table(spark)
    model = TextClassifier(kind=kind, rounds=3, rate=0.4, other="?", minDF=1, threshold=0.4).fit(rows.withColumn("_v", F.lit(1)))
    odd = spark.createDataFrame([(500, "", "m", "", ""), (501, None, "m", "", ""), (502, "  ", "m", "", ""), (503, "zzzz", "m", "", "")], rows.schema)
    said = model.transform(rows.unionByName(odd))
    assert set(said.columns) == {*rows.columns, "probability", "top", "confidence", "label_pred", "abstained"}
    got = {r.id: r for r in said.collect()}
    assert all((got[i].top, got[i].confidence, got[i].abstained) == ("?", 0.0, True) for i in (500, 501, 502))
    assert all(sum(r.probability) == pytest.approx(1.0) for r in got.values())
    right = sum(got[i].top == "mbr"[i % 3] for i in range(90)) / 90
    assert right == pytest.approx(1 / 3) if kind == "majority" else right > 0.95
    assert all(r.label_pred == ("?" if r.confidence < 0.4 else r.top) for i, r in got.items() if i < 90)
    model.write().overwrite().save(str(tmp_path / kind))
    again = TextClassifierModel.load(str(tmp_path / kind))
    assert again.getOrDefault("kind") == kind and again.getOrDefault("other") == "?"
    assert {r.id: (r.label_pred, r.confidence) for r in again.transform(rows).collect()} == {i: (r.label_pred, r.confidence) for i, r in got.items() if i < 90}


def test_estimator_keeps_its_parameters_and_odd_tables(spark, tmp_path):
    est = TextClassifier(kind="bayes", threshold=0.7)
    est.write().overwrite().save(str(tmp_path / "e"))
    assert TextClassifier.load(str(tmp_path / "e")).getOrDefault("threshold") == 0.7
    with pytest.raises(ValueError):
        TextClassifier(kind="magic").fit(table(spark))
    none = TextClassifier(other="?").fit(table(spark).limit(0))
    assert {(r.top, r.abstained) for r in none.transform(table(spark, 3)).collect()} == {("?", False)}
    one = TextClassifier(rounds=2, other="?").fit(table(spark).filter("label = 'm'"))
    assert {r.label_pred for r in one.transform(table(spark, 6)).collect()} == {"m"}


def test_splits_are_exact_and_keep_groups_whole(spark):
    rows = table(spark, 100).unionByName(spark.createDataFrame([(k, "t", None, None, None) for k in range(200, 211)], "id bigint, text string, label string, grp string, source string"))
    got = Counter((r.label, r.is_test) for r in features.stratified_split(rows, "label", "id").collect())
    for label in ("m", "b", "r", None):
        n = got[label, True] + got[label, False]
        assert got[label, True] == math.floor(n * 0.2 + 0.5)
    sides = {}
    for r in features.group_split(rows, "grp").collect():
        sides.setdefault(r.grp, set()).add(r.is_test)
    assert all(len(s) == 1 for s in sides.values()) and sum(s == {True} for s in sides.values()) == 3
    assert features.stratified_split(rows.limit(0), "label", "id").count() == 0


def test_protocol_drops_repeats_and_scores_by_source(spark):
    rows = table(spark)
    twice = rows.unionByName(rows.withColumn("id", F.col("id") + 1000)).unionByName(rows.filter("id < 5"))
    model, metrics = classifier.train_protocol(twice, "id", "text", "label", "grp", "source", TextClassifier(kind="bayes", minDF=1))
    distinct = rows.select("text").distinct().count()
    got = {(r.split, r.source): r for r in metrics.collect()}
    assert got.keys() == {("seen", "*"), ("unseen", "*"), ("unseen", "brand"), ("unseen", "unknown")}
    assert all(r.repeats_removed == 185 - distinct for r in got.values())
    assert got["seen", "*"].n + got["seen", "*"].train_rows == distinct and got["seen", "*"].accuracy > 0.9
    assert got["unseen", "brand"].n + got["unseen", "unknown"].n == got["unseen", "*"].n
    assert model.classes == ["b", "m", "r"]


def test_scores_count_classes_that_are_true_or_said(spark):
    rows = spark.createDataFrame([("a", "a")] * 6 + [("a", "b")] * 2 + [("b", "b")] * 1 + [("c", "a")] * 1 + [("a", "d")], "t string, s string")
    r = classifier.scores(rows, [], "t", "s").first()
    f1 = [2 * 6 / (9 + 7), 2 * 1 / (1 + 3), 0.0, 0.0]
    assert (r.n, r.accuracy, r.macro_f1) == (11, pytest.approx(7 / 11), pytest.approx(sum(f1) / 4))


def test_kinds_that_share_vectors_say_what_each_says_alone(spark, monkeypatch):
    """Terms are counted once for each vocabulary, whatever the number of kinds; odd rows and all kinds are said as by fit and transform."""
    odd = spark.createDataFrame([(500, "", "m", "", ""), (501, None, "b", "", ""), (502, "  ", "m", "", ""), (503, "zzzz", None, "", ""), (504, "market gida", None, "", ""), (505, "pompa", "new", "", "")], table(spark).schema)
    parts = table(spark).unionByName(odd).withColumn("is_test", F.col("id") % 3 != 1).unionByName(odd.withColumn("is_test", F.lit(False)).filter("id < 505"))
    options = {"rounds": 2, "rate": 0.4, "other": "?", "minDF": 1}
    want = Counter()
    for kind in classifier.KINDS:
        model = TextClassifier(kind=kind, **options).fit(parts.filter("not is_test"))
        want.update((kind, r.label, r.top) for r in model.transform(parts.filter("is_test")).collect())
    calls, learn = [], classifier.learn_vocabulary
    monkeypatch.setattr(classifier, "learn_vocabulary", lambda *a: calls.append(a[-1]) or learn(*a))
    got = Counter(tuple(r) for r in classifier.said_of_tested(parts, "text", "label", **options).collect())
    assert got == want and sorted(calls) == [False, True]
    none = classifier.said_of_tested(parts.filter("is_test"), "text", "label", **options)
    assert {r.said for r in none.collect()} == {"?"}


def test_counts_in_hashed_slots_are_those_of_spark_ml(spark):
    from pyspark.ml.feature import HashingTF

    texts = ["ab banana  ab\tan", None, "", " \n ", "çay şeker çay ığ \U0001d11ex", "x"] + [f"w{k} banana w{k % 7}" for k in range(100)]
    rows = spark.createDataFrame([(k, t, "ab"[k % 2]) for k, t in enumerate(texts)], "k int, t string, l string")
    for size in (1 << 15, 50):
        want = HashingTF(inputCol="n_grams", outputCol="v", numFeatures=size).transform(features.with_ngrams(rows, "t"))
        counted = features.with_counts(rows, "t", "v", size)
        assert {r.k: r.v for r in counted.collect()} == {r.k: r.v for r in want.collect()}
    model = features.fit_logistic(counted, "t", "l", counts="v")
    assert model.transform(counted).filter("prediction is null").count() == 0


def test_merchant_rows_keep_their_quotas_and_groups(spark):
    from ledgermill.sources import synthetic

    brands = spark.createDataFrame([("market", "MIGROS"), ("market", "SOK"), ("market", "SOK"), ("yakit", "SHELL"), ("yakit", "OPET"), ("ev", "IKEA")], "category string, brand string")
    words = spark.createDataFrame([("market", "GIDA"), ("yakit", "PETROL"), ("yakit", "PETROL")], "category string, keyword string")
    made = synthetic.merchant_rows(brands, words, ["YILMAZ", "KAYA"], 403)
    rows = made.collect()
    got = Counter((r.category, r.source) for r in rows)
    assert got == {("ev", "brand"): 101, ("market", "brand"): 61, ("market", "generic"): 40, ("yakit", "brand"): 61, ("yakit", "generic"): 40, (synthetic.OTHER, "other"): 100}
    assert len({r.id for r in rows}) == 403 and {tuple(r) for r in made.repartition(7).collect()} == {tuple(r) for r in rows}
    assert {r.group for r in rows if r.source == "brand"} == {"brand:MIGROS", "brand:SOK", "brand:SHELL", "brand:OPET", "brand:IKEA"}
    assert {r.group.split(":")[1] for r in rows if r.source == "generic"} >= {"YILMAZ", "KAYA"} and all(r.raw_text == r.raw_text.upper() or "*" in r.raw_text or "/" in r.raw_text for r in rows)
    clean = synthetic.merchant_texts(brands, words, ["YILMAZ", "KAYA"], 403)
    assert 390 < clean.count() <= 403 and clean.filter("clean_text = ''").count() == 0
    assert synthetic.merchant_rows(brands, words, ["X"], 0).count() == 0


def test_what_is_fitted_and_scored_together_is_said_as_by_fit_and_transform(spark):
    odd = spark.createDataFrame([(500, "", "m", "", ""), (501, None, "b", "", ""), (502, "  ", "m", "", ""), (503, "zzzz", None, "", ""), (505, "pompa", "new", "", "")], table(spark).schema)
    rows = table(spark).unionByName(odd)
    estimator, learns = TextClassifier(kind="boosted", rounds=2, rate=0.4, other="?", minDF=1, textCol="text", labelCol="label"), F.col("id") % 3 != 1
    model, said = classifier.fit_and_score(rows, learns, "text", "label", estimator)
    want = estimator.fit(rows.filter(learns))
    names = ["id", "label", "top", "confidence", "label_pred", "abstained"]
    assert model.forest.rounds == want.forest.rounds
    assert Counter(tuple(r) for r in said.select(names).collect()) == Counter(tuple(r) for r in want.transform(rows).select(names).collect())
    _, none = classifier.fit_and_score(rows, F.lit(False), "text", "label", estimator)
    assert {r.top for r in none.collect()} == {"?"}


def test_candidates_are_fitted_with_the_estimators_own_rounds(spark, monkeypatch):
    """The trees that are compared are not a few rounds of them."""
    from ledgermill.operators import boosting
    from ledgermill.plans import learning

    asked = []
    monkeypatch.setattr(boosting, "fit_boosted", lambda *a, rate: asked.append((a[5], rate)) or boosting.Forest(a[1], [0.0] * len(a[1]), a[3]))
    learning.ml_candidates(spark, "/root/testdata/sf0.001")
    assert asked == [(200, 0.1)]
