"""Character n-grams, TF-IDF, linear classification, evaluation and attribution as joins and aggregates.

Features are long tables (row_id, term, weight); nothing is collected but fitted weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.storage import materialize
from .selection import smallest_share

LOW, HIGH, MIN_DF, VOCABULARY = 2, 5, 2, 20_000
ABSTAIN, SURE, BINS = 0.55, 0.90, 10
#: Slots that n-grams are hashed to.
HASHED = 1 << 15


def char_wb_ngrams(word: Column, low: int = LOW, high: int = HIGH) -> Column:
    """n-grams of a word between blanks; the first n that the word is too short for gives it once."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    size = F.length(padded)
    sizes = F.sequence(F.lit(low), F.greatest(F.least(F.lit(high), size), F.lit(low)))
    return F.flatten(F.transform(sizes, lambda n: F.when(size > n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substr(padded, i, n))).otherwise(F.array(padded))))


def terms(rows: DataFrame, row_id: str, text: str) -> DataFrame:
    """row_id, term, tf over all words of the text."""
    words = rows.select(F.col(row_id).alias("row_id"), F.explode(F.filter(F.split(text, r"\s+"), lambda w: w != "")).alias("word"))
    counted = words.groupBy("row_id", "word").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("row_id", "n", F.explode(char_wb_ngrams(F.col("word"))).alias("term")).groupBy("row_id", "term").agg(F.sum("n").alias("tf"))


def vocabulary(counts: DataFrame, documents: int, min_df: int = MIN_DF, size: int = VOCABULARY) -> DataFrame:
    """term, df, idf of the ``size`` commonest terms in at least ``min_df`` documents."""
    seen = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).filter(F.col("df") >= min_df)
    kept = seen.orderBy(F.desc("total"), "term").limit(size)
    return kept.select("term", "df", (F.log(F.lit(1.0 + documents) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """row_id, term, weight: (1 + ln tf) x idf, each row of length one."""
    raw = counts.join(idf.select("term", "idf"), "term").select("row_id", "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("row_id")))
    return raw.select("row_id", "term", (F.col("w") / norm).alias("weight"))


def fit_naive_bayes(weights: DataFrame, labels: DataFrame, alpha: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(term weights, intercepts) of multinomial naive Bayes over the classes of ``labels``.

    ``weights`` is (row_id, term, weight) and ``labels`` (row_id, label). Terms that a class
    lacks get its smoothed floor, carried by the intercept table as ``floor``.
    """
    joined = weights.join(labels, "row_id")
    terms_n = weights.select("term").distinct().agg(F.count(F.lit(1)).alias("v"))
    mass = joined.groupBy("label").agg(F.sum("weight").alias("mass"))
    rows = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    all_n = labels.agg(F.count(F.lit(1)).alias("all_n"))
    prior = rows.join(mass, "label", "left").join(F.broadcast(terms_n), F.lit(True)).join(F.broadcast(all_n), F.lit(True))
    total = F.coalesce("mass", F.lit(0.0)) + alpha * F.col("v")
    prior = prior.select("label", F.log(F.col("n") / F.col("all_n")).alias("intercept"), F.log(alpha / total).alias("floor"), total.alias("total"))
    each = joined.groupBy("label", "term").agg(F.sum("weight").alias("s")).join(prior.select("label", "total", "floor"), "label")
    return each.select("label", "term", (F.log((F.col("s") + alpha) / F.col("total")) - F.col("floor")).alias("coef")), prior.select("label", "intercept", "floor")


def class_scores(weights: DataFrame, coefs: DataFrame, intercepts: DataFrame) -> DataFrame:
    """row_id, label, p: softmax of the linear scores, over all classes for every row.

    Classes are the rows of ``intercepts``, a model parameter; they are broadcast.
    """
    known = weights.join(coefs, "term").groupBy("row_id", "label").agg(F.sum(F.col("weight") * F.col("coef")).alias("part"))
    mass = weights.groupBy("row_id").agg(F.sum("weight").alias("mass"))
    grid = mass.join(F.broadcast(intercepts), F.lit(True)).join(known, ["row_id", "label"], "left")
    floor = F.col("floor") * F.col("mass") if "floor" in intercepts.columns else F.lit(0.0)
    scored = grid.select("row_id", "label", (F.col("intercept") + floor + F.coalesce("part", F.lit(0.0))).alias("z"))
    rows = Window.partitionBy("row_id")
    e = F.exp(F.col("z") - F.max("z").over(rows))
    return scored.withColumn("e", e).select("row_id", "label", (F.col("e") / F.sum("e").over(rows)).alias("p"))


def predict(scores: DataFrame, other: str, threshold: float = ABSTAIN) -> DataFrame:
    """row_id, top, confidence, label, abstained: unsure rows get ``other`` but keep their confidence."""
    best = scores.groupBy("row_id").agg(F.max("p").alias("confidence"), F.min_by("label", F.struct((-F.col("p")).alias("q"), F.col("label"))).alias("top"))
    unsure = (F.col("confidence") < threshold) & (F.col("top") != other)
    return best.select("row_id", "top", "confidence", F.when(unsure, other).otherwise(F.col("top")).alias("label"), unsure.alias("abstained"))


def fit_logistic(rows: DataFrame, text: str, label: str, c: float = 10.0, size: int = HASHED, counts: str | None = None):
    """Multinomial logistic regression on hashed n-grams: a Spark ML pipeline model, ``prediction`` numbers the labels by name.

    Terms fall into ``size`` slots, so the model's size doesn't grow with the rows; ``n_grams`` is added,
    unless ``counts`` names a column of with_counts().
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, StringIndexer

    labelled = rows.filter(F.col(label).isNotNull())
    named = labelled if counts else with_ngrams(labelled, text)
    steps = [
        StringIndexer(inputCol=label, outputCol="y", stringOrderType="alphabetAsc"), *([] if counts else [HashingTF(inputCol="n_grams", outputCol="tf", numFeatures=size)]),
        IDF(inputCol=counts or "tf", outputCol="tfidf", minDocFreq=MIN_DF), Normalizer(inputCol="tfidf", outputCol="x"),
        LogisticRegression(featuresCol="x", labelCol="y", regParam=1.0 / (c * max(labelled.count(), 1)), standardization=False, maxIter=60),
    ]
    return Pipeline(stages=steps).fit(named)


def with_counts(rows: DataFrame, text: str, name: str, size: int = HASHED) -> DataFrame:
    """A written copy of the rows with the counts of the text's n-grams in hashed slots, a Spark ML vector, in the text's place."""
    from pyspark.ml.linalg import VectorUDT

    from .vectorizer import hashed_terms

    others = [c for c in rows.columns if c != text]
    return materialize(rows.select(*others, hashed_terms(size)(F.col(text).cast("string")).alias(name)), T.StructType([*rows.select(*others).schema.fields, T.StructField(name, VectorUDT())]))


def with_ngrams(rows: DataFrame, text: str) -> DataFrame:
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    return rows.withColumn("n_grams", F.flatten(F.transform(words, lambda w: char_wb_ngrams(w))))


def hash_key(seed: int, *columns: str) -> Column:
    """A number of 60 bits from the MD5 of a seed and of columns as text, nulls empty."""
    words = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *words).cast("binary")), 1, 15), 16, 10).cast("bigint")


def stratified_split(rows: DataFrame, label: str, row_id: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds is_test: the nearest number of rows to the given share of each class, those with the smallest hashes.

    The hash of the last one is selected by rank, so no task holds a class. Rows with one id
    are on one side; rows without a class form one.
    """
    keyed = rows.withColumns({"_key": hash_key(seed, row_id), "_class": F.struct(F.lit(0).alias("_"), label)})
    limits = smallest_share(keyed, ["_class"], "_key", test).select(F.col("_class").alias("_of"), "limit")
    joined = keyed.join(limits, F.col("_class") == F.col("_of"), "left")
    return joined.withColumn("is_test", F.coalesce(F.col("_key") <= F.col("limit"), F.lit(False))).drop("_key", "_class", "_of", "limit")


def group_split(rows: DataFrame, group: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds is_test: the given share of the groups, whole, so that none is on both sides; rows without one form one."""
    key = hash_key(seed, group)
    limit = smallest_share(rows.select(key.alias("_key")).distinct(), [], "_key", test)
    joined = rows.withColumn("_key", key).join(F.broadcast(limit), F.lit(True), "left")
    return joined.withColumn("is_test", F.coalesce(F.col("_key") <= F.col("limit"), F.lit(False))).drop("_key", "limit")


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("truth", "label").agg(F.count(F.lit(1)).alias("n"))


def class_metrics(rows: DataFrame) -> DataFrame:
    """class, precision, recall, f1, support over every class that is true or predicted; undefined is 0."""
    cells = confusion(rows).select(F.explode(F.array(F.struct(F.col("truth").alias("class"), F.lit(1).alias("t")), F.struct(F.col("label").alias("class"), F.lit(0).alias("t")))).alias("x"), "truth", "label", "n")
    hit = F.sum(F.when((F.col("x.t") == 1) & (F.col("truth") == F.col("label")), F.col("n")).otherwise(0))
    sums = cells.groupBy("x.class").agg(hit.alias("tp"), F.sum(F.when(F.col("x.t") == 1, F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(F.col("x.t") == 0, F.col("n")).otherwise(0)).alias("predicted"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    out = sums.withColumns({"precision": ratio(F.col("tp"), F.col("predicted")), "recall": ratio(F.col("tp"), F.col("support"))})
    both = F.col("precision") + F.col("recall")
    return out.select("class", "precision", "recall", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0)).alias("f1"), "support")


def calibration_error(rows: DataFrame, bins: int = BINS) -> DataFrame:
    """One row, ece: bins (lo, hi]; a confidence of zero is in none."""
    binned = rows.withColumn("bin", F.ceil(F.col("confidence") * bins)).filter("bin >= 1")
    each = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg(F.col("is_right").cast("double")) - F.avg("confidence")).alias("gap"))
    whole = rows.agg(F.count(F.lit(1)).alias("all_n"))
    return each.agg(F.sum(F.col("n") * F.col("gap")).alias("s")).join(F.broadcast(whole), F.lit(True)).select(F.coalesce(F.col("s") / F.col("all_n"), F.lit(0.0)).alias("ece"))


def selective_metrics(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy, coverage, accuracy of answers, and the share that is confidently wrong."""
    right = F.col("is_right").cast("double")
    wrong = (~F.col("is_right")) & (F.col("confidence") >= SURE) & ~F.col("abstained")
    return rows.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.avg(right).alias("accuracy"), F.avg((~F.col("abstained")).cast("double")).alias("coverage"), F.avg(F.when(~F.col("abstained"), right)).alias("selective_accuracy"), F.avg(wrong.cast("double")).alias("confident_wrong")
    )


def attributions(weights: DataFrame, coefs: DataFrame, means: DataFrame) -> DataFrame:
    """row_id, label, term, phi: coef x (weight - mean weight) of the terms that a row has."""
    return weights.join(means, "term", "left").join(coefs, "term").select("row_id", "label", "term", (F.col("coef") * (F.col("weight") - F.coalesce("mean", F.lit(0.0)))).alias("phi"))


def word_attributions(rows: DataFrame, row_id: str, text: str, phi: DataFrame) -> DataFrame:
    """row_id, pos, word, value: a term's value shared among words by its occurrences, none counted twice."""
    words = rows.select(F.col(row_id).alias("row_id"), F.posexplode(F.filter(F.split(text, r"\s+"), lambda w: w != "")).alias("pos", "word"))
    grams = words.select("row_id", "pos", "word", F.explode(char_wb_ngrams(F.col("word"))).alias("term")).groupBy("row_id", "pos", "word", "term").agg(F.count(F.lit(1)).alias("c"))
    part = F.col("c") / F.sum("c").over(Window.partitionBy("row_id", "term"))
    return grams.withColumn("part", part).join(phi, ["row_id", "term"]).groupBy("row_id", "pos", "word").agg(F.sum(F.col("part") * F.col("phi")).alias("value"))


def top_terms(phi: DataFrame, k: int = 8) -> DataFrame:
    """The k terms of each row and label with the largest absolute value."""
    order = Window.partitionBy("row_id", "label").orderBy(F.desc(F.abs("phi")), "term")
    return phi.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
