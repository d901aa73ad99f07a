"""Queries over daily series, scenarios, and text features; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import finance
from ..operators import features, forecast, obligations
from ..schema import TX_SQL, read, tx_of
from .transactions import _KNOWN, TIES, WIDE

PRIORITY = ["o_orderpriority"]


def _order_days(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "orders").select("o_orderpriority", F.col("o_orderdate").cast("date").alias("date"), "o_totalprice")
    return obligations.complete_calendar(rows, PRIORITY, "date", "o_totalprice")


def fc_calendar(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "events").filter("event_type = 'purchase'").select("user_id", F.col("ts").cast("date").alias("date"), "value")
    return obligations.complete_calendar(rows, ["user_id"], "date", "value").select("user_id", "day", F.round("y", 4).alias("y"))


def fc_weekday_mean(spark: SparkSession, sf: str) -> DataFrame:
    got = forecast.residuals(_order_days(spark, sf), PRIORITY)
    return got.select("o_orderpriority", "day", F.round("res_mean", 2).alias("res_mean"), F.round("res_dow", 2).alias("res_dow"))


def fc_folds(spark: SparkSession, sf: str) -> DataFrame:
    return forecast.folds(_order_days(spark, sf), PRIORITY)


def fc_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of the run-rate and the weekday mean over all folds."""
    got = forecast.scores(forecast.fold_predictions(_order_days(spark, sf), PRIORITY, seasonal=False), PRIORITY)
    return got.select("o_orderpriority", "candidate", "n_folds", "folds", *[F.round(c, 3).alias(c) for c in ("daily_mae", "daily_rmse")], F.round("horizon_total_ape", 5).alias("horizon_total_ape"))


def fc_selection(spark: SparkSession, sf: str) -> DataFrame:
    return forecast.select_candidate(forecast.scores(forecast.fold_predictions(_order_days(spark, sf), PRIORITY, seasonal=False), PRIORITY), PRIORITY)


def fc_selection_all(spark: SparkSession, sf: str) -> DataFrame:
    """The choice among all candidates, seasonal smoothing included."""
    return forecast.select_candidate(forecast.scores(forecast.fold_predictions(_order_days(spark, sf), PRIORITY), PRIORITY), PRIORITY)


def fc_expected_total(spark: SparkSession, sf: str) -> DataFrame:
    """Each category's forecast of free spend with what is committed in it."""
    by = ["category"]
    parts = obligations.components(tx_of(spark, sf), by)
    days = obligations.complete_calendar(parts.filter("component = 'discretionary'").select(*by, "date", F.col("amount").cast("double").alias("amount")), by, "date", "amount")
    totals = obligations.obligation_totals(obligations.known_obligations(parts, by, TIES), by)
    got = forecast.with_obligations(forecast.forecast(days, by), totals, by)
    whole = F.abs(F.col("total_expected") - F.col("committed") - F.col("discretionary")) < 0.01
    return got.select(*by, "status", F.col("n_days").cast("bigint").alias("n_days"), F.round("committed", 2).alias("committed"), (whole & (F.col("total_lower") <= F.col("total_upper"))).alias("adds_up"))


def fc_daily_band(spark: SparkSession, sf: str) -> DataFrame:
    got = forecast.residuals(_order_days(spark, sf), PRIORITY).groupBy(*PRIORITY).agg(F.expr("percentile(res_mean, array(0.025, 0.975))").alias("q"), F.avg("y").alias("m"))
    return got.select("o_orderpriority", F.round(F.greatest(F.lit(0.0), F.col("m") + F.col("q")[0]), 2).alias("lower"), F.round(F.col("m") + F.col("q")[1], 2).alias("upper"))


def fc_forecast(spark: SparkSession, sf: str) -> DataFrame:
    return forecast.forecast(_order_days(spark, sf), PRIORITY)


def fin_real_rate(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "customer").select("c_custkey", (F.abs("c_acctbal") / 10000).alias("n"))
    return rows.select("c_custkey", F.round(finance.real_rate(F.col("n"), F.lit(0.3)), 6).alias("real"), F.round(finance.monthly_rate(F.col("n")), 8).alias("monthly"))


def fin_scenarios(spark: SparkSession, sf: str) -> DataFrame:
    plans = read(spark, sf, "customer").filter("c_acctbal > 0").select("c_custkey", F.col("c_acctbal").alias("saving"), F.lit(20000.0).alias("expense"))
    return finance.simulate(plans, 3).select("c_custkey", "asset", "invested", "final_nominal", "final_real")


def fin_best_asset(spark: SparkSession, sf: str) -> DataFrame:
    plans = read(spark, sf, "customer").filter("c_acctbal > 0").select("c_custkey", F.col("c_acctbal").alias("saving"), F.lit(None).cast("double").alias("expense"))
    return finance.best_asset(finance.simulate(plans, 1), ["c_custkey"])


def _benchmark(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "benchmark").select("item_id", F.lower("text").alias("text"))


def ml_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    return features.terms(_benchmark(spark, sf), "item_id", "text").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


def ml_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    rows = _benchmark(spark, sf)
    counts = features.terms(rows, "item_id", "text")
    got = features.tfidf(counts, features.vocabulary(counts, rows.count()))
    return got.select(F.col("row_id").alias("item_id"), "term", F.round("weight", 6).alias("weight"))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with a simple score of quality, to evaluate."""
    docs = read(spark, sf, "documents").select("doc_id", "source", F.length("text").alias("n"))
    joined = docs.join(read(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    confidence = F.round(0.5 + F.pmod("n", F.lit(50)) / 100, 2)
    label = F.when(F.col("n") > 400, "1").otherwise("0")
    return joined.select("doc_id", "source", F.col("quality").cast("string").alias("truth"), label.alias("label"), confidence.alias("confidence"), (confidence < 0.55).alias("abstained"), (F.col("quality").cast("string") == label).alias("is_right"))


def ml_class_metrics(spark: SparkSession, sf: str) -> DataFrame:
    got = features.class_metrics(_scored(spark, sf))
    return got.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def ml_calibration(spark: SparkSession, sf: str) -> DataFrame:
    return features.calibration_error(_scored(spark, sf)).select(F.round("ece", 6).alias("ece"))


def ml_selective(spark: SparkSession, sf: str) -> DataFrame:
    got = features.selective_metrics(_scored(spark, sf), ["source"])
    return got.select("source", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "coverage", "selective_accuracy", "confident_wrong")])


def ml_word_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """Words of benchmark items by the summed weights of their n-grams."""
    rows = _benchmark(spark, sf)
    counts = features.terms(rows, "item_id", "text")
    phi = features.tfidf(counts, features.vocabulary(counts, rows.count())).withColumnRenamed("weight", "phi")
    got = features.word_attributions(rows, "item_id", "text", phi)
    return got.select(F.col("row_id").alias("item_id"), "pos", "word", F.round("value", 5).alias("value"))


QUERIES = {f.__name__: f for f in (
    fc_calendar, fc_weekday_mean, fc_folds, fc_scores, fc_selection, fc_selection_all, fc_daily_band, fc_forecast, fc_expected_total, fin_real_rate, fin_scenarios, fin_best_asset, ml_ngrams, ml_tfidf, ml_class_metrics, ml_calibration, ml_selective,
    ml_word_attribution,
)}

_DAYS = """
o AS (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS d, sum(o_totalprice) AS s FROM orders GROUP BY 1, 2),
e AS (SELECT o_orderpriority, unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS x FROM o GROUP BY 1),
days AS (SELECT e.o_orderpriority, CAST(x AS DATE) AS day, coalesce(s, 0.0) AS y, row_number() OVER (PARTITION BY e.o_orderpriority ORDER BY x) - 1 AS t,
         count(*) OVER (PARTITION BY e.o_orderpriority) AS n FROM e LEFT JOIN o ON o.o_orderpriority = e.o_orderpriority AND o.d = CAST(x AS DATE))"""
_FOLDS = (
    _DAYS
    + """, z AS (SELECT o_orderpriority, max(n) AS n FROM days GROUP BY 1), f0 AS (SELECT *, least(3, CAST(floor((n - 14) / 14) AS INTEGER)) AS k FROM z),
f AS (SELECT o_orderpriority, n, CASE WHEN k >= 1 THEN k ELSE 1 END AS n_folds, CASE WHEN k >= 1 THEN 14 ELSE 7 END AS h FROM f0 WHERE k >= 1 OR n >= 21),
folds AS (SELECT o_orderpriority, CAST(n_folds AS INTEGER) AS n_folds, CAST(h AS INTEGER) AS h, CAST(fold AS INTEGER) AS fold, CAST(n - fold * h AS INTEGER) AS cut FROM (SELECT *, unnest(range(1, n_folds + 1)) AS fold FROM f))"""
)
_SCORES = (
    _FOLDS
    + """, pr AS (SELECT d.*, fold, cut, h, n_folds, isodow(day) AS dow FROM days d JOIN folds USING (o_orderpriority) WHERE t < cut + h),
mean AS (SELECT o_orderpriority, fold, avg(y) AS m FROM pr WHERE t < cut GROUP BY 1, 2), dm AS (SELECT o_orderpriority, fold, dow, avg(y) AS m FROM pr WHERE t < cut GROUP BY 1, 2, 3),
p AS (SELECT pr.o_orderpriority, pr.fold, n_folds, y, 'run_rate' AS candidate, mean.m AS pred FROM pr JOIN mean USING (o_orderpriority, fold) WHERE t >= cut
      UNION ALL SELECT pr.o_orderpriority, pr.fold, n_folds, y, 'weekday_mean', coalesce(dm.m, mean.m) FROM pr JOIN mean USING (o_orderpriority, fold) LEFT JOIN dm ON dm.o_orderpriority = pr.o_orderpriority AND dm.fold = pr.fold AND dm.dow = pr.dow WHERE t >= cut AND cut >= 28),
s AS (SELECT o_orderpriority, candidate, fold, n_folds, avg(abs(y - pred)) AS mae, sqrt(avg((y - pred) * (y - pred))) AS rmse, abs(sum(y) - sum(pred)) / greatest(sum(y), 1.0) AS ape FROM p GROUP BY 1, 2, 3, 4),
sc AS (SELECT o_orderpriority, candidate, n_folds, count(*) AS folds, avg(mae) AS daily_mae, avg(rmse) AS daily_rmse, avg(ape) AS ape FROM s GROUP BY 1, 2, 3)"""
)
_GRAMS = """
w AS (SELECT item_id, u.pos - 1 AS pos, u.word AS word FROM (SELECT item_id, unnest(list_transform(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> ''), lambda x, i: struct_pack(pos := i, word := x))) AS u FROM benchmark)),
g AS (SELECT item_id, pos, word, unnest(flatten(list_transform(range(2, greatest(least(5, length(word) + 2), 2) + 1),
      lambda n: CASE WHEN length(word) + 2 > n THEN list_transform(range(1, length(word) + 2 - n + 2), lambda i: substr(' ' || word || ' ', i, n)) ELSE [' ' || word || ' '] END))) AS term FROM w),
c AS (SELECT item_id, term, count(*) AS tf FROM g GROUP BY 1, 2)"""
_TFIDF = (
    _GRAMS
    + """, v0 AS (SELECT term, count(*) AS df, sum(tf) AS total FROM c GROUP BY 1 HAVING count(*) >= 2), v AS (SELECT *, ln((1.0 + (SELECT count(*) FROM benchmark)) / (1 + df)) + 1 AS idf FROM v0 ORDER BY total DESC, term LIMIT 20000),
r AS (SELECT item_id, term, (1 + ln(tf)) * idf AS x FROM c JOIN v USING (term)), tfidf AS (SELECT item_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY item_id)) AS weight FROM r)"""
)
_EVAL = """sc AS (SELECT d.doc_id, source, CAST(quality AS VARCHAR) AS truth, CASE WHEN length(text) > 400 THEN '1' ELSE '0' END AS label, round(0.5 + (length(text) % 50) / 100, 2) AS confidence FROM documents d JOIN labels USING (doc_id)),
ev AS (SELECT *, confidence < 0.55 AS abstained, truth = label AS is_right FROM sc)"""
_ASSETS = " UNION ALL ".join(f"SELECT '{a}' AS asset, CAST({r} AS DOUBLE) AS r" for a, r in finance.RETURNS.items())


def _annuity(saving: str, g: str, n: int) -> str:
    return f"round({saving} * ({g}) * (pow({g}, {n}) - 1) / (({g}) - 1), 2)"


ORACLE_SQL = {
    "fc_calendar": """WITH o AS (SELECT user_id, CAST(ts AS DATE) AS d, sum(value) AS s FROM events WHERE event_type = 'purchase' GROUP BY 1, 2), e AS (SELECT user_id, unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS x FROM o GROUP BY 1)
      SELECT e.user_id, CAST(x AS DATE) AS day, round(coalesce(s, 0.0), 4) AS y FROM e LEFT JOIN o ON o.user_id = e.user_id AND o.d = CAST(x AS DATE)""",
    "fc_weekday_mean": f"WITH {_DAYS} SELECT o_orderpriority, day, round(y - avg(y) OVER (PARTITION BY o_orderpriority), 2) AS res_mean, round(y - avg(y) OVER (PARTITION BY o_orderpriority, isodow(day)), 2) AS res_dow FROM days",
    "fc_folds": f"WITH {_FOLDS} SELECT * FROM folds",
    "fc_scores": f"WITH {_SCORES} SELECT o_orderpriority, candidate, n_folds, folds, round(daily_mae, 3) AS daily_mae, round(daily_rmse, 3) AS daily_rmse, round(ape, 5) AS horizon_total_ape FROM sc",
    "fc_selection": f"WITH {_SCORES} SELECT o_orderpriority, candidate AS selected FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY daily_rmse, candidate) AS rn FROM sc WHERE folds = n_folds) WHERE rn = 1",
    "fc_daily_band": f"""WITH {_DAYS}, m AS (SELECT *, avg(y) OVER (PARTITION BY o_orderpriority) AS a FROM days)
      SELECT o_orderpriority, round(greatest(0.0, max(a) + quantile_cont(y - a, 0.025)), 2) AS lower, round(max(a) + quantile_cont(y - a, 0.975), 2) AS upper FROM m GROUP BY 1""",
    "fc_expected_total": f"""WITH {TX_SQL}, {_KNOWN.replace("statement", "category")}, free AS (SELECT category, CAST(date_diff('day', min(date), max(date)) + 1 AS BIGINT) AS n_days FROM comp WHERE component = 'discretionary' GROUP BY 1),
      t AS (SELECT category, round(CAST(CAST(sum(amount) AS {WIDE}) AS DOUBLE), 2) AS committed FROM due GROUP BY 1)
      SELECT category, CASE WHEN n_days >= 14 THEN 'ok' ELSE 'insufficient_data' END AS status, n_days, coalesce(committed, 0.0) AS committed, CASE WHEN n_days >= 14 THEN true END AS adds_up FROM free LEFT JOIN t USING (category)""",
    "fin_real_rate": "SELECT c_custkey, round((1 + abs(c_acctbal) / 10000) / 1.3 - 1, 6) AS real, round(pow(1 + abs(c_acctbal) / 10000, 1.0 / 12) - 1, 8) AS monthly FROM customer",
    "fin_scenarios": f"""WITH a AS ({_ASSETS}) SELECT c_custkey, asset, round(c_acctbal * 36, 2) AS invested, {_annuity("c_acctbal", "pow(1 + r, 1.0 / 12)", 36)} AS final_nominal,
      {_annuity("c_acctbal", "pow((1 + r) / 1.3, 1.0 / 12)", 36)} AS final_real FROM customer, a WHERE c_acctbal > 0""",
    "fin_best_asset": f"""WITH a AS ({_ASSETS}), s AS (SELECT c_custkey, asset, {_annuity("c_acctbal", "pow((1 + r) / 1.3, 1.0 / 12)", 12)} AS final_real FROM customer, a WHERE c_acctbal > 0)
      SELECT c_custkey, asset, final_real FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY final_real DESC, asset) AS rn FROM s) WHERE rn = 1""",
    "ml_ngrams": f"WITH {_GRAMS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM c GROUP BY 1",
    "ml_tfidf": f"WITH {_TFIDF} SELECT item_id, term, round(weight, 6) AS weight FROM tfidf",
    "ml_class_metrics": f"""WITH {_EVAL}, k AS (SELECT unnest(['0', '1']) AS class), m AS (SELECT class, count(*) FILTER (truth = class AND label = class) AS tp, count(*) FILTER (truth = class) AS support, count(*) FILTER (label = class) AS predicted FROM ev, k GROUP BY 1),
      q AS (SELECT class, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r, support FROM m)
      SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, support FROM q""",
    "ml_calibration": f"""WITH {_EVAL}, b AS (SELECT ceil(confidence * 10) AS b, count(*) AS n, abs(avg(CASE WHEN is_right THEN 1.0 ELSE 0.0 END) - avg(confidence)) AS gap FROM ev GROUP BY 1)
      SELECT round(sum(n * gap) / (SELECT count(*) FROM ev), 6) AS ece FROM b WHERE b >= 1""",
    "ml_selective": f"""WITH {_EVAL} SELECT source, count(*) AS n, round(avg(CASE WHEN is_right THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(CASE WHEN abstained THEN 0.0 ELSE 1.0 END), 6) AS coverage,
      round(avg(CASE WHEN is_right THEN 1.0 ELSE 0.0 END) FILTER (NOT abstained), 6) AS selective_accuracy, round(avg(CASE WHEN NOT is_right AND confidence >= 0.9 AND NOT abstained THEN 1.0 ELSE 0.0 END), 6) AS confident_wrong FROM ev GROUP BY 1""",
    "ml_word_attribution": f"""WITH {_TFIDF}, k AS (SELECT item_id, pos, word, term, count(*) AS c FROM g GROUP BY 1, 2, 3, 4), s AS (SELECT *, c / sum(c) OVER (PARTITION BY item_id, term) AS part FROM k)
      SELECT s.item_id, CAST(s.pos AS INTEGER) AS pos, s.word, round(sum(part * weight), 5) AS value FROM s JOIN tfidf t ON t.item_id = s.item_id AND t.term = s.term GROUP BY 1, 2, 3""",
}
