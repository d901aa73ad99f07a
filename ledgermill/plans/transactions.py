"""Queries over transactions (bound to the order tables) and events, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import anomaly, copilot, history, isolation, merging, obligations, selection
from ..schema import TX_SQL, copilot_refund, copilot_spend, dashboard_spend, read, tx_of
from ..sources import storage

BY = ["statement"]
TIES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
SPENT = "amount > 0 AND transaction_type NOT IN ('PAYMENT', 'POINT_REDEMPTION')"
BACK = "amount < 0 AND transaction_type <> 'PAYMENT'"
WIDE = "DECIMAL(38,2)"
#: Rows that a task sorts where keys are as many as rows.
KEY_ROWS = 1 << 18


def agg_kpis(spark: SparkSession, sf: str) -> DataFrame:
    return agg.kpis(tx_of(spark, sf), BY).drop("n_anomalies")


def agg_category_totals(spark: SparkSession, sf: str) -> DataFrame:
    return agg.spend_by(tx_of(spark, sf).filter(dashboard_spend()), [], "category")


def agg_top_n_other(spark: SparkSession, sf: str) -> DataFrame:
    spent = agg.spend_by(tx_of(spark, sf).filter(copilot_spend()), [], "clean_description")
    return agg.top_n_with_other(spent, [], "clean_description").select("rank", "clean_description", "total")


def agg_colour_slots(spark: SparkSession, sf: str) -> DataFrame:
    spent = agg.spend_by(tx_of(spark, sf).filter(copilot_spend()), [], "clean_description")
    return agg.colour_slots(agg.top_n_with_other(spent, [], "clean_description", 9), "clean_description").select("rank", "clean_description", "slot")


def agg_daily_spend(spark: SparkSession, sf: str) -> DataFrame:
    return tx_of(spark, sf).filter(dashboard_spend()).groupBy("date").agg(agg.total(F.col("amount")).alias("total"))


def agg_top_merchants(spark: SparkSession, sf: str) -> DataFrame:
    return agg.top_merchants(tx_of(spark, sf).filter(copilot_spend()), ["category"], 3)


def agg_merchant_share(spark: SparkSession, sf: str) -> DataFrame:
    return agg.relative_frequency(read(spark, sf, "events"), ["user_id"], "event_type").select("user_id", "event_type", "n", F.round("share", 6).alias("share"))


def agg_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "events")
    exact = selection.quantiles(rows, ["event_type"], {"q": "value"}, [0.5, 0.9]).withColumnRenamed("event_type", "of")
    counted = rows.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count(F.lit(1)).alias("n"))
    both = counted.join(exact, F.col("event_type").eqNullSafe(F.col("of")))
    return both.select("event_type", F.round(F.col("q")[0], 4).alias("median_value"), F.round(F.col("q")[1], 4).alias("q90_value"), "users", "n")


def qa_summary(spark: SparkSession, sf: str) -> DataFrame:
    return agg.summary(tx_of(spark, sf), BY)


def qa_category_spend(spark: SparkSession, sf: str) -> DataFrame:
    return agg.category_spend(tx_of(spark, sf), BY)


def qa_compare_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Each entity's two largest categories and their difference."""
    top = agg.ranked(agg.spend_by(tx_of(spark, sf).filter(copilot_spend()), BY, "category"), BY, "category").filter("rank <= 2")
    one = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    pairs = top.groupBy(*BY).agg(one(1, "category").alias("first_category"), one(2, "category").alias("second_category"), one(1, "total").alias("first_total"), one(2, "total").alias("second_total"))
    return pairs.withColumn("difference", (F.col("first_total") - F.coalesce("second_total", F.lit(0))).cast("decimal(38,2)"))


def qa_merchant_spend(spark: SparkSession, sf: str) -> DataFrame:
    """Spend at merchants with a word that starts as the token says, per statement."""
    rows = tx_of(spark, sf).filter(copilot_spend() & F.lower("clean_description").rlike(r"(?<![a-z])small"))
    return rows.groupBy(*BY).agg(agg.total(F.col("amount")).alias("gross_spend"), F.count(F.lit(1)).alias("n"))


def qa_top_share(spark: SparkSession, sf: str) -> DataFrame:
    """What each entity's five top merchants cover of its spend."""
    spent = agg.ranked(agg.spend_by(tx_of(spark, sf).filter(copilot_spend()), BY, "clean_description"), BY, "clean_description")
    sums = spent.groupBy(*BY).agg(agg.total(F.when(F.col("rank") <= 5, F.col("total"))).alias("covered"), agg.total(F.col("total")).alias("total"))
    return sums.withColumn("covered_pct", F.round(100 * F.col("covered").cast("double") / F.col("total").cast("double"), 1))


def qa_refunds(spark: SparkSession, sf: str) -> DataFrame:
    return tx_of(spark, sf).filter(copilot_refund()).select("statement", "date", "clean_description", (-F.col("amount")).cast("decimal(18,2)").alias("refund"))


def qa_savings(spark: SparkSession, sf: str) -> DataFrame:
    """The largest category of each entity, a fifth of it saved each month for three years in the reference fund."""
    from ..functions.finance import INFLATION, RETURNS, final_value, monthly_rate, real_rate

    spent = agg.ranked(agg.spend_by(tx_of(spark, sf).filter(copilot_spend()), BY, "category"), BY, "category").filter("rank = 1")
    saving = F.round(F.col("total").cast("double") * 0.2, 2)
    rate = monthly_rate(real_rate(F.lit(RETURNS["Para Piyasası / Mevduat Fonu"]), F.lit(INFLATION)))
    return spent.select("statement", "category", "total", saving.alias("monthly_saving"), F.round(final_value(saving, rate, F.lit(36)), 2).alias("final_real"))


def _questioned(spark: SparkSession, sf: str) -> DataFrame:
    """Transactions as the question tools take them, with the tools' own categories, dealt by part."""
    names = F.array(*[F.lit(name) for name, _, _ in copilot.CATEGORIES])
    return copilot.normalise(tx_of(spark, sf).withColumn("category", F.get(names, F.pmod("l_partkey", F.lit(len(copilot.CATEGORIES))).cast("int"))))


def tool_category_spend(spark: SparkSession, sf: str) -> DataFrame:
    rows = copilot.tool_category_spend(_questioned(spark, sf), BY, 2)
    return rows.select("statement", "category", "gross_spend", "refunds", "net_spend", "transaction_count", "total_spend", "share_pct")


def tool_compare_categories(spark: SparkSession, sf: str) -> DataFrame:
    rows = copilot.tool_compare_categories(_questioned(spark, sf), BY, [0, 3, 10])
    return rows.select("statement", "category", "gross_spend", F.col("difference").cast("decimal(38,2)").alias("difference"), "rank")


def tool_merchant_spend(spark: SparkSession, sf: str) -> DataFrame:
    return copilot.tool_merchant_spend(_questioned(spark, sf), BY, "small")


def tool_top_share(spark: SparkSession, sf: str) -> DataFrame:
    return copilot.tool_top_share(_questioned(spark, sf), BY)


def tool_refunds(spark: SparkSession, sf: str) -> DataFrame:
    rows = copilot.render_items(copilot.tool_refunds(_questioned(spark, sf)), "clean_description", "amount")
    return rows.select("statement", "l_orderkey", "l_linenumber", F.col("amount").cast("decimal(18,2)").alias("amount"), "answer")


def tool_savings(spark: SparkSession, sf: str) -> DataFrame:
    return copilot.tool_savings(_questioned(spark, sf), BY).select("statement", "category", "total", "monthly_saving", F.round("final_real", 1).alias("final_real"))


def tool_obligations(spark: SparkSession, sf: str) -> DataFrame:
    rows = copilot.render_items(copilot.tool_obligations(tx_of(spark, sf), BY, TIES), "description", "amount")
    return rows.select("statement", "kind", "amount", "answer")


def rel_membership(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with a refund, and those without, by semi and anti join."""
    customers = read(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("statement"))
    refunds = tx_of(spark, sf).filter(copilot_refund()).select("statement")
    return customers.join(refunds, "statement", "left_semi").withColumn("refunded", F.lit(True)).unionByName(customers.join(refunds, "statement", "left_anti").withColumn("refunded", F.lit(False)))


def rel_first_copy(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").withColumn("digest", F.md5("text"))
    return merging.first_per_key(docs, ["digest"], ["doc_id"]).select("doc_id", "digest", "is_first")


def rel_repeated_statements(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as statements of one bank per priority: later equal ones are errors."""
    rows = read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("upload_no"), F.col("o_orderpriority").alias("bank_name"), F.col("o_orderdate").cast("date").alias("period_end"), F.lit(0).cast("decimal(18,2)").alias("total_debt"), F.lit(1).alias("transaction_count")
    )
    kept, errors = merging.skip_repeated_statements(rows, "upload_no")
    return merging.union_all([kept.select("upload_no", F.lit("kept").alias("state")), errors.select("upload_no", F.col("error").alias("state"))])


def rel_union_order(spark: SparkSession, sf: str) -> DataFrame:
    """The place of each row in the union of refunds and spend, by date, part and ties: rows of earlier days, and its place in the day."""
    tx = tx_of(spark, sf)
    both = merging.union_all([tx.filter(copilot_spend()).withColumn("part", F.lit(1)), tx.filter(copilot_refund()).withColumn("part", F.lit(2))])
    placed = merging.places(both, "date", ["part", *TIES])
    return placed.select("date", "part", "l_orderkey", "l_linenumber", "l_partkey", "place")


def win_robust_z(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "lang", F.log1p(F.col("n_chars").cast("double")).alias("x"))
    return anomaly.robust_z(docs, "x", ["lang"]).select("doc_id", F.round("z", 4).alias("z"), "z_n")


def win_amount_outliers(spark: SparkSession, sf: str) -> DataFrame:
    events = read(spark, sf, "events").select("event_id", F.col("event_type").alias("category"), F.col("value").alias("amount")).filter("amount > 0")
    got = anomaly.amount_outliers(events.withColumn("one", F.lit(1)), ["one"])
    return got.select("event_id", F.round("z", 4).alias("z"), F.round("ratio", 4).alias("ratio"), "is_outlier")


def win_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("merchant"), F.col("ts").cast("date").alias("date"), F.round("value", 0).alias("amount"))
    return anomaly.duplicate_charges(rows, [], "merchant", ["event_id"]).select("event_id", "is_duplicate")


def win_novel(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("merchant"), F.col("o_totalprice").alias("amount"), F.col("o_orderdate").cast("date").alias("date"))
    cut = F.lit("1996-01-01").cast("date")
    got = anomaly.novel_merchants(rows.filter(F.col("date") >= cut), rows.filter(F.col("date") < cut), [], "merchant")
    return got.select("o_orderkey", "is_novel")


def win_forest_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("date").alias("date"), F.abs("value").alias("amount"), F.col("event_type").alias("merchant"))
    got = anomaly.forest_features(rows, ["user_id"], "merchant")
    return got.select("event_id", *[F.round(c, 6).alias(c) for c in ("log_amount", "merchant_frequency", "dow_sin", "dow_cos")])


def win_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Days since the same user's previous event of the kind."""
    rows = read(spark, sf, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("date").alias("date"))
    return rows.select("event_id", F.expr("datediff(date, lag(date) over (partition by user_id, event_type order by date, event_id))").alias("gap"))


def win_detect_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    got = anomaly.detect_anomalies(tx_of(spark, sf), BY, TIES, forest=False)
    return got.groupBy("statement", "anomaly_type").agg(F.count(F.lit(1)).alias("n"), F.max("anomaly_score").alias("top_score"))


def win_anomaly_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """What is odd from 1996 on, with the years before as history: every kind and its reason in words."""
    rows, cut = tx_of(spark, sf), F.lit("1996-01-01").cast("date")
    got = anomaly.detect_anomalies(rows.filter(F.col("date") >= cut), BY, TIES, rows.filter(F.col("date") < cut))
    return got.filter("is_anomaly").select("statement", "l_orderkey", "l_linenumber", "amount", "anomaly_type", "anomaly_score", "anomaly_reason")


def rel_recomputed(spark: SparkSession, sf: str) -> DataFrame:
    """Anomalies of all customers after the uploads since October 2001, a month each, came to stored histories.

    Only customers with a new upload are judged anew; the result is that of judging everybody
    over everything. August 2001 comes twice, the second time under another name, and once
    more under its own, and counts once.
    """
    judge = lambda rows: anomaly.detect_anomalies(rows, BY, TIES, forest=False)
    # Rows of an update come from joins, which each reader of them would run again.
    again_judged = lambda rows: judge(storage.materialize(rows))
    rows = storage.materialize(tx_of(spark, sf).withColumn("upload", F.date_format("date", "yyyy-MM")))
    cut, again = F.lit("2001-10-01").cast("date"), rows.filter("upload = '2001-08'")
    path = f"{storage.shared_dir(spark)}/history-{uuid.uuid4().hex}"
    history.write_history(judge(rows.filter(F.col("date") < cut)), path, BY, 16)
    news = merging.union_all([rows.filter(F.col("date") >= cut), again, again.withColumn("upload", F.lit("copy of 2001-08"))])
    history.update_history(spark, path, news, BY, "upload", again_judged, 16)
    now = history.read_history(spark, path)
    return now.groupBy("statement", "anomaly_type").agg(F.count(F.lit(1)).alias("n"), F.max("anomaly_score").alias("top_score"))


def win_isolation_forest(spark: SparkSession, sf: str) -> DataFrame:
    """Forest scores and flags of all rows; z to one digit, since a z of 0.6745 is common and no last bit decides its third."""
    got = anomaly.detect_anomalies(tx_of(spark, sf), BY, TIES)
    return got.select("statement", "l_orderkey", "l_linenumber", F.round("anomaly_score", 1).alias("anomaly_score"), "iforest_score", "is_anomaly")


def obl_rhythms(spark: SparkSession, sf: str) -> DataFrame:
    table = read(spark, sf, "lineitem")
    rows = storage.dealt(table.select("l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"), table.count(), KEY_ROWS, "l_partkey", "l_suppkey").select("l_partkey", "l_suppkey", F.col("l_shipdate").cast("date").alias("date"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))
    return obligations.rhythms(rows, [], ["l_partkey", "l_suppkey"])


def obl_components(spark: SparkSession, sf: str) -> DataFrame:
    return obligations.components(tx_of(spark, sf), BY).groupBy("statement", "component").agg(F.count(F.lit(1)).alias("n"), agg.total(F.col("amount")).alias("total"))


def obl_known(spark: SparkSession, sf: str) -> DataFrame:
    return obligations.known_obligations(obligations.components(tx_of(spark, sf), BY), BY, TIES)


def obl_totals(spark: SparkSession, sf: str) -> DataFrame:
    return obligations.obligation_totals(obl_known(spark, sf), BY)


QUERIES = {f.__name__: f for f in (
    agg_kpis, agg_category_totals, agg_top_n_other, agg_colour_slots, agg_daily_spend, agg_top_merchants, agg_merchant_share, agg_quantiles, qa_summary, qa_category_spend, qa_compare_categories,
    qa_merchant_spend, qa_top_share, qa_refunds, qa_savings, rel_membership, rel_first_copy, rel_repeated_statements, rel_union_order, win_robust_z, win_amount_outliers, win_duplicates, win_novel,
    win_forest_features, win_gaps, rel_recomputed, win_detect_anomalies, win_anomaly_reasons, win_isolation_forest, tool_category_spend, tool_compare_categories, tool_merchant_spend, tool_top_share, tool_refunds, tool_savings, tool_obligations, obl_rhythms, obl_components, obl_known, obl_totals,
)}

_COMPONENTS = """
pop AS (SELECT * FROM tx WHERE amount > 0 AND date IS NOT NULL AND transaction_type NOT IN ('REFUND', 'PAYMENT', 'POINT_REDEMPTION')),
gaps AS (
  SELECT statement, clean_description, amount, date_diff('day', lag(date) OVER (PARTITION BY statement, clean_description ORDER BY date), date) AS gap
  FROM pop WHERE installment_no IS NULL
),
subs AS (
  SELECT statement, clean_description FROM gaps GROUP BY ALL
  HAVING count(*) >= 2 AND bool_and(gap BETWEEN 25 AND 35) AND max(amount) - min(amount) <= max(amount) * CAST(0.10 AS DECIMAL(4,2))
),
comp AS (
  SELECT p.*, CASE WHEN p.installment_no IS NOT NULL THEN 'installment' WHEN s.statement IS NOT NULL OR lower(p.category) LIKE '%abonelik%' THEN 'subscription'
              WHEN p.transaction_type = 'FINANCING_FEE' THEN 'fee' ELSE 'discretionary' END AS component
  FROM pop p LEFT JOIN subs s ON p.statement = s.statement AND p.clean_description = s.clean_description
)"""
_KNOWN = (
    _COMPONENTS
    + """,
recent AS (
  SELECT * FROM (SELECT *, max(date) OVER (PARTITION BY statement) AS newest FROM comp WHERE component = 'installment') WHERE date >= newest - INTERVAL 35 DAY
),
latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (
      PARTITION BY statement, regexp_replace(clean_description, '[0-9]+', '#', 'g'), coalesce(installment_total, -1), round_even(amount, 0)
      ORDER BY installment_no DESC, date DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM recent) WHERE rn = 1
),
latest_subs AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY statement, clean_description ORDER BY date DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn
                 FROM comp WHERE component = 'subscription') WHERE rn = 1
),
due AS (
  SELECT statement, 'installment' AS kind, clean_description AS description, amount, CAST(installment_no + 1 AS INTEGER) AS next_installment, installment_total,
         CAST(installment_total - installment_no - 1 AS INTEGER) AS remaining_after_next
  FROM latest WHERE installment_total IS NULL OR installment_no < installment_total
  UNION ALL
  SELECT statement, 'subscription', clean_description, amount, CAST(NULL AS INTEGER), CAST(NULL AS INTEGER), CAST(NULL AS INTEGER) FROM latest_subs
)"""
)


def _z(x: str, part: str, src: str, keep: str) -> str:
    return f"""
  SELECT {keep}, CASE WHEN mad > 0 THEN 0.6745 * ({x} - med) / mad WHEN aad > 0 THEN ({x} - med) / (1.253314 * aad) ELSE 0 END AS z, n
  FROM (SELECT *, median(abs({x} - med)) OVER (PARTITION BY {part}) AS mad, avg(abs({x} - med)) OVER (PARTITION BY {part}) AS aad
        FROM (SELECT *, median({x}) OVER (PARTITION BY {part}) AS med, count(*) OVER (PARTITION BY {part}) AS n FROM {src}))"""


_ANOMALY = """
spend AS (
  SELECT *, count(*) OVER (PARTITION BY statement) AS spend_n, ln(1 + CAST(amount AS DOUBLE)) AS lg, CAST(amount AS DOUBLE) AS v
  FROM tx WHERE amount > 0 AND transaction_type IN ('EXPENSE', 'INSTALLMENT', 'FINANCING_FEE')
),
j AS (SELECT * FROM spend WHERE spend_n >= 5),
m AS (
  SELECT *, median(lg) OVER (PARTITION BY statement) AS am, median(lg) OVER (PARTITION BY statement, category) AS cm, count(*) OVER (PARTITION BY statement, category) AS cn,
         median(v) OVER (PARTITION BY statement) AS av, median(v) OVER (PARTITION BY statement, category) AS cv FROM j
),
d AS (
  SELECT *, median(abs(lg - am)) OVER (PARTITION BY statement) AS amad, avg(abs(lg - am)) OVER (PARTITION BY statement) AS aaad,
         median(abs(lg - cm)) OVER (PARTITION BY statement, category) AS cmad, avg(abs(lg - cm)) OVER (PARTITION BY statement, category) AS caad FROM m
),
s AS (
  SELECT *, CASE WHEN cn >= 5 THEN CASE WHEN cmad > 0 THEN 0.6745 * (lg - cm) / cmad WHEN caad > 0 THEN (lg - cm) / (1.253314 * caad) ELSE 0 END
                 ELSE CASE WHEN amad > 0 THEN 0.6745 * (lg - am) / amad WHEN aaad > 0 THEN (lg - am) / (1.253314 * aaad) ELSE 0 END END AS z,
         v / greatest(CASE WHEN cn >= 5 THEN cv ELSE av END, 1.0) AS ratio,
         date_diff('day', lag(date) OVER (PARTITION BY statement, clean_description, amount, installment_no IS NULL
             ORDER BY date, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice), date) AS gap
  FROM d
),
told AS (
  SELECT statement, concat_ws('+', CASE WHEN installment_no IS NULL AND gap <= 3 THEN 'duplicate_charge' END, CASE WHEN z > 3.5 AND ratio >= 2 THEN 'amount_outlier' END) AS anomaly_type,
         round(greatest(z, 0), 3) AS anomaly_score FROM s
  UNION ALL SELECT statement, '', 0 FROM spend WHERE spend_n < 5
  UNION ALL SELECT statement, '', 0 FROM tx WHERE NOT (amount > 0 AND transaction_type IN ('EXPENSE', 'INSTALLMENT', 'FINANCING_FEE'))
)"""

_PRIME = isolation.PRIME


def _forest(src: str, entity: str, row: list[str], features: list[str], ties: list[str]) -> str:
    """Tables that grow the isolation forests of ``src`` level by level (nodes) and score its rows (iforest: row, score)."""
    hex_of = lambda text, at: f"CAST('0x' || substr(md5({text}), {at}, 15) AS BIGINT)"
    name = " || ':' || ".join(f"coalesce(CAST({t} AS VARCHAR), '')" for t in ties)
    key, levels = ", ".join(row), range((isolation.SAMPLE - 1).bit_length() + 1)
    path = lambda n: f"CASE WHEN {n} > 2 THEN 2 * (ln({n} - 1) + 0.5772156649015329) - 2 * ({n} - 1) / {n} WHEN {n} = 2 THEN 1.0 ELSE 0.0 END"
    ranges = ", ".join(f"min(f[{k}]) AS lo{k}, max(f[{k}]) AS hi{k}" for k in range(1, len(features) + 1))
    lists = f"[{', '.join(f'lo{k}' for k in range(1, len(features) + 1))}] AS lo, [{', '.join(f'hi{k}' for k in range(1, len(features) + 1))}] AS hi"
    steps = [
        f"""src AS MATERIALIZED (SELECT {entity} AS e, {key}, [{", ".join(f"CAST({f} AS DOUBLE)" for f in features)}] AS f, row_number() OVER (PARTITION BY {entity} ORDER BY {hex_of(f"'42:' || {name}", 1)}, {", ".join(ties)}) AS r, count(*) OVER (PARTITION BY {entity}) AS many FROM {src}),
tree AS MATERIALIZED (SELECT t, 1 + {hex_of("'42:' || t", 1)} % {_PRIME - 1} AS a FROM (SELECT unnest(range(0, {isolation.TREES})) AS t)),
draw AS MATERIALIZED (SELECT t, k, {hex_of("'42:' || t || ':' || k", 1)} / pow(16.0, 15) AS u, {hex_of("'42:' || t || ':' || k", 16)} / pow(16.0, 15) AS w FROM tree, (SELECT unnest(range(0, {2 ** len(levels) - 1})) AS k)),
size AS (SELECT e, least({isolation.SAMPLE}, {isolation.POOL}, max(many)) AS size FROM src GROUP BY 1),
p0 AS MATERIALIZED (SELECT e, t, 0 AS k, f, CAST(ceil(log2(greatest(size, 2))) AS INTEGER) AS most FROM (SELECT src.e, t, f, size, row_number() OVER (PARTITION BY src.e, t ORDER BY r * a % {_PRIME}) AS n FROM src JOIN size ON size.e = src.e CROSS JOIN tree WHERE r <= {isolation.POOL}) WHERE n <= size)"""
    ]
    for d in levels:
        steps.append(f"""n{d} AS MATERIALIZED (SELECT e, t, k, CASE WHEN leaf THEN NULL ELSE axis END AS axis, CASE WHEN leaf THEN NULL ELSE lo[axis] + w * (hi[axis] - lo[axis]) END AS cut, CASE WHEN leaf THEN {d} + {path("c")} END AS depth
  FROM (SELECT *, {d} >= most OR c < 2 OR len(ways) = 0 AS leaf, ways[1 + CAST(floor(u * len(ways)) AS INTEGER)] AS axis
    FROM (SELECT *, list_filter(range(1, {len(features) + 1}), lambda i: hi[i] > lo[i]) AS ways FROM (SELECT e, t, k, most, c, {lists} FROM (SELECT e, t, k, most, count(*) AS c, {ranges} FROM p{d} GROUP BY 1, 2, 3, 4))) JOIN draw USING (t, k)))""")
        if d + 1 < len(levels):
            steps.append(f"p{d + 1} AS MATERIALIZED (SELECT p.e, p.t, 2 * p.k + CASE WHEN p.f[axis] >= cut THEN 2 ELSE 1 END AS k, p.f, p.most FROM p{d} p JOIN n{d} n ON n.e = p.e AND n.t = p.t AND n.k = p.k WHERE axis IS NOT NULL)")
    steps.append(f"s0 AS MATERIALIZED (SELECT e, {key}, f, t, 0 AS k FROM src CROSS JOIN tree)")
    own = ", ".join(f"s.{r}" for r in row)
    for d in levels:
        steps.append(f"h{d} AS MATERIALIZED (SELECT s.e, {own}, s.f, s.t, s.k, axis, cut, depth FROM s{d} s JOIN n{d} n ON n.e = s.e AND n.t = s.t AND n.k = s.k)")
        if d + 1 < len(levels):
            steps.append(f"s{d + 1} AS MATERIALIZED (SELECT e, {key}, f, t, 2 * k + CASE WHEN f[axis] >= cut THEN 2 ELSE 1 END AS k FROM h{d} WHERE axis IS NOT NULL)")
    ends = " UNION ALL ".join(f"SELECT e, {key}, depth FROM h{d} WHERE axis IS NULL" for d in levels)
    steps.append(f"iforest AS (SELECT {', '.join('z.' + r for r in row)}, pow(2.0, -avg(depth) / greatest(any_value({path('size')}), 1e-9)) AS score FROM ({ends}) z JOIN size ON size.e = z.e GROUP BY {', '.join('z.' + r for r in row)})")
    return ",\n".join(steps)


_NAMES = "[" + ", ".join(f"'{name}'" for name, _, _ in copilot.CATEGORIES) + "]"
_QUESTIONED = f"{TX_SQL}, q AS (SELECT * EXCLUDE (category), list_extract({_NAMES}, CAST(l_partkey % {len(copilot.CATEGORIES)} AS INTEGER) + 1) AS category FROM tx)"
_TL = "translate(format('{{:,.2f}}', CAST({} AS DOUBLE)), ',.', '.,') || ' TL'"
_FEATURES = f"""
ff AS MATERIALIZED (SELECT *, row_number() OVER () AS rid, count(*) OVER (PARTITION BY statement, clean_description) / count(*) OVER (PARTITION BY statement) AS mf,
  sin(2 * pi() * (isodow(date) - 1) / 7) AS ds, cos(2 * pi() * (isodow(date) - 1) / 7) AS dc FROM s),
{_forest("(SELECT * FROM ff WHERE spend_n >= 30)", "statement", ["rid"], ["lg", "z", "mf", "ds", "dc"], TIES)}"""
_SINCE = (
    _ANOMALY[: _ANOMALY.index("told AS (")].replace("FROM tx WHERE amount > 0 AND", "FROM tx WHERE date >= DATE '1996-01-01' AND amount > 0 AND")
    + _FEATURES
    + """,
h AS (SELECT * FROM tx WHERE date < DATE '1996-01-01'),
hl AS (SELECT statement, count(*) AS hn, quantile_cont(CASE WHEN amount > 0 THEN CAST(amount AS DOUBLE) END, 0.9) AS lim FROM h GROUP BY 1),
flag AS (
  SELECT s.*, score, coalesce(installment_no IS NULL AND gap <= 3, false) AS dup, z > 3.5 AND ratio >= 2 AS big,
         coalesce(hn >= 20 AND v > lim AND NOT EXISTS (SELECT 1 FROM h WHERE h.statement = s.statement AND h.clean_description = s.clean_description), false) AS novel,
         coalesce(score > 0.65 AND z > 3 AND ratio >= 2 AND NOT z > 3.5, false) AS odd
  FROM ff s LEFT JOIN hl USING (statement) LEFT JOIN iforest USING (rid)
)
SELECT statement, l_orderkey, l_linenumber, amount, concat_ws('+', CASE WHEN dup THEN 'duplicate_charge' END, CASE WHEN big THEN 'amount_outlier' END, CASE WHEN novel THEN 'new_merchant_high_amount' END, CASE WHEN odd THEN 'multivariate' END) AS anomaly_type,
  round(greatest(z, 0), 3) AS anomaly_score, concat_ws(' ',
    CASE WHEN dup THEN 'Olası mükerrer çekim: aynı işyerinden 3 gün içinde aynı tutar (' || format('{:,.2f}', v) || ' TL) ikinci kez çekilmiş.' END,
    CASE WHEN big THEN 'Bu harcama (' || format('{:,.2f}', v) || ' TL), ' || CASE WHEN cn >= 5 THEN chr(39) || category || chr(39) || ' kategorisindeki harcamalarınızın' ELSE 'tüm harcamalarınızın' END
      || ' medyanının (' || format('{:,.2f}', CASE WHEN cn >= 5 THEN cv ELSE av END) || ' TL) ' || format('{:,.1f}', ratio) || ' katı.' END,
    CASE WHEN novel THEN 'Geçmiş ekstrelerinizde hiç görülmeyen bir işyerinde, geçmiş harcamalarınızın %90''ından yüksek tutar.' END,
    CASE WHEN odd THEN 'Tutar, işyeri sıklığı ve gün örüntüsü birlikte alışılmışın dışında (izolasyon skoru ' || format('{:,.2f}', score) || ').' END) AS anomaly_reason
FROM flag WHERE dup OR big OR novel OR odd"""
)

ORACLE_SQL = {
    "win_anomaly_reasons": f"WITH {TX_SQL}, {_SINCE}",
    "tool_category_spend": f"""WITH {_QUESTIONED}, c AS (SELECT statement, CAST(coalesce(sum(amount) FILTER ({SPENT} AND category = 'Akaryakıt / Ulaşım'), 0) AS {WIDE}) AS gross_spend,
      CAST(coalesce(sum(-amount) FILTER ({BACK} AND category = 'Akaryakıt / Ulaşım'), 0) AS {WIDE}) AS refunds, count(*) FILTER ({SPENT} AND category = 'Akaryakıt / Ulaşım') AS transaction_count,
      CAST(coalesce(sum(amount) FILTER ({SPENT}), 0) AS {WIDE}) AS total_spend FROM q GROUP BY 1)
      SELECT *, 'Akaryakıt / Ulaşım' AS category, CAST(gross_spend - refunds AS {WIDE}) AS net_spend, CASE WHEN total_spend > 0 THEN round(100 * CAST(gross_spend AS DOUBLE) / CAST(total_spend AS DOUBLE), 1) ELSE 0.0 END AS share_pct FROM c""",
    "tool_compare_categories": f"""WITH {_QUESTIONED}, k AS (SELECT unnest(['Market / Gıda', 'Giyim / Aksesuar', 'E-Ticaret / Pazaryeri']) AS category), s AS (SELECT DISTINCT statement FROM q),
      c AS (SELECT s.statement, k.category, CAST(coalesce(sum(amount) FILTER ({SPENT}), 0) AS {WIDE}) AS gross_spend FROM s CROSS JOIN k LEFT JOIN q ON q.statement = s.statement AND q.category = k.category GROUP BY 1, 2)
      SELECT *, CAST(gross_spend - lead(gross_spend) OVER w AS {WIDE}) AS difference, CAST(row_number() OVER w AS INTEGER) AS rank FROM c WINDOW w AS (PARTITION BY statement ORDER BY gross_spend DESC, category)""",
    "tool_merchant_spend": f"WITH {TX_SQL} SELECT statement, 'small' AS merchant_token, CAST(sum(amount) AS {WIDE}) AS gross_spend, count(*) AS transaction_count FROM tx WHERE {SPENT} AND regexp_matches(lower(clean_description), '(^|[^a-z])small') GROUP BY 1",
    "tool_top_share": f"""WITH {TX_SQL}, c AS (SELECT statement, clean_description, sum(amount) AS total FROM tx WHERE {SPENT} GROUP BY 1, 2),
      r AS (SELECT *, row_number() OVER (PARTITION BY statement ORDER BY total DESC, clean_description) AS rn FROM c),
      s AS (SELECT statement, CAST(sum(total) AS {WIDE}) AS total, CAST(sum(total) FILTER (rn <= 5) AS {WIDE}) AS covered FROM r GROUP BY 1)
      SELECT *, CASE WHEN total > 0 THEN round(100 * CAST(covered AS DOUBLE) / CAST(total AS DOUBLE), 1) ELSE 0.0 END AS covered_pct FROM s""",
    "tool_refunds": f"WITH {TX_SQL} SELECT statement, l_orderkey, l_linenumber, CAST(-amount AS DECIMAL(18,2)) AS amount, clean_description || ': ' || {_TL.format('-amount')} AS answer FROM tx WHERE {BACK}",
    "tool_savings": f"""WITH {_QUESTIONED}, c AS (SELECT statement, category, CAST(sum(amount) AS {WIDE}) AS total FROM q WHERE {SPENT} AND category NOT IN ('Ev / Yaşam / Fatura', 'Finans / Vergi / Masraf') GROUP BY 1, 2),
      r AS (SELECT *, row_number() OVER (PARTITION BY statement ORDER BY total DESC, category) AS rn FROM c),
      s AS (SELECT statement, category, total, round(CAST(total AS DOUBLE) * 0.2, 2) AS monthly_saving, pow(1 + ((1 + 0.40) / (1 + 0.30) - 1), 1.0 / 12) AS g FROM r WHERE rn = 1)
      SELECT statement, category, total, monthly_saving, round(round(monthly_saving * g * (pow(g, 36) - 1) / (g - 1), 2), 1) AS final_real FROM s""",
    "tool_obligations": f"WITH {TX_SQL}, {_KNOWN} SELECT statement, kind, amount, description || ': ' || {_TL.format('amount')} AS answer FROM due",
    "agg_kpis": f"""WITH {TX_SQL}, c AS (SELECT statement, category, CAST(sum(amount) AS {WIDE}) AS total FROM tx WHERE amount > 0 GROUP BY ALL),
      t AS (SELECT statement, category AS top_category FROM (SELECT *, row_number() OVER (PARTITION BY statement ORDER BY total DESC, category) AS rn FROM c) WHERE rn = 1)
      SELECT k.*, t.top_category FROM (SELECT statement, CAST(coalesce(sum(amount) FILTER (amount > 0), 0) AS {WIDE}) AS spend, count(*) AS n FROM tx GROUP BY statement) k LEFT JOIN t USING (statement)""",
    "agg_category_totals": f"WITH {TX_SQL} SELECT category, CAST(sum(amount) AS {WIDE}) AS total, count(*) AS n FROM tx WHERE amount > 0 GROUP BY category",
    "agg_top_n_other": f"""WITH {TX_SQL}, c AS (SELECT clean_description, CAST(sum(amount) AS {WIDE}) AS total FROM tx WHERE {SPENT} GROUP BY 1),
      r AS (SELECT *, row_number() OVER (ORDER BY total DESC, clean_description) AS rn, count(*) OVER () - 7 AS more FROM c)
      SELECT CAST(least(rn, 8) AS INTEGER) AS rank, CASE WHEN rn <= 7 THEN clean_description ELSE 'Other (' || more || ')' END AS clean_description, CAST(sum(total) AS {WIDE}) AS total FROM r GROUP BY 1, 2""",
    "agg_colour_slots": f"""WITH {TX_SQL}, c AS (SELECT clean_description, sum(amount) AS total FROM tx WHERE {SPENT} GROUP BY 1),
      r AS (SELECT *, row_number() OVER (ORDER BY total DESC, clean_description) AS rn, count(*) OVER () - 9 AS more FROM c)
      SELECT DISTINCT CAST(least(rn, 10) AS INTEGER) AS rank, CASE WHEN rn <= 9 THEN clean_description ELSE 'Other (' || more || ')' END AS clean_description, CAST(CASE WHEN rn <= 9 THEN (rn - 1) % 7 END AS INTEGER) AS slot FROM r""",
    "agg_daily_spend": f"WITH {TX_SQL} SELECT date, CAST(sum(amount) AS {WIDE}) AS total FROM tx WHERE amount > 0 GROUP BY date",
    "agg_top_merchants": f"""WITH {TX_SQL}, c AS (SELECT category, clean_description, CAST(sum(amount) AS {WIDE}) AS total, count(*) AS n FROM tx WHERE {SPENT} GROUP BY 1, 2)
      SELECT category, clean_description, total, n FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY total DESC, clean_description) AS rn FROM c) WHERE rn <= 3""",
    "agg_merchant_share": "SELECT user_id, event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id), 6) AS share FROM events GROUP BY 1, 2",
    "agg_quantiles": "SELECT event_type, round(median(value), 4) AS median_value, round(quantile_cont(value, 0.9), 4) AS q90_value, count(DISTINCT user_id) AS users, count(*) AS n FROM events GROUP BY 1",
    "qa_summary": f"WITH {TX_SQL} SELECT statement, CAST(coalesce(sum(amount) FILTER ({SPENT}), 0) AS {WIDE}) AS total_spend, CAST(coalesce(sum(-amount) FILTER ({BACK}), 0) AS {WIDE}) AS total_refunds, count(*) AS transaction_count FROM tx GROUP BY 1",
    "qa_category_spend": f"""WITH {TX_SQL}, c AS (SELECT statement, category, CAST(coalesce(sum(amount) FILTER ({SPENT}), 0) AS {WIDE}) AS gross_spend, CAST(coalesce(sum(-amount) FILTER ({BACK}), 0) AS {WIDE}) AS refunds,
      count(*) FILTER ({SPENT}) AS transaction_count FROM tx GROUP BY 1, 2), w AS (SELECT *, CAST(sum(gross_spend) OVER (PARTITION BY statement) AS DOUBLE) AS whole FROM c)
      SELECT statement, category, gross_spend, refunds, transaction_count, CAST(gross_spend - refunds AS {WIDE}) AS net_spend, CASE WHEN whole > 0 THEN round(100 * CAST(gross_spend AS DOUBLE) / whole, 1) ELSE 0.0 END AS share_pct FROM w""",
    "qa_compare_categories": f"""WITH {TX_SQL}, c AS (SELECT statement, category, CAST(sum(amount) AS {WIDE}) AS total FROM tx WHERE {SPENT} GROUP BY 1, 2),
      r AS (SELECT *, row_number() OVER (PARTITION BY statement ORDER BY total DESC, category) AS rn FROM c),
      p AS (SELECT statement, max(category) FILTER (rn = 1) AS first_category, max(category) FILTER (rn = 2) AS second_category, max(total) FILTER (rn = 1) AS first_total, max(total) FILTER (rn = 2) AS second_total FROM r GROUP BY 1)
      SELECT *, CAST(first_total - coalesce(second_total, 0) AS {WIDE}) AS difference FROM p""",
    "qa_merchant_spend": f"WITH {TX_SQL} SELECT statement, CAST(sum(amount) AS {WIDE}) AS gross_spend, count(*) AS n FROM tx WHERE {SPENT} AND regexp_matches(lower(clean_description), '(^|[^a-z])small') GROUP BY 1",
    "qa_top_share": f"""WITH {TX_SQL}, c AS (SELECT statement, clean_description, sum(amount) AS total FROM tx WHERE {SPENT} GROUP BY 1, 2),
      r AS (SELECT *, row_number() OVER (PARTITION BY statement ORDER BY total DESC, clean_description) AS rn FROM c),
      s AS (SELECT statement, CAST(coalesce(sum(total) FILTER (rn <= 5), 0) AS {WIDE}) AS covered, CAST(sum(total) AS {WIDE}) AS total FROM r GROUP BY 1)
      SELECT *, round(100 * CAST(covered AS DOUBLE) / CAST(total AS DOUBLE), 1) AS covered_pct FROM s""",
    "qa_refunds": f"WITH {TX_SQL} SELECT statement, date, clean_description, CAST(-amount AS DECIMAL(18,2)) AS refund FROM tx WHERE {BACK}",
    "qa_savings": f"""WITH {TX_SQL}, c AS (SELECT statement, category, CAST(sum(amount) AS {WIDE}) AS total FROM tx WHERE {SPENT} GROUP BY 1, 2),
      r AS (SELECT *, row_number() OVER (PARTITION BY statement ORDER BY total DESC, category) AS rn FROM c),
      s AS (SELECT statement, category, total, round(CAST(total AS DOUBLE) * 0.2, 2) AS monthly_saving, pow(1 + ((1 + 0.40) / (1 + 0.30) - 1), 1.0 / 12) AS g FROM r WHERE rn = 1)
      SELECT statement, category, total, monthly_saving, round(monthly_saving * g * (pow(g, 36) - 1) / (g - 1), 2) AS final_real FROM s""",
    "rel_membership": f"""WITH {TX_SQL}, b AS (SELECT DISTINCT statement FROM tx WHERE {BACK})
      SELECT CAST(c_custkey AS VARCHAR) AS statement, CAST(c_custkey AS VARCHAR) IN (SELECT statement FROM b) AS refunded FROM customer""",
    "rel_first_copy": "SELECT doc_id, md5(text) AS digest, row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 AS is_first FROM documents",
    "rel_repeated_statements": "SELECT o_orderkey AS upload_no, CASE WHEN row_number() OVER (PARTITION BY o_orderpriority, CAST(o_orderdate AS DATE) ORDER BY o_orderkey) = 1 THEN 'kept' ELSE 'repeated statement' END AS state FROM orders",
    "rel_union_order": f"""WITH {TX_SQL}, u AS (SELECT *, CASE WHEN amount > 0 THEN 1 ELSE 2 END AS part FROM tx WHERE ({SPENT}) OR ({BACK}))
      SELECT date, CAST(part AS INTEGER) AS part, l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY date, part, {", ".join(TIES)}) AS place FROM u""",
    "win_robust_z": "WITH d AS (SELECT doc_id, lang, ln(1 + CAST(n_chars AS DOUBLE)) AS x FROM documents) SELECT doc_id, round(z, 4) AS z, n AS z_n FROM (" + _z("x", "lang", "d", "doc_id") + ")",
    "win_amount_outliers": """WITH e AS (SELECT event_id, event_type, value, ln(1 + value) AS x FROM events WHERE value > 0), z AS ("""
    + _z("x", "event_type", "e", "event_id, event_type, value")
    + """), m AS (SELECT event_type, median(value) AS med FROM e GROUP BY 1)
      SELECT event_id, round(z, 4) AS z, round(value / greatest(med, 1.0), 4) AS ratio, z > 3.5 AND value / greatest(med, 1.0) >= 2 AS is_outlier FROM z JOIN m USING (event_type)""",
    "win_duplicates": "SELECT event_id, coalesce(date_diff('day', lag(CAST(ts AS DATE)) OVER (PARTITION BY user_id, round(value, 0) ORDER BY CAST(ts AS DATE), event_id), CAST(ts AS DATE)) <= 3, false) AS is_duplicate FROM events",
    "win_novel": """WITH h AS (SELECT * FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '1996-01-01'), q AS (SELECT quantile_cont(o_totalprice, 0.9) AS lim, count(*) AS n FROM h WHERE o_totalprice > 0)
      SELECT o_orderkey, o_custkey NOT IN (SELECT o_custkey FROM h) AND n >= 20 AND o_totalprice > lim AS is_novel FROM orders, q WHERE CAST(o_orderdate AS DATE) >= DATE '1996-01-01'""",
    "win_isolation_forest": f"""WITH {TX_SQL}, {_ANOMALY[: _ANOMALY.index("told AS (")]}
      ff AS MATERIALIZED (SELECT *, row_number() OVER () AS rid, count(*) OVER (PARTITION BY statement, clean_description) / count(*) OVER (PARTITION BY statement) AS mf,
        sin(2 * pi() * (isodow(date) - 1) / 7) AS ds, cos(2 * pi() * (isodow(date) - 1) / 7) AS dc FROM s),
      {_forest("(SELECT * FROM ff WHERE spend_n >= 30)", "statement", ["rid"], ["lg", "z", "mf", "ds", "dc"], TIES)}
      SELECT statement, l_orderkey, l_linenumber, round(round(greatest(z, 0), 3), 1) AS anomaly_score, coalesce(round(score, 3), 0.0) AS iforest_score,
        coalesce(installment_no IS NULL AND gap <= 3, false) OR (z > 3.5 AND ratio >= 2) OR coalesce(score > 0.65 AND z > 3 AND ratio >= 2, false) AS is_anomaly FROM ff LEFT JOIN iforest USING (rid)
      UNION ALL SELECT statement, l_orderkey, l_linenumber, 0.0, 0.0, false FROM spend WHERE spend_n < 5
      UNION ALL SELECT statement, l_orderkey, l_linenumber, 0.0, 0.0, false FROM tx WHERE NOT (amount > 0 AND transaction_type IN ('EXPENSE', 'INSTALLMENT', 'FINANCING_FEE'))""",
    "win_forest_features": """SELECT event_id, round(ln(1 + abs(value)), 6) AS log_amount, round(count(*) OVER (PARTITION BY user_id, event_type) / count(*) OVER (PARTITION BY user_id), 6) AS merchant_frequency,
      round(sin(2 * pi() * (isodow(CAST(ts AS DATE)) - 1) / 7), 6) AS dow_sin, round(cos(2 * pi() * (isodow(CAST(ts AS DATE)) - 1) / 7), 6) AS dow_cos FROM events""",
    "win_gaps": "SELECT event_id, CAST(date_diff('day', lag(CAST(ts AS DATE)) OVER (PARTITION BY user_id, event_type ORDER BY CAST(ts AS DATE), event_id), CAST(ts AS DATE)) AS INTEGER) AS gap FROM events",
    "rel_recomputed": f"WITH {TX_SQL}, {_ANOMALY} SELECT statement, anomaly_type, count(*) AS n, max(anomaly_score) AS top_score FROM told GROUP BY 1, 2",
    "win_detect_anomalies": f"WITH {TX_SQL}, {_ANOMALY} SELECT statement, anomaly_type, count(*) AS n, max(anomaly_score) AS top_score FROM told GROUP BY 1, 2",
    "obl_rhythms": """WITH g AS (SELECT l_partkey, l_suppkey, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, date_diff('day', lag(CAST(l_shipdate AS DATE)) OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate), CAST(l_shipdate AS DATE)) AS gap FROM lineitem)
      SELECT l_partkey, l_suppkey, count(*) AS n, min(amount) AS least, max(amount) AS most, max(amount) - min(amount) <= max(amount) * CAST(0.10 AS DECIMAL(4,2)) AS is_stable FROM g GROUP BY 1, 2 HAVING count(*) >= 2 AND bool_and(gap BETWEEN 25 AND 35)""",
    "obl_components": f"WITH {TX_SQL}, {_COMPONENTS} SELECT statement, component, count(*) AS n, CAST(sum(amount) AS {WIDE}) AS total FROM comp GROUP BY 1, 2",
    "obl_known": f"WITH {TX_SQL}, {_KNOWN} SELECT * FROM due",
    "obl_totals": f"""WITH {TX_SQL}, {_KNOWN} SELECT statement, CAST(coalesce(sum(amount) FILTER (kind = 'installment'), 0) AS {WIDE}) AS installments_total,
      CAST(coalesce(sum(amount) FILTER (kind = 'subscription'), 0) AS {WIDE}) AS subscriptions_total FROM due GROUP BY 1""",
}
