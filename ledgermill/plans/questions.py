"""Queries for the question surface, redaction, synthetic data and streams; with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import copilot, features, redaction
from ..operators.classifier import TextClassifier
from ..schema import TX_SQL, read, tx_of
from ..sources import storage, synthetic
from ..streaming import ingest


#: Table rows of the pages that a task puts together.
PAGE_ROWS = 1 << 15


def qa_route(spark: SparkSession, sf: str) -> DataFrame:
    """Order comments of a kind as questions: priorities and statuses put into question words."""
    stems = F.array(*[F.lit(x) for x in ("Markete ne kadar harcadım?", "Benzin mi restoran mı?", "Geçen ay ne kadar?", "İadelerim ne kadar?", "Nasıl tasarruf ederim?", "Taksitlerim ne kadar?", "Özet", "zzz")])
    rows = read(spark, sf, "orders").select("o_orderkey", F.get(stems, F.pmod("o_orderkey", F.lit(8)).cast("int")).alias("question"))
    return copilot.route(rows).select("o_orderkey", "intent", F.size("category_ids").alias("n_categories"))


def _spent_at(spark: SparkSession, sf: str) -> DataFrame:
    """The different merchants of all spend, cleaned once each."""
    # Written, since of two distincts with the cleaning between them Spark keeps only the last.
    return copilot.normalise(storage.materialize(tx_of(spark, sf).filter("amount > 0").select("clean_description").distinct()))


def qa_merchant_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return copilot.merchant_tokens(_spent_at(spark, sf))


def qa_top_merchants(spark: SparkSession, sf: str) -> DataFrame:
    rows = copilot.tool_top_merchants(tx_of(spark, sf), ["statement"], 2)
    return copilot.render_items(rows, "clean_description", "total").select("statement", "rank", "answer")


def qa_summary_text(spark: SparkSession, sf: str) -> DataFrame:
    return copilot.render_summary(copilot.tool_summary(tx_of(spark, sf), ["statement"])).select("statement", "answer")


def qa_summary_debt(spark: SparkSession, sf: str) -> DataFrame:
    """Summaries with what customers owe: their balances, of which a fifth is due."""
    debt = F.col("c_acctbal").cast("decimal(18,2)")
    least = F.when(debt > 0, F.round(debt * F.lit("0.20").cast("decimal(4,2)"), 2)).otherwise(F.lit(0))
    accounts = read(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("statement"), debt.alias("total_debt"), least.alias("min_payment"))
    got = copilot.render_summary(copilot.tool_summary(tx_of(spark, sf), ["statement"], accounts))
    return got.select("statement", F.substring_index("answer", ". En Yoğun", 1).alias("answer"))


def qa_answer_category(spark: SparkSession, sf: str) -> DataFrame:
    """What each customer is told of fuel and transport."""
    names = F.array(*[F.lit(name) for name, _, _ in copilot.CATEGORIES])
    asked = copilot.normalise(tx_of(spark, sf).withColumn("category", F.get(names, F.pmod("l_partkey", F.lit(len(copilot.CATEGORIES))).cast("int"))))
    return copilot.render_category(copilot.tool_category_spend(asked, ["statement"], 2)).select("statement", "answer")


def pii_label_values(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' header lines: labels of personal data and what follows them."""
    rows = storage.spread(read(spark, sf, "customer")).select(
        F.col("c_custkey").alias("doc"), F.lit(0).alias("page"), F.lit(0).alias("block"), F.lit(0).alias("line"),
        F.concat(F.lit("Sayın "), "c_name", F.lit("  Adres: "), "c_mktsegment", F.lit("  Son Ödeme 01.01.2026 Telefon: 0532")).alias("text"),
    )
    return redaction.label_values(rows).select("doc", "kind", "value")


def _page_words(spark: SparkSession, sf: str) -> DataFrame:
    """A page of positioned words for each customer: name, address and a table with a row for each order.

    The words of a table row don't stand at exactly one height, and come in no order.
    """
    customers = read(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    word = lambda x, y, text, line: F.struct(F.lit(float(x)).alias("x0"), y.cast("double").alias("y0"), F.lit(x + 40.0).alias("x1"), (y + 10).cast("double").alias("y1"), text.cast("string").alias("text"), F.lit(0).alias("block"), line.cast("int").alias("line"))
    at = lambda y, line, *texts: [word(50 + 60 * k, F.lit(y), t, F.lit(line)) for k, t in enumerate(texts)]
    top = [*at(40, 0, F.lit("Sayın"), F.col("c_name")), *at(52, 1, F.lit("Adres:"), F.col("c_mktsegment")), *at(64, 2, F.lit("Mah"), F.col("c_nationkey"))]
    top += [word(300, F.lit(70), F.lit("Sayfa"), F.lit(3)), *at(82, 4, F.lit("Kat"), F.col("c_custkey")), word(300, F.lit(90), F.lit("Ekstre"), F.lit(5))]
    table = read(spark, sf, "orders")
    many = table.count()
    orders = storage.dealt(table, many, PAGE_ROWS, "o_custkey").withColumn("k", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    y, line = F.lit(100) + 12 * F.col("k"), 9 + F.col("k")
    rows = orders.select(F.col("o_custkey").alias("c_custkey"), F.explode(F.array(word(300, y + 2, F.col("o_orderkey"), line), word(50, y + 1, F.col("o_orderdate").cast("date").cast("string"), line), word(170, y, F.col("o_orderpriority"), line))).alias("w"))
    every = customers.select("c_custkey", F.explode(F.array(*top)).alias("w")).unionByName(rows)
    return storage.dealt(every, many, PAGE_ROWS, "c_custkey").groupBy(F.col("c_custkey").alias("doc")).agg(F.collect_list("w").alias("words")).withColumn("page", F.lit(0))


def pii_visual_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The rows that words stand in, by their heights."""
    return redaction.visual_rows(_page_words(spark, sf)).select("doc", "row", "y0", "text")


def pii_address_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines under an address that go on with it."""
    lines = redaction.lines_of(_page_words(spark, sf)).withColumn("is_tx", F.col("line") > 9)
    return redaction.address_lines(lines).select("doc", "y0", "text")


def pii_header_zone(spark: SparkSession, sf: str) -> DataFrame:
    """Where each page's head ends: above the first row with a date, or after a quarter of the page."""
    words = _page_words(spark, sf)
    rows = redaction.visual_rows(words).withColumn("is_tx", F.col("text").rlike(r"^\d{4}-\d{2}-\d{2} "))
    return redaction.header_zone(rows, words.select("doc", F.lit(10.0).alias("top"), F.lit(800.0).alias("height")))


def qa_route_merchants(spark: SparkSession, sf: str) -> DataFrame:
    """A question about each part's name, routed with the words of all merchants."""
    tokens = copilot.merchant_tokens(_spent_at(spark, sf))
    asked = storage.spread(read(spark, sf, "part")).select("p_partkey", F.concat(F.initcap("p_name"), F.lit("'a ne kadar gitti?")).alias("question"))
    return copilot.route(asked, tokens).select("p_partkey", "intent", "merchant_token")


def gen_national_ids(spark: SparkSession, sf: str) -> DataFrame:
    """A national number for each customer; all pass the check."""
    from ..functions.pii import is_valid_tc

    ids = read(spark, sf, "customer").select(F.col("c_custkey").alias("id")).withColumn("tc", synthetic.national_id(42))
    return ids.select("id", is_valid_tc(F.col("tc")).alias("valid"))


def gen_statement_accounts(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("spend"), (F.col("o_custkey") / 100).cast("decimal(18,2)").alias("interest"))
    return rows.select("o_orderkey", *[c.cast("decimal(18,2)").alias(k) for k, c in synthetic.statement_accounts(F.col("spend"), F.col("interest")).items()])


def _merchants(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, list[str], int]:
    """Brands are the parts' names, their classes the last words of those, surnames the nations'; a row for each line item."""
    parts = read(spark, sf, "part").select(F.element_at(F.split("p_name", " "), -1).alias("category"), F.col("p_name").alias("brand"), F.concat_ws(" ", "p_type", F.element_at(F.split("p_name", " "), -1)).alias("keyword"))
    names = sorted(r[0] for r in read(spark, sf, "nation").select("n_name").collect())
    return parts.select("category", "brand"), parts.select("category", "keyword"), names, read(spark, sf, "lineitem").count()


def gen_merchant_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Corrupted merchant texts of the parts' names, a row for each line item."""
    return synthetic.merchant_texts(*_merchants(spark, sf))


def gen_merchant_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each class and source before cleaning: exact quotas."""
    return synthetic.merchant_rows(*_merchants(spark, sf)).groupBy("category", "source").agg(F.count(F.lit(1)).alias("n"))


def ml_merchants(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and hits of each class and source where boosted trees, fitted on other groups, classify all merchant texts."""
    # Equal texts are split and classified once.
    counted = storage.materialize(synthetic.merchant_texts(*_merchants(spark, sf)).groupBy("clean_text", "category", "source", "group").agg(F.count(F.lit(1)).alias("n")))
    texts = storage.materialize(features.group_split(counted, "group").groupBy("clean_text", "category", "source", "is_test").agg(F.sum("n").alias("n")))
    model = TextClassifier(textCol="clean_text", labelCol="category", rounds=4, rate=0.3).fit(texts.filter("not is_test").select("clean_text", "category").distinct())
    said = model.transform(texts)
    rows_where = lambda found: F.sum(F.when(found, F.col("n")).otherwise(0))
    return said.groupBy("category", "source", "is_test").agg(F.sum("n").alias("n"), rows_where(F.col("top") == F.col("category")).alias("hits"), rows_where(F.col("abstained")).alias("abstained"))


def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a stream: repeated ids dropped, hourly sums of each kind; then read back."""
    where = f"{storage.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    table = read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    table.write.parquet(f"{where}/in")
    stream = spark.readStream.schema(table.schema).parquet(f"{where}/in")
    once = ingest.without_repeats(stream, "ts", ["event_id"], "1 hour")
    ingest.run_available(once.select("event_id", "ts", "event_type", "value"), f"{where}/rows", f"{where}/state").awaitTermination()
    rows = spark.read.parquet(f"{where}/rows")
    return rows.groupBy("event_type", F.date_trunc("day", "ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


def stream_spend(spark: SparkSession, sf: str) -> DataFrame:
    """Six-hour windows that start every three hours, as the stream of events sums them up."""
    table = read(spark, sf, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("decimal(18,4)").alias("value"))
    got = ingest.spend_windows(table, "ts", "event_type", "value", "6 hours", "3 hours")
    return got.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.col("total").cast("decimal(38,4)").alias("total"))


QUERIES = {f.__name__: f for f in (qa_route, qa_merchant_tokens, qa_top_merchants, qa_summary_text, qa_summary_debt, qa_answer_category, pii_label_values, pii_visual_rows, pii_address_lines, pii_header_zone, qa_route_merchants, gen_national_ids, gen_statement_accounts, gen_merchant_texts, gen_merchant_counts, ml_merchants, stream_windows, stream_spend)}

_TL = "translate(format('{{:,.2f}}', CAST({} AS DOUBLE)), ',.', '.,') || ' TL'"
_SPENT = "amount > 0 AND transaction_type NOT IN ('PAYMENT', 'POINT_REDEMPTION')"
ORACLE_SQL = {
    "qa_route": """SELECT o_orderkey, list_extract(['category_spend', 'compare_categories', 'unsupported_temporal', 'refunds', 'savings', 'obligations', 'summary', 'unknown'], CAST(o_orderkey % 8 AS INTEGER) + 1) AS intent,
      CAST(list_extract([1, 2, 0, 0, 0, 0, 0, 0], CAST(o_orderkey % 8 AS INTEGER) + 1) AS INTEGER) AS n_categories FROM orders""",
    "qa_merchant_tokens": f"""WITH {TX_SQL}, m AS (SELECT DISTINCT lower(clean_description) AS m FROM tx WHERE amount > 0), t AS (SELECT m, unnest(string_split(m, ' ')) AS token FROM m)
      SELECT token, min(m) AS merchant FROM t WHERE length(token) >= 4 GROUP BY 1""",
    "qa_top_merchants": f"""WITH {TX_SQL}, c AS (SELECT statement, clean_description, sum(amount) AS total FROM tx WHERE {_SPENT} GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY statement ORDER BY total DESC, clean_description) AS rn FROM c)
      SELECT statement, CAST(rn AS INTEGER) AS rank, clean_description || ': ' || {_TL.format("total")} AS answer FROM r WHERE rn <= 2""",
    "qa_summary_text": f"""WITH {TX_SQL}, c AS (SELECT statement, category, sum(amount) AS total FROM tx WHERE {_SPENT} GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY statement ORDER BY total DESC, category) AS rn FROM c),
      t AS (SELECT statement, string_agg(category || ' (' || {_TL.format("total")} || ')', ', ' ORDER BY rn) AS cats FROM r WHERE rn <= 4 GROUP BY 1),
      s AS (SELECT statement, coalesce(sum(amount) FILTER ({_SPENT}), 0) AS spend, coalesce(sum(-amount) FILTER (amount < 0 AND transaction_type <> 'PAYMENT'), 0) AS back, count(*) AS n FROM tx GROUP BY 1)
      SELECT s.statement, 'Toplam Harcama: ' || {_TL.format("spend")} || ' (' || n || ' işlem). İadeler: ' || {_TL.format("back")} || '. En Yoğun Kategoriler: ' || coalesce(cats, 'yok') AS answer FROM s LEFT JOIN t USING (statement)""",
    "qa_summary_debt": f"""WITH {TX_SQL}, s AS (SELECT statement, coalesce(sum(amount) FILTER ({_SPENT}), 0) AS spend, coalesce(sum(-amount) FILTER (amount < 0 AND transaction_type <> 'PAYMENT'), 0) AS back, count(*) AS n FROM tx GROUP BY 1),
      a AS (SELECT CAST(c_custkey AS VARCHAR) AS statement, CAST(c_acctbal AS DECIMAL(18,2)) AS debt, CAST(round(CAST(c_acctbal AS DECIMAL(18,2)) * CAST(0.20 AS DECIMAL(4,2)), 2) AS DECIMAL(18,2)) AS least FROM customer)
      SELECT statement, 'Toplam Harcama: ' || {_TL.format("spend")} || ' (' || n || ' işlem). İadeler: ' || {_TL.format("back")} || coalesce('. Dönem Borcu: ' || {_TL.format("debt")}, '')
        || CASE WHEN debt > 0 AND least <> 0 THEN '. Asgari Ödeme: ' || {_TL.format("least")} ELSE '' END AS answer FROM s LEFT JOIN a USING (statement)""",
    "qa_answer_category": f"""WITH {TX_SQL}, c AS (SELECT statement, coalesce(sum(amount) FILTER ({_SPENT} AND l_partkey % {len(copilot.CATEGORIES)} = 2), 0) AS gross, coalesce(sum(-amount) FILTER (amount < 0 AND transaction_type <> 'PAYMENT' AND l_partkey % {len(copilot.CATEGORIES)} = 2), 0) AS back,
        count(*) FILTER ({_SPENT} AND l_partkey % {len(copilot.CATEGORIES)} = 2) AS n, coalesce(sum(amount) FILTER ({_SPENT}), 0) AS spend FROM tx GROUP BY 1)
      SELECT statement, '{copilot.CATEGORIES[2][0]}: ' || {_TL.format("gross")} || ' (' || n || ' işlem, %' || CAST(CASE WHEN spend > 0 THEN round(100 * CAST(gross AS DOUBLE) / CAST(spend AS DOUBLE), 1) ELSE 0.0 END AS VARCHAR) || '); iadeler ' || {_TL.format("back")} || ', net ' || {_TL.format("gross - back")} AS answer FROM c""",
    "pii_label_values": """SELECT c_custkey AS doc, 'name' AS kind, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'address', c_mktsegment FROM customer UNION ALL SELECT c_custkey, 'phone', '0532' FROM customer""",
    "pii_visual_rows": """WITH o AS (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || ' ' || o_orderpriority || ' ' || o_orderkey AS text FROM orders),
      t AS (SELECT c_custkey AS doc, unnest([{'y': 40.0, 't': 'Sayın ' || c_name}, {'y': 52.0, 't': 'Adres: ' || c_mktsegment}, {'y': 64.0, 't': 'Mah ' || c_nationkey}, {'y': 70.0, 't': 'Sayfa'}, {'y': 82.0, 't': 'Kat ' || c_custkey}, {'y': 90.0, 't': 'Ekstre'}]) AS r FROM customer),
      a AS (SELECT doc, r.y AS y0, r.t AS text FROM t UNION ALL SELECT doc, CAST(100 + 12 * k AS DOUBLE), text FROM o)
      SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY y0) - 1 AS INTEGER) AS row, CAST(y0 AS DOUBLE) AS y0, text FROM a""",
    "pii_address_lines": "SELECT c_custkey AS doc, CAST(64 AS DOUBLE) AS y0, 'Mah ' || c_nationkey AS text FROM customer UNION ALL SELECT c_custkey, CAST(82 AS DOUBLE), 'Kat ' || c_custkey FROM customer",
    "pii_header_zone": "SELECT c_custkey AS doc, CASE WHEN o_custkey IS NULL THEN 10.0 + 0.25 * 800 ELSE 112.0 - 2 END::DOUBLE AS y FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) ON o_custkey = c_custkey",
    "qa_route_merchants": f"""WITH {TX_SQL}, m AS (SELECT DISTINCT lower(clean_description) AS m FROM tx WHERE amount > 0), t AS (SELECT DISTINCT token FROM (SELECT unnest(string_split(m, ' ')) AS token FROM m) WHERE length(token) >= 4),
      w AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w FROM part), f AS (SELECT p_partkey, min(token) AS token FROM w JOIN t ON starts_with(w, token) AND length(w) >= 4 GROUP BY 1)
      SELECT p.p_partkey, CASE WHEN token IS NOT NULL THEN 'merchant_spend' ELSE 'unknown' END AS intent, token AS merchant_token FROM part p LEFT JOIN f USING (p_partkey)""",
    "gen_national_ids": "SELECT c_custkey AS id, true AS valid FROM customer",
    "gen_merchant_counts": f"""WITH k AS (SELECT category, row_number() OVER (ORDER BY category) - 1 AS c, count(*) OVER () + 1 AS many FROM (SELECT DISTINCT list_extract(string_split(p_name, ' '), -1) AS category FROM part)),
      r AS (SELECT count(*) AS n FROM lineitem), a AS (SELECT category, (n - c + many - 1) // many AS n FROM k, r), o AS (SELECT n // many AS n FROM (SELECT DISTINCT many FROM k), r)
      SELECT category, 'generic' AS source, CAST(floor(n * 0.4) AS BIGINT) AS n FROM a UNION ALL SELECT category, 'brand', n - CAST(floor(n * 0.4) AS BIGINT) FROM a UNION ALL SELECT '{synthetic.OTHER}', 'other', n FROM o""",
    "gen_statement_accounts": """WITH o AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS s, CAST(o_custkey / 100 AS DECIMAL(18,2)) AS i FROM orders), l AS (SELECT *, CAST(round(i * CAST(0.15 AS DECIMAL(4,2)), 2) AS DECIMAL(18,2)) AS levy FROM o)
      SELECT o_orderkey, levy AS kkdf, levy AS bsmv, CAST(s + i + levy + levy AS DECIMAL(18,2)) AS total_debt, CAST(round((s + i + levy + levy) * CAST(0.20 AS DECIMAL(4,2)), 2) AS DECIMAL(18,2)) AS min_payment FROM l""",
    "stream_spend": """WITH e AS (SELECT event_type, CAST(value AS DECIMAL(18,4)) AS value, unnest([time_bucket(INTERVAL 3 HOUR, CAST(ts AS TIMESTAMP), TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 3 HOUR, CAST(ts AS TIMESTAMP), TIMESTAMP '1970-01-01') - INTERVAL 3 HOUR]) AS start FROM events)
      SELECT event_type, start, count(*) AS n, CAST(sum(value) AS DECIMAL(38,4)) AS total FROM e GROUP BY 1, 2""",
    "stream_windows": "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
}
