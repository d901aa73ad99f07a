"""Queries over texts: folding, cleaning, formats, personal data; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pii, text
from ..schema import read


def str_fold(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", F.md5(text.fold(F.col("text"))).alias("folded"), F.md5(text.turkish_lower(F.col("text"))).alias("lowered"))


def str_clean_names(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "part").select("p_partkey", F.concat_ws(" ", F.lit("IYZICO*"), "p_name", F.lit("LTD. ISTANBUL"), F.col("p_size").cast("string"), F.lit("3/6 TAKSIT")).alias("raw"))
    return rows.select("p_partkey", text.clean_merchant(F.col("raw")).alias("cleaned"), text.clean_merchant(F.col("raw"), mask_numbers=False).alias("kept"))


def str_tl(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("o_totalprice").cast("decimal(18,2)")
    return read(spark, sf, "orders").select("o_orderkey", text.tl(price).alias("tl"), text.render_amount(-price, "en", "mark").alias("credit"))


def str_escape(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "pages").select("page_id", F.md5(text.escape_html(F.col("html"))).alias("escaped"))


def str_collapse(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "pages").select("page_id", text.collapse_digits(F.col("url")).alias("key"), text.contains_ignoring_case(F.col("url"), "EXAMPLE").alias("found"))


def diag_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """The commonest shapes of words with digits."""
    words = read(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"\S*[0-9]\S*"), F.lit(0))).alias("w"))
    return words.groupBy(text.shape(F.col("w")).alias("shape")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "shape").limit(14)


def diag_odd_characters(spark: SparkSession, sf: str) -> DataFrame:
    """The commonest characters beyond Latin ones, and beyond ASCII."""
    return text.odd_characters(read(spark, sf, "documents"), "text").unionByName(text.odd_characters(read(spark, sf, "documents"), "text", 0x7F))


def pii_luhn(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "orders").select("o_orderkey", F.lpad((F.col("o_orderkey") * 7919 + 4000000000000000).cast("string"), 16, "4").alias("pan"))
    return rows.select("o_orderkey", pii.is_luhn_valid(F.col("pan")).alias("valid"))


def pii_national_id(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") * 104729 + 10000000000).cast("string").alias("tc"))
    return rows.select("o_orderkey", pii.is_valid_tc(F.col("tc")).alias("valid"))


def pii_emails(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0))).alias("email"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("email").alias("first_email"))


def pii_email_spans(spark: SparkSession, sf: str) -> DataFrame:
    """E-mail addresses of each document, as the masking finds them."""
    rows = read(spark, sf, "documents").select("doc_id", F.explode(pii.spans(pii.clear(F.col("text")), pii.EMAIL, "email")).alias("h"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("h.raw").alias("first_email"), F.sum(F.col("h.e") - F.col("h.s")).alias("covered"))


def pii_mask(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    return docs.select("doc_id", pii.mask_text(F.col("text")).alias("masked"))


def pii_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "documents").select("doc_id", F.explode(pii.pii_spans(pii.clear(F.col("text")))).alias("h"))
    return rows.groupBy("doc_id", F.col("h.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (str_fold, str_clean_names, str_tl, str_escape, str_collapse, diag_shapes, diag_odd_characters, pii_luhn, pii_national_id, pii_emails, pii_email_spans, pii_mask, pii_counts)}

_REPAIR = "replace(translate(nfc_normalize(text), 'ÐÝÞðýþ', 'ĞİŞğış'), chr(775), '')"
_RAW = "lower('iyzico* ' || p_name || ' ltd. istanbul ' || p_size || ' 3/6 taksit')"
_STEP = f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_RAW}, '^iyzico\\s*[*/-]\\s*', ' '), '\\s*\\(?\\d{{1,2}}\\s*[./]?\\s*(/\\s*\\d{{1,2}}\\s*)?tak(sit)?\\b\\.?\\)?', ' ', 'g'), '\\b(ltd|istanbul)\\b\\.?', ' ', 'g'), '[^a-z0-9_\\s<>]', ' ', 'g'), '\\s+', ' ', 'g'))"
_DIGIT = "CAST(substr(x, {}, 1) AS INTEGER)"

ORACLE_SQL = {
    "str_fold": f"""SELECT doc_id, md5(lower(translate({_REPAIR}, 'çÇğĞıIİöÖşŞüÜâÂîÎûÛ', 'ccggiiioossuuaaiiuu'))) AS folded, md5(lower(translate({_REPAIR}, 'İI', 'iı'))) AS lowered FROM documents""",
    "str_clean_names": f"""SELECT p_partkey, trim(regexp_replace(regexp_replace({_STEP}, '\\b\\d+\\b', ' <num> ', 'g'), '\\s+', ' ', 'g')) AS cleaned, {_STEP} AS kept FROM part""",
    "str_tl": """WITH o AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS p FROM orders)
      SELECT o_orderkey, translate(format('{:,.2f}', CAST(p AS DOUBLE)), ',.', '.,') || ' TL' AS tl, CASE WHEN p > 0 THEN format('{:,.2f}', CAST(p AS DOUBLE)) || ' (A)' ELSE format('{:,.2f}', CAST(-p AS DOUBLE)) END AS credit FROM o""",
    "str_escape": """SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped FROM pages""",
    "str_collapse": "SELECT page_id, regexp_replace(url, '[0-9]+', '#', 'g') AS key, contains(lower(url), 'example') AS found FROM pages",
    "diag_shapes": """WITH w AS (SELECT unnest(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]*[0-9][^ \\t\\n\\r\\f\\v]*')) AS w FROM documents)
      SELECT regexp_replace(regexp_replace(w, '\\pL', 'A', 'g'), '\\pN', '9', 'g') AS shape, count(*) AS n FROM w GROUP BY 1 ORDER BY n DESC, shape LIMIT 14""",
    "diag_odd_characters": " UNION ALL ".join(
        f"(WITH w AS (SELECT unnest(regexp_extract_all(text, '[^\\x00-\\x{{{k:X}}}]')) AS c FROM documents) SELECT CAST({k} AS INTEGER) AS beyond, c, count(*) AS n FROM w GROUP BY 2 ORDER BY n DESC, c LIMIT 8)" for k in (0x24F, 0x7F)
    ),
    "pii_email_spans": r"""WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')) AS email FROM documents)
      SELECT doc_id, count(*) AS n, min(email) AS first_email, CAST(sum(length(email)) AS BIGINT) AS covered FROM e GROUP BY 1""".replace("\\\\", "\\"),
    "pii_luhn": """WITH o AS (SELECT o_orderkey, lpad(CAST(o_orderkey * 7919 + 4000000000000000 AS VARCHAR), 16, '4') AS x FROM orders)
      SELECT o_orderkey, list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(x, i, 1) AS INTEGER)
        WHEN CAST(substr(x, i, 1) AS INTEGER) * 2 > 9 THEN CAST(substr(x, i, 1) AS INTEGER) * 2 - 9 ELSE CAST(substr(x, i, 1) AS INTEGER) * 2 END)) % 10 = 0 AS valid FROM o""",
    "pii_national_id": f"""WITH o AS (SELECT o_orderkey, CAST(o_orderkey * 104729 + 10000000000 AS VARCHAR) AS x FROM orders)
      SELECT o_orderkey, length(x) = 11 AND (((({' + '.join(_DIGIT.format(k) for k in (1, 3, 5, 7, 9))}) * 7 - ({' + '.join(_DIGIT.format(k) for k in (2, 4, 6, 8))})) % 10 + 10) % 10 = {_DIGIT.format(10)})
        AND ({' + '.join(_DIGIT.format(k) for k in range(1, 11))}) % 10 = {_DIGIT.format(11)} AS valid FROM o""",
    "pii_emails": r"""WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS email FROM documents)
      SELECT doc_id, count(*) AS n, min(email) AS first_email FROM e GROUP BY 1""",
}
