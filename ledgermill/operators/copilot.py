"""Questions about spending: routing for tables of questions, tools, and rendered answers.

Routing and tools are DataFrame plans over all entities; ``ask`` answers one question for
one entity and is the only place that collects, a handful of rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import finance
from ..functions.text import clean_merchant, fold, tl
from ..schema import copilot_refund, copilot_spend, ensure_columns
from . import aggregates, obligations

# Categories with their stems in category names and in questions; intents with their stems.
CATEGORIES = [
    ("Market / Gıda", ["market", "bakkal"], ["market", "bakkal", "gida", "mutfak"]),
    ("Restoran / Yeme-İçme", ["restoran", "yeme"], ["restoran", "yemek", "yemeg", "yedim", "kahve", "kafe", "disari", "lokanta"]),
    ("Akaryakıt / Ulaşım", ["akaryakit", "ulasim"], ["akaryakit", "benzin", "yakit", "ulasim", "taksi(?!t)", "ucak", "otopark", "mazot"]),
    ("Giyim / Aksesuar", ["giyim", "aksesuar", "moda"], ["giyim", "kiyafet", "ayakkabi", "elbise"]),
    ("Elektronik / Teknoloji", ["elektronik", "teknoloji"], ["elektronik", "teknoloji", "bilgisayar"]),
    ("Dijital Servis / Abonelik", ["abonelik", "dijital"], ["abonelik", "aboneli", "uyelik", "streaming"]),
    ("Sağlık / Kozmetik", ["saglik", "kozmetik"], ["saglik", "eczane", "hastane", "kozmetik", "doktor"]),
    ("Ev / Yaşam / Fatura", ["fatura", "yasam"], ["fatura", "elektrik", "dogalgaz", "mobilya", "kira", "aidat"]),
    ("Eğlence / Hobi / Kitap", ["eglence", "hobi", "kitap"], ["eglence", "sinema", "kitap", "hobi", "konser", "tiyatro"]),
    ("Finans / Vergi / Masraf", ["finans", "vergi", "masraf"], ["faiz", "vergi", "masraf", "komisyon", "kkdf", "bsmv"]),
    ("E-Ticaret / Pazaryeri", ["e-ticaret", "pazaryeri"], ["e-ticaret", "eticaret", "pazaryeri", "online alisveris", "internet alisveris"]),
]
INTENTS = [
    ("unsupported_temporal", ["gecen ay", "onceki ay", "gecen yil", "gecen hafta", "artis", "artti", "azaldi", "azalis", "kiyasla"]),
    ("anomalies", ["anomali", "supheli", "olagandisi", "mukerrer", "cift cekim", "dolandiricilik", "tanimadigim"]),
    ("refunds", ["iade", "iptal"]),
    ("obligations", ["taksit", "gelecek ay", "onumuzdeki ay", "sonraki ay", "odeyecegim", "tahmin", "ongoru", "beklenen"]),
    ("savings", ["tasarruf", "biriktir", "birikim", "oneri", "tavsiye", "kisabilir", "kisarim"]),
    ("top_merchants", ["en cok", "en fazla", "nereye", "hangi magaza", "hangi isyeri", "lider", "nerelere"]),
    ("summary", ["ozet", "toplam", "genel", "borc", "asgari", "ekstre", "durum"]),
]
# Words that name no merchant; the start of a word.
STOP_WORDS = ["market", "magaza", "magazacilik", "ticaret", "kahve", "gida", "istanbul", "ankara", "izmir", "sanayi", "perakende", "hizmetleri", "elektronik", "giyim", "<num>", "<date>", "<cur>"]
START = r"(?U)(?<![^\W\d_])"
# The part of a category that saving cuts, the fund it goes to, stems of categories that can't be cut.
CUT, FUND, BOUND = 0.2, "Para Piyasası / Mevduat Fonu", "finans|vergi|fatura|diger"
UNSURE = "Bu soruyu anlayamadım."
NO_HISTORY = "Bu soruyu yanıtlayamıyorum: yalnızca yüklenen dönem görülüyor."


def _starts(text: Column, stems: list[str]) -> Column:
    return text.rlike(START + "(?:" + "|".join(stems) + ")")


def normalise(tx: DataFrame) -> DataFrame:
    """Defaults for absent columns, folded category and cleaned merchant."""
    rows = ensure_columns(tx)
    return rows.withColumns(
        {
            "amount": F.coalesce("amount", F.lit(0).cast("decimal(18,2)")), "category": F.coalesce("category", F.lit("Diğer / Belirsiz")),
            "category_folded": fold(F.coalesce("category", F.lit("Diğer / Belirsiz")), nfc=False), "merchant_folded": clean_merchant(F.col("clean_description"), nfc=False),
        }
    )


def merchant_tokens(spend: DataFrame) -> DataFrame:
    """token, merchant: words of four letters or more of merchants, each with its first merchant by name."""
    words = spend.select("merchant_folded").distinct().select("merchant_folded", F.explode(F.split("merchant_folded", " ")).alias("token"))
    return words.filter((F.length("token") >= 4) & ~F.col("token").isin(*STOP_WORDS)).groupBy("token").agg(F.min("merchant_folded").alias("merchant"))


def route(questions: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """Adds intent, category_ids and merchant_token to rows with ``question``.

    Order: empty, temporal, two categories, one category, a merchant's word, other intents.
    A question's words and their prefixes are joined with the tokens by equality, so the
    merchant list may be of any size; equal questions are looked up once.
    """
    rows = questions.withColumn("_q", fold(F.coalesce("question", F.lit("")), nfc=False))
    rows = rows.withColumn("category_ids", F.array_compact(F.array(*[F.when(_starts(F.col("_q"), stems), F.lit(k)) for k, (_, _, stems) in enumerate(CATEGORIES)])))
    if tokens is None:
        rows = rows.withColumn("merchant_token", F.lit(None).cast("string"))
    else:
        words = rows.select("_q").distinct().select("_q", F.explode(F.array_distinct(F.split("_q", r"(?U)[^\p{L}]+"))).alias("w")).filter(F.length("w") >= 4)
        starts = words.select("_q", F.explode(F.transform(F.sequence(F.lit(4), F.length("w")), lambda n: F.substr("w", F.lit(1), n))).alias("token"))
        found = starts.join(tokens, "token").groupBy("_q").agg(F.min("token").alias("merchant_token"))
        rows = rows.join(found, "_q", "left")
    intent = F.when(F.trim("_q") == "", "unknown").when(_starts(F.col("_q"), INTENTS[0][1]), INTENTS[0][0]).when(F.size("category_ids") >= 2, "compare_categories").when(F.size("category_ids") == 1, "category_spend")
    intent = intent.when(F.col("merchant_token").isNotNull(), "merchant_spend")
    for name, stems in INTENTS[1:]:
        intent = intent.when(_starts(F.col("_q"), stems), name)
    return rows.withColumn("intent", intent.otherwise("unknown")).drop("_q")


def in_category(category_id: int) -> Column:
    return F.col("category_folded").rlike("|".join(re.escape(s) for s in CATEGORIES[category_id][1]))


def tool_summary(tx: DataFrame, by: list[str], accounts: DataFrame | None = None) -> DataFrame:
    """Spend, refunds, rows and the four largest categories of each entity.

    ``accounts`` (``by``, total_debt, min_payment; a row for each entity) adds what is owed; null where it isn't known.
    """
    top = aggregates.top_k(aggregates.spend_by(tx.filter(copilot_spend()), by, "category"), by, "category", 4)
    named = top.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "category", "total"))), lambda x: F.struct(x["category"].alias("category"), x["total"].alias("amount"))).alias("top_categories"))
    told = aggregates.summary(tx, by).join(named, by, "left") if by else aggregates.summary(tx, by).join(F.broadcast(named), F.lit(True), "left")
    if accounts is None:
        return told.withColumns({c: F.lit(None).cast("decimal(18,2)") for c in ("total_debt", "min_payment")})
    owed = accounts.select(*by, *[F.col(c).cast("decimal(18,2)").alias(c) for c in ("total_debt", "min_payment")])
    return told.join(owed, by, "left") if by else told.join(F.broadcast(owed), F.lit(True), "left")


def tool_category_spend(tx: DataFrame, by: list[str], category_id: int) -> DataFrame:
    mine = in_category(category_id)
    sums = tx.groupBy(*by).agg(
        aggregates.total(F.when(copilot_spend() & mine, F.col("amount"))).alias("gross_spend"), aggregates.total(F.when(copilot_refund() & mine, -F.col("amount"))).alias("refunds"),
        F.count_if(copilot_spend() & mine).alias("transaction_count"), aggregates.total(F.when(copilot_spend(), F.col("amount"))).alias("total_spend"),
    )
    share = F.when(F.col("total_spend") > 0, F.round(100 * F.col("gross_spend").cast("double") / F.col("total_spend").cast("double"), 1)).otherwise(F.lit(0.0))
    return sums.withColumns({"category": F.lit(CATEGORIES[category_id][0]), "net_spend": (F.col("gross_spend") - F.col("refunds")).cast("decimal(38,2)"), "share_pct": share})


def tool_compare_categories(tx: DataFrame, by: list[str], category_ids: list[int]) -> DataFrame:
    """The named categories by falling spend, with the difference to the next."""
    from functools import reduce

    rows = reduce(DataFrame.unionByName, [tool_category_spend(tx, by, c) for c in category_ids])
    order = Window.partitionBy(*by).orderBy(F.desc("gross_spend"), "category")
    return rows.withColumn("difference", F.col("gross_spend") - F.lead("gross_spend").over(order)).withColumn("rank", F.row_number().over(order))


def tool_merchant_spend(tx: DataFrame, by: list[str], token: str) -> DataFrame:
    rows = tx.filter(copilot_spend() & F.col("merchant_folded").rlike(START + re.escape(token)))
    return rows.groupBy(*by).agg(F.lit(token).alias("merchant_token"), aggregates.total(F.col("amount")).alias("gross_spend"), F.count(F.lit(1)).alias("transaction_count"))


def tool_top_merchants(tx: DataFrame, by: list[str], n: int = 5) -> DataFrame:
    return aggregates.top_k(aggregates.spend_by(tx.filter(copilot_spend()), by, "clean_description"), by, "clean_description", n)


def tool_top_share(tx: DataFrame, by: list[str], n: int = 5) -> DataFrame:
    """What each entity's n top merchants cover of its spend."""
    covered = tool_top_merchants(tx, by, n).groupBy(*by).agg(aggregates.total(F.col("total")).alias("covered"))
    every = tx.filter(copilot_spend()).groupBy(*by).agg(aggregates.total(F.col("amount")).alias("total"))
    both = every.join(covered, by) if by else every.join(F.broadcast(covered), F.lit(True))
    return both.withColumn("covered_pct", F.when(F.col("total") > 0, F.round(100 * F.col("covered").cast("double") / F.col("total").cast("double"), 1)).otherwise(F.lit(0.0)))


def tool_savings(tx: DataFrame, by: list[str], years: int = 3) -> DataFrame:
    """A part of each entity's largest free category, saved each month in the reference fund, in today's money."""
    free = tx.filter(copilot_spend() & ~F.col("category_folded").rlike(BOUND))
    top = aggregates.top_k(aggregates.spend_by(free, by, "category"), by, "category", 1)
    plans = top.select(*by, "category", "total", F.round(F.col("total").cast("double") * CUT, 2).alias("saving"), F.lit(None).cast("double").alias("expense"))
    got = finance.simulate(plans, years, returns={FUND: finance.RETURNS[FUND]})
    return got.select(*by, "category", "total", F.col("saving").alias("monthly_saving"), "invested", "final_real")

def tool_anomalies(tx: DataFrame) -> DataFrame:
    """Flagged rows; none where no detection has run."""
    return tx.filter("is_anomaly") if "is_anomaly" in tx.columns else tx.limit(0)


def tool_refunds(tx: DataFrame) -> DataFrame:
    return tx.filter(copilot_refund()).withColumn("amount", -F.col("amount"))


def tool_obligations(tx: DataFrame, by: list[str], ties: list[str]) -> DataFrame:
    return obligations.known_obligations(obligations.components(tx, by), by, ties)


def render_summary(summary: DataFrame) -> DataFrame:
    """Adds ``answer``: the summary as text, amounts in Turkish form; the debt where it is known, a minimum payment that isn't zero."""
    cats = F.array_join(F.transform("top_categories", lambda c: F.concat(c["category"], F.lit(" ("), tl(c["amount"]), F.lit(")"))), ", ")
    return summary.withColumn(
        "answer",
        F.concat(F.lit("Toplam Harcama: "), tl(F.col("total_spend")), F.lit(" ("), F.col("transaction_count"), F.lit(" işlem). İadeler: "), tl(F.col("total_refunds")), F.coalesce(F.concat(F.lit(". Dönem Borcu: "), tl(F.col("total_debt"))), F.lit("")),
            F.when(F.col("min_payment") != 0, F.concat(F.lit(". Asgari Ödeme: "), tl(F.col("min_payment")))).otherwise(F.lit("")), F.lit(". En Yoğun Kategoriler: "), F.coalesce(cats, F.lit("yok")),
        ),
    )


def render_category(rows: DataFrame) -> DataFrame:
    return rows.withColumn("answer", F.concat("category", F.lit(": "), tl(F.col("gross_spend")), F.lit(" ("), F.col("transaction_count"), F.lit(" işlem, %"), F.col("share_pct"), F.lit("); iadeler "), tl(F.col("refunds")), F.lit(", net "), tl(F.col("net_spend"))))


def render_items(rows: DataFrame, label: str, amount: str) -> DataFrame:
    return rows.withColumn("answer", F.concat(F.col(label), F.lit(": "), tl(F.col(amount))))


def render_savings(rows: DataFrame) -> DataFrame:
    parts = ["category", F.lit(": "), tl(F.col("total")), F.lit("; ayda "), tl(F.col("monthly_saving").cast("decimal(38,2)")), F.lit(" birikim, "), tl(F.col("invested").cast("decimal(38,2)")), F.lit(" anapara, bugünün parasıyla "), tl(F.col("final_real").cast("decimal(38,2)"))]
    return rows.withColumn("answer", F.concat(*parts))


def ask(tx: DataFrame, question: str, ties: list[str]) -> tuple[str, str]:
    """(intent, answer) for one entity's transactions; refuses what it has no data for."""
    spark = tx.sparkSession
    rows = normalise(tx)
    asked = route(spark.createDataFrame([(question,)], "question string"), merchant_tokens(rows.filter(copilot_spend()))).first()
    intent, none = asked["intent"], "kayıt yok"
    # An answer to one person about one entity: every row of it, none left out.
    lines = lambda df: "\n".join(r["answer"] for r in df.select("answer").collect()) or none
    if intent == "unknown":
        return intent, UNSURE
    if intent == "unsupported_temporal":
        return intent, NO_HISTORY
    if intent == "summary":
        return intent, lines(render_summary(tool_summary(rows, [])))
    if intent == "category_spend":
        return intent, lines(render_category(tool_category_spend(rows, [], asked["category_ids"][0])))
    if intent == "compare_categories":
        return intent, lines(render_category(tool_compare_categories(rows, [], asked["category_ids"])).orderBy("rank"))
    if intent == "merchant_spend":
        return intent, lines(render_items(tool_merchant_spend(rows, [], asked["merchant_token"]), "merchant_token", "gross_spend"))
    if intent == "top_merchants":
        return intent, lines(render_items(tool_top_merchants(rows, []), "clean_description", "total").orderBy("rank"))
    if intent == "refunds":
        return intent, lines(render_items(tool_refunds(rows), "clean_description", "amount").orderBy("date", *ties))
    if intent == "obligations":
        return intent, lines(render_items(tool_obligations(rows, [], ties), "description", "amount").orderBy("kind", "description"))
    if intent == "anomalies":
        return intent, lines(render_items(tool_anomalies(rows), "clean_description", "amount").orderBy("date", *ties))
    return intent, lines(render_savings(tool_savings(rows, [])))
