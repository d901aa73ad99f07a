"""Repeatable synthetic merchant texts and statements: every draw is a hash of seed and row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_merchant

SUFFIXES = ["", " A.S.", " LTD STI", " ISTANBUL", " 0042", " TR"]
PREFIXES = ["", "IYZICO*", "PAYTR/", "SIPAY-"]
CUTS = [19, 22, 25, 30, 60]
#: Share of generic rows in a class with keywords, and the class of what belongs to none.
GENERIC, OTHER = 0.4, "Diğer / Belirsiz"
CONSONANTS, VOWELS, ENDS = "BCDFGHKLMNPRSTVYZ", "AEIOU", ["", "N", "R", "S", "X"]
FIRST_NAMES = ["AYSE", "MEHMET", "ELIF", "CAN", "ZEYNEP", "MURAT"]
TRANSFERS, NO_CLASS = ["HAVALE", "EFT", "FAST", "GELEN FAST"], ["TICARET", "ISLETME", "GRUP", "DAGITIM", "HOLDING"]


def draw(seed: int, name: str, n: int) -> Column:
    """A number below n from the row's id."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(name), F.col("id")), F.lit(n)).cast("int")


def pick(values: list[str], at: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), at)


def corrupted(text: Column, seed: int) -> Column:
    """Decorations, dropped vowels, a swapped or deleted letter, truncation."""
    at = 2 + F.pmod(draw(seed, "at", 1000), F.greatest(F.length(text) - 2, F.lit(1)))
    without = F.concat(F.substr(text, F.lit(1), at - 1), F.substr(text, at + 1))
    swapped = F.concat(F.substr(text, F.lit(1), at - 1), F.substr(text, at + 1, F.lit(1)), F.substr(text, at, F.lit(1)), F.substr(text, at + 2))
    kind = draw(seed, "kind", 10)
    bent = F.when(kind == 0, F.regexp_replace(text, "(?<=.)[AEIOU]", "")).when(kind == 1, without).when(kind == 2, swapped).otherwise(text)
    whole = F.concat(pick(PREFIXES, draw(seed, "prefix", len(PREFIXES))), bent, pick(SUFFIXES, draw(seed, "suffix", len(SUFFIXES))))
    return F.substr(whole, F.lit(1), F.get(F.array(*[F.lit(c) for c in CUTS]), draw(seed, "cut", len(CUTS))))


def syllables(seed: int, name: str, least: int = 2, most: int = 4) -> Column:
    """A word that means nothing but can be spoken: consonant and vowel by turns, perhaps an end."""
    pair = lambda k: F.concat(pick(list(CONSONANTS), draw(seed, f"{name}c{k}", len(CONSONANTS))), pick(list(VOWELS), draw(seed, f"{name}v{k}", len(VOWELS))))
    many = least + draw(seed, f"{name}n", most - least + 1)
    return F.concat(*[F.when(many > k, pair(k)).otherwise(F.lit("")) for k in range(most)], pick(ENDS, draw(seed, f"{name}e", len(ENDS))))


def quota(place: Column, share: float) -> Column:
    """Whether a place (0, 1, ...) is one of the share; of the first n places exactly floor(n x share) are."""
    return F.floor((place + 1) * F.lit(share) + 1e-9) > F.floor(place * F.lit(share) + 1e-9)


def _numbered(pairs: DataFrame, value: str) -> DataFrame:
    """category, value, number (from 0) and many, the category's number of values."""
    own = Window.partitionBy("category")
    return pairs.select("category", value).distinct().withColumns({"number": F.row_number().over(own.orderBy(value)) - 1, "many": F.count(F.lit(1)).over(own)})


def merchant_rows(brands: DataFrame, keywords: DataFrame, names: list[str], rows: int, seed: int = 42, other: str = OTHER) -> DataFrame:
    """raw_text, category, group, source: ``rows`` rows, dealt evenly to the categories and ``other``.

    Classes in the order of their names, ``other`` last, have equal numbers of rows; what is over goes
    to the first ones, a row each. In a class with keywords 40 % of the rows, rounded down, are
    "generic", a name with a keyword, the others are "brand"; ``other`` has transfers to persons,
    names with words of no class, invented words and codes. ``group`` keeps what a split must
    not part: the brand, or the name. ``brands`` is (category, brand), ``keywords`` (category, keyword);
    categories, a few dozen, are those of ``brands``.
    """
    spark = brands.sparkSession
    classes = [r[0] for r in brands.select("category").filter("category is not null").distinct().orderBy("category").collect()]
    many = len(classes) + 1
    ids = spark.range(rows).withColumns({"category": F.get(F.array(*[F.lit(c) for c in [*classes, other]]), F.pmod("id", F.lit(many)).cast("int")), "place": F.floor(F.col("id") / many), "last": F.pmod("id", F.lit(many)) == many - 1})
    worded = {r[0] for r in keywords.select("category").distinct().collect()}
    generic = F.col("category").isin([c for c in classes if c in worded]) & quota(F.col("place"), GENERIC)
    ids = ids.withColumn("source", F.when(F.col("last"), "other").when(generic, "generic").otherwise("brand"))
    # Words are columns of their own, so that what uses them several times reads them.
    spoken = ids.withColumn("word", syllables(seed, "w")).withColumn("name", F.when(draw(seed, "named", 10) < 7, pick(names, draw(seed, "name", len(names)))).otherwise(F.col("word")))

    def joined(rows: DataFrame, source: str, pairs: DataFrame, value: str) -> DataFrame:
        mine, sizes = rows.filter(F.col("source") == source), pairs.groupBy("category").agg(F.max("many").alias("n"))
        with_number = mine.join(F.broadcast(sizes), "category").withColumn("number", F.pmod(draw(seed, value, 1 << 30), F.col("n")).cast("int"))
        return with_number.join(pairs.select("category", "number", value), ["category", "number"])

    shape = ["id", "category", "source", "group", "core", "bent"]
    branded = joined(ids, "brand", _numbered(brands, "brand"), "brand").withColumns({"group": F.concat(F.lit("brand:"), "brand"), "core": F.col("brand"), "bent": F.lit(True)}).select(shape)
    core = F.when(draw(seed, "turned", 5) < 4, F.concat_ws(" ", "name", "keyword")).otherwise(F.concat_ws(" ", "keyword", "name"))
    named = joined(spoken, "generic", _numbered(keywords, "keyword"), "keyword").withColumns({"group": F.concat(F.lit("generic:"), "name"), "core": core, "bent": F.lit(True)}).select(shape)
    kinds = spoken.filter("source = 'other'").withColumns({"roll": draw(seed, "roll", 100), "a": syllables(seed, "a"), "b": syllables(seed, "b")})
    person = F.concat_ws(" ", pick(FIRST_NAMES, draw(seed, "first", len(FIRST_NAMES))), pick(names, draw(seed, "name", len(names))))
    code = F.upper(F.substr(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")).cast("binary")), F.lit(1), 4 + draw(seed, "length", 9)))
    roll, unknown = F.col("roll"), F.when(draw(seed, "two", 2) == 0, F.col("a")).otherwise(F.concat_ws(" ", "a", "b"))
    kinds = kinds.withColumn("key", F.when(roll < 35, person).when(roll < 70, F.col("name")).when(roll < 92, unknown).otherwise(code))
    text = F.when(roll < 35, F.concat_ws(" ", pick(TRANSFERS, draw(seed, "transfer", len(TRANSFERS))), "key")).when(roll < 70, F.concat_ws(" ", F.col("key"), pick(NO_CLASS, draw(seed, "word", len(NO_CLASS))))).otherwise(F.col("key"))
    others = kinds.withColumns({"group": F.concat(F.lit("other:"), "key"), "core": text, "bent": (roll >= 35) & (roll < 92)}).select(shape)
    every = branded.unionByName(named).unionByName(others).withColumn("core", F.upper("core"))
    return every.withColumn("raw_text", F.when(F.col("bent"), corrupted(F.col("core"), seed)).otherwise(F.col("core"))).drop("core", "bent")


def merchant_texts(brands: DataFrame, keywords: DataFrame, names: list[str], rows: int, seed: int = 42, other: str = OTHER) -> DataFrame:
    """merchant_rows() with ``clean_text``, without the few whose cleaned text is empty."""
    out = merchant_rows(brands, keywords, names, rows, seed, other)
    # By a generator, below which no filter is pushed: texts are cleaned once.
    return out.select("*", F.stack(F.lit(1), clean_merchant(F.col("raw_text"), nfc=False)).alias("clean_text")).filter(F.length("clean_text") > 0)


def national_id(seed: int) -> Column:
    """A valid eleven-digit number for each id."""
    d = [1 + draw(seed, "d0", 9), *[draw(seed, f"d{k}", 10) for k in range(1, 9)]]
    tenth = F.pmod((d[0] + d[2] + d[4] + d[6] + d[8]) * 7 - (d[1] + d[3] + d[5] + d[7]), F.lit(10))
    last = F.pmod(sum(d[1:], d[0]) + tenth, F.lit(10))
    return F.concat(*[x.cast("string") for x in [*d, tenth, last]])


def statement_accounts(spend: Column, interest: Column) -> dict[str, Column]:
    """Levies of 15 % each on interest, the debt, and a fifth of it as minimum payment, rounded half up to cents."""
    levy = F.round(interest * F.lit("0.15").cast("decimal(4,2)"), 2)
    debt = (spend + interest + levy + levy).cast("decimal(18,2)")
    return {"kkdf": levy, "bsmv": levy, "total_debt": debt, "min_payment": F.round(debt * F.lit("0.20").cast("decimal(4,2)"), 2)}
