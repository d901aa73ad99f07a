"""Turkish-aware text functions: Column -> Column, all but NFC inside the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Latin-5 letters read as Latin-1, and the letters that folding maps to ASCII.
MOJIBAKE = ("ÐÝÞðýþ", "ĞİŞğış")
FOLD = ("çÇğĞıIİöÖşŞüÜâÂîÎûÛ", "ccggiiioossuuaaiiuu")

# Words without meaning for a merchant's kind, payment facilitators.
NOISE = [
    r"tic(?:aret)?\.?", r"a\.?s\.?", r"t\.a\.s\.?", r"ltd\.?", "limited", r"sti\.?", r"inc\.?", r"corp\.?", r"co\.?", "plc", "gmbh", "sarl", r"b\.?v\.?", r"n\.?v\.?",
    r"s\.?a\.?", "ab", "oy", "aps", "llc", "international", r"san\.", "sanayi", "subesi", r"sb\.?", "tr", "ist", "istanbul", "ankara", "izmir", "merkez",
    "london", "amsterdam", "dublin", "berlin", "paris", "madrid", "roma", "milano", "vienna", "stockholm", "helsinki", "copenhagen", "luxembourg", "zurich", "geneva",
    "dubai", "singapore", "hong kong", "tokyo", "seoul", "sydney", "toronto", "new york", "newyork", "san francisco", "seattle", "california", "delaware", "pos", "online", "etic",
]
FACILITATORS = [
    "iyzico", "iyz", "paytr", "pyt", "param", "sipay", "payu", "papara", "sbm", "bd", "mokaunited", "moka", "vallet", "craftgate", "paratika", "paycell", "ininal", "turkpara",
    "paynet", "payten", "birlesikodeme", "ozanpay", "tami", "hepsipay", "paribu", "elekse",
]
FACILITATOR = r"(?iU)^\s*(?:" + "|".join(FACILITATORS) + r")\s*[*/\-]\s*"
NOISE_WORDS = r"(?U)\b(?:" + "|".join(NOISE) + r")(?!\w)"
INSTALLMENT_SUFFIX = r"(?iuU)\s*\(?\d{1,2}\s*[./]?\s*(?:/\s*\d{1,2}\s*)?tak(?:s[iı]t|s[iı]d[iı])?\b\.?\)?"
DATE_MASK = r"(?U)\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b"
CURRENCY_MASK = r"(?U)\b\d{1,3}(?:\.\d{3})*,\d{2}\b(?:\s*(?:tl|try|usd|eur)\b)?|\b\d+(?:[.,]\d+)?\s*(?:tl|try|usd|eur)\b"
NUMBER_MASK = r"(?U)\b\d+(?:[.,/]\d+)*\b"


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


@F.pandas_udf(T.StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def normalize_unicode(text: Column, nfc: bool = True) -> Column:
    """Composed form, repaired letters, no stray dots above.

    Only rows with combining marks have something to compose; the others reach Python as null.
    """
    marked = text.rlike(r"\p{M}")
    composed = F.coalesce(_nfc(F.when(marked, text)), text) if nfc else text
    return F.replace(F.translate(composed, *MOJIBAKE), F.lit("̇"), F.lit(""))


def turkish_lower(text: Column, nfc: bool = True) -> Column:
    return F.lower(F.translate(normalize_unicode(text, nfc), "İI", "iı"))


def fold(text: Column, nfc: bool = True) -> Column:
    """Lower case with Turkish letters as ASCII; letters are mapped before lower-casing."""
    return F.lower(F.translate(normalize_unicode(text, nfc), *FOLD))


def folded(text: Column, ascii_only: Column) -> Column:
    """fold() without NFC, told whether the text is ASCII: nothing is mapped then."""
    return F.when(ascii_only, F.lower(text)).otherwise(fold(text, nfc=False))


def strip_facilitator(folded: Column) -> Column:
    return F.regexp_replace(folded, FACILITATOR, " ")


def strip_installment(folded: Column) -> Column:
    return F.regexp_replace(folded, INSTALLMENT_SUFFIX, " ")


def mask_amounts(folded: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(folded, DATE_MASK, " <date> "), CURRENCY_MASK, " <cur> ")


def strip_noise(folded: Column) -> Column:
    return F.regexp_replace(folded, NOISE_WORDS, " ")


def squeeze(text: Column) -> Column:
    """White space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def plain(text: Column) -> Column:
    """Whether the text is ASCII."""
    return ~text.rlike(r"[^\x00-\x7F]")


def plain_form(pattern: str) -> str:
    """The pattern for ASCII text, where Unicode classes and cases find the same, more slowly."""
    return pattern.replace("(?iuU)", "(?i)").replace("(?iu)", "(?i)").replace("(?U)", "")


def matches(text: Column, pattern: str, ascii_only: Column) -> Column:
    """rlike(), told whether the text is ASCII."""
    return F.when(ascii_only, text.rlike(plain_form(pattern))).otherwise(text.rlike(pattern))


def _ascii(pattern: str) -> str:
    """The pattern for folded ASCII text, where Unicode classes and cases find the same, more slowly."""
    return pattern.replace("(?U)", "").replace("(?iU)", "").replace("(?iuU)", "")


def _cleaned(t: Column, mask_numbers: bool, form: Callable[[str], str], digits: bool) -> Column:
    """Folded text, cleaned; ``form`` rewrites the patterns, of which those for numbers are for texts with digits only."""
    t = F.regexp_replace(t, form(FACILITATOR), " ")
    if digits:
        t = F.regexp_replace(t, form(INSTALLMENT_SUFFIX), " ")
        t = F.regexp_replace(F.regexp_replace(t, form(DATE_MASK), " <date> "), form(CURRENCY_MASK), " <cur> ")
    t = F.regexp_replace(t, form(NOISE_WORDS), " ")
    if mask_numbers and digits:
        t = F.regexp_replace(t, form(NUMBER_MASK), " <num> ")
    t = F.regexp_replace(t, form(r"(?U)[^\w\s<>]"), " ")
    t = F.regexp_replace(t, form(r"(?U)(?<!\S)[^\W\d_](?!\S)"), " ")
    return F.trim(F.regexp_replace(t, form(r"(?U)\s+"), " "))


def clean_merchant(text: Column, mask_numbers: bool = True, nfc: bool = True) -> Column:
    """Canonical merchant text; cleaning it again changes nothing. Null gives the empty text."""
    t = fold(F.coalesce(text, F.lit("")), nfc)
    whole = _cleaned(t, mask_numbers, str, True)
    return F.when(t.rlike(r"[^\x00-\x7F]"), whole).when(t.rlike("[0-9]"), _cleaned(t, mask_numbers, _ascii, True)).otherwise(_cleaned(t, mask_numbers, _ascii, False))


def collapse_digits(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\d+", "#")


def contains_ignoring_case(text: Column, word: str) -> Column:
    return text.rlike("(?iu)" + word)


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def tl(value: Column) -> Column:
    """1234.5 as '1.234,50 TL'."""
    return F.concat(F.translate(F.format_number(value, 2), ",.", ".,"), F.lit(" TL"))


def render_amount(value: Column, locale: str = "tr", refund_style: str = "minus") -> Column:
    """A signed amount as a statement prints it; credits by '-', a trailing '-', or '(A)'."""
    size = F.format_number(F.abs(value), 2)
    size = F.translate(size, ",.", ".,") if locale == "tr" else size
    marked = {"minus": F.concat(F.lit("-"), size), "trailing": F.concat(size, F.lit("-")), "mark": F.concat(size, F.lit(" (A)"))}[refund_style]
    return F.when(value < 0, marked).otherwise(size)


def odd_characters(rows: DataFrame, column: str, beyond: int = 0x24F, n: int = 8) -> DataFrame:
    """beyond, c, n: the n commonest characters with a code point over ``beyond``."""
    letters = rows.select(F.explode(F.regexp_extract_all(column, F.lit(f"[^\\x{{0}}-\\x{{{beyond:x}}}]"), F.lit(0))).alias("c"))
    return letters.groupBy(F.lit(beyond).alias("beyond"), "c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "c").limit(n)


def shape(text: Column) -> Column:
    """Letters as A and digits as 9."""
    return F.regexp_replace(F.regexp_replace(text, r"\p{L}", "A"), r"\p{N}", "9")


def shape_keeping(text: Column, safe_words: list[str]) -> Column:
    """The shape of a text's blank-separated words but for safe words (folded), which stay."""
    words = F.split(text, " ")
    return F.array_join(F.transform(words, lambda w: F.when(fold(w, nfc=False).isin(*safe_words), w).otherwise(shape(w))), " ")
