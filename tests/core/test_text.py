import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgermill.functions import pii, text
from ledgermill.sources import synthetic

CLEAN = [
    ("MokaUnited/BERSHKA G", "bershka"), ("IYZICO*GETIR 3/6 TAKSIT", "getir"), ("KOÇTAŞ YAPI MARKET A.Ş. İSTANBUL", "koctas yapi market"), ("STRADIVARIUS IZMIR I", "stradivarius"), ("Þok Market", "sok market"),
    ("A101 0042", "a101 <num>"), ("15.08.2026 GIDA 1.250,50 TL", "<date> gida <cur>"), ("", ""), (None, ""), ("ŞİŞLİ", "sisli"), ("PARAMOUNT", "paramount"), ("TRENDYOL", "trendyol"),
]


def column(spark, values, f):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string").select("k", f(F.col("v")).alias("out")).collect()
    return [r.out for r in sorted(rows, key=lambda r: r.k)]


def test_cleaning_and_its_repetition(spark):
    got = column(spark, [a for a, _ in CLEAN], text.clean_merchant)
    assert got == [b for _, b in CLEAN]
    assert column(spark, got, text.clean_merchant) == got


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="aBçĞıİ ./*-3/6taksitAŞ1,50TL()", max_size=25), min_size=20, max_size=40))
def test_cleaning_is_idempotent(spark, values):
    once = column(spark, values, lambda c: text.clean_merchant(c, nfc=False))
    assert column(spark, once, lambda c: text.clean_merchant(c, nfc=False)) == once


def test_folding_and_format(spark):
    assert column(spark, ["İSTANBUL", "KOÇTAŞ", "şok", None], text.fold) == ["istanbul", "koctas", "sok", None]
    assert column(spark, ["1234.5", "0", "-9876543.215"], lambda c: text.tl(c.cast("decimal(18,2)"))) == ["1.234,50 TL", "0,00 TL", "-9.876.543,22 TL"]
    assert column(spark, ["<a href='x'>&"], text.escape_html) == ["&lt;a href=&#x27;x&#x27;&gt;&amp;"]


@pytest.mark.parametrize("kind,valid", [("tc", pii.is_valid_tc)])
def test_national_ids_catch_single_errors(spark, kind, valid):
    ids = [r.tc for r in spark.range(60).withColumn("tc", synthetic.national_id(3)).select("tc").collect()]
    assert all(column(spark, ids, valid))
    bent = [i[:k] + str((int(i[k]) + 1) % 10) + i[k + 1 :] for k, i in enumerate(ids[:11])]
    assert not any(column(spark, [*bent, "12345678901", "0" * 11, "", "x" * 11], valid))


def test_masks(spark):
    raw = [
        "TC 10000000146 kart 4539 1488 0343 6467 son", "IBAN TR330006100519786457841326 mail a.b@x.com.tr tel 0532 123 45 67", "HAVALE AHMET YILMAZ 4829", "HAVALE EFT UCRETI", "ref 12345678901 kalir",
        "GIDEN FAST ALICI AYŞE KAYA AÇIKLAMA", None, "",
    ]
    got = column(spark, raw, pii.mask_text)
    assert got == [
        "TC 10*******46 kart 4539 **** **** 6467 son", "IBAN TR** **** **** **** **** **26 mail [E-POSTA] tel [TELEFON]", "HAVALE [KİŞİ] 4829", "HAVALE EFT UCRETI", "ref 12345678901 kalir",
        "GIDEN FAST ALICI [KİŞİ]", None, "",
    ]
    names = column(spark, ["Sayın ŞÜKRÜ ÖZ bugün"], lambda c: pii.mask_text(c, F.array(F.lit("şükrü öz"))))
    assert names == ["Sayın [KİŞİ] bugün"]
