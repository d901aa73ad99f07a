"""Counting terms by blocks, and dealing rows out for it."""

from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from ledgermill.functions import text
from ledgermill.operators import vectorizer
from ledgermill.operators.vectorizer import TermCounter, grams_of
from ledgermill.sources import storage, synthetic

TEXTS = ["ab banana  ab\tan", None, "", " \n ", "çay şeker çay", "x"] + [f"w{k} banana w{k % 7}" for k in range(300)]


def test_blocks_equal_plain_counts(monkeypatch):
    for words, kept in ((5, 3), (32_768, 200_000)):  # blocks of a few words; all in one
        monkeypatch.setattr(vectorizer, "WORDS", words)
        monkeypatch.setattr(vectorizer, "KNOWN", kept)
        names: dict[str, int] = {}
        counter, got = TermCounter(lambda t: names.setdefault(t, len(names))), []
        texts = pa.array(["before", *TEXTS]).slice(1)
        for rows, row, term, n in counter.blocks(texts):
            found = [{} for _ in range(rows)]
            for r, t, x in zip(row.tolist(), term.tolist(), n.tolist(), strict=True):
                found[r][t] = x
            got += found
        of = list(names)
        want = [dict(Counter(g for w in (t or "").split() for g in grams_of(w))) for t in TEXTS]
        assert [{of[t]: x for t, x in each.items()} for each in got] == want


def test_a_file_of_one_row_group_is_dealt_out(spark, tmp_path):
    spark.range(5000).coalesce(1).write.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = storage.spread(spark.read.parquet(str(tmp_path / "t")))
        assert rows.groupBy(F.spark_partition_id()).count().count() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_texts_are_cleaned_once_and_alike_with_and_without_ascii(spark):
    odd = ["IYZICO*MARKET A.S. 0042", "3 taksit 12/03/2024 1.250,50 TL x new york", "Şok é a.s. 12 tak", "ring <num> \t co.", "", None, "12 usd\x0bLTD (2/6 TAKSIT)"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "k int, t string")
    folded = text.fold(F.coalesce("t", F.lit("")), nfc=False)
    got = rows.select(text.clean_merchant(F.col("t"), nfc=False).alias("a"), text._cleaned(folded, True, str, True).alias("b")).collect()
    assert all(r.a == r.b for r in got)
    pairs = spark.createDataFrame([("c", "large ring")], "category string, brand string")
    made = synthetic.merchant_texts(pairs, pairs.withColumnRenamed("brand", "keyword"), ["PERU"], 10)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in line and "hong kong" in line for line in plan.split("\n"))


def test_a_gram_is_numbered_once_and_odd_letters_lose_nothing(monkeypatch):
    """Words share their n-grams' numbers; letters beyond the alphabet and the letter zero take names instead of keys."""
    texts = pa.array([*TEXTS, "a\0b \0 b\0", "αβγδεζηθικλμνξο αβγ ab", "\U0001d11ex αβγδεζηθ"])
    want = [dict(Counter(g for w in (t or "").split() for g in grams_of(w))) for t in texts.to_pylist()]
    for bits, letters in ((12, 4095), (4, 15)):
        monkeypatch.setattr(vectorizer, "BITS", bits)
        monkeypatch.setattr(vectorizer, "LETTERS", letters)
        calls: list[str] = []
        counter, got, of = TermCounter(lambda t: calls.append(t) or len(calls) - 1), [], calls
        for rows, row, term, n in counter.blocks(texts):
            found = [{} for _ in range(rows)]
            for r, t, x in zip(row.tolist(), term.tolist(), n.tolist(), strict=True):
                found[r][of[t]] = x
            got += found
        assert got == want and len(calls) == len(set(calls))
        sums = {of[t]: (d, x) for term, df, total in TermCounter(lambda t: calls.index(t)).sums(texts) for t, d, x in zip(term.tolist(), df.tolist(), total.tolist(), strict=True)}
        assert sums == {g: (sum(g in w for w in want), sum(w.get(g, 0) for w in want)) for g in calls}
        some = [g for g in calls if "a" in g or "\0" in g or "θ" in g]
        kept = TermCounter(lambda t: some.index(t), only=some)
        part = [(term.tolist(), n.tolist()) for _, _, term, n in kept.blocks(texts)]
        assert sum(sum(n) for _, n in part) == sum(x for w in want for g, x in w.items() if g in some)
