"""Cross-parsing against plain substring search, held-out accuracy, and odd tables."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgermill.llm import crossparse

TABLES = "/root/testdata/sf0.01"


def plain_phrases(text, sample, stretch):
    """Greedy phrases by searching the sample for ever longer substrings."""
    n = 0
    for start in range(0, len(text), stretch):
        part, at = text[start : start + stretch], 0
        while at < len(part):
            end = at + 1
            while end < len(part) and part[at : end + 1] in sample and part[at:end] in sample:
                end += 1
            at, n = end, n + 1
    return n


def test_automaton_knows_exactly_the_substrings():
    rng = random.Random(2)
    for _ in range(30):
        text = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14)))
        edges = crossparse.suffix_automaton(text)

        def reads(x, edges=edges):
            at = 0
            for c in x:
                if c not in edges[at]:
                    return False
                at = edges[at][c]
            return True

        for _ in range(60):
            x = bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 6)))
            assert reads(x) == (x in text)


@pytest.mark.parametrize("stretch", [3, 50, 2048])
def test_phrases_against_substring_search(stretch):
    rng = random.Random(stretch)
    samples = [bytes(rng.choice(letters) for _ in range(80)) for letters in (b"ab ", b"abc", b"x")]
    texts = [bytes(rng.choice(b"abc xyz") for _ in range(rng.randint(0, 120))) for _ in range(40)]
    found = crossparse.CrossParser(samples).phrases(texts, stretch, cells=500)
    assert found.tolist() == [[plain_phrases(t, s, stretch) for s in samples] for t in texts]


def test_names_and_scores_against_substring_search():
    samples = {"b": b"the cat and the dog sat on the mat", "a": "der hund und die katze saßen".encode(), "c": b"le chien"}
    model = crossparse.LanguageModel(samples)
    texts = ["The dog!", "die Katze", "Le CHIEN, le chien", "", "1234 !?", "ж", "saßen"]
    names, score = model.predict([t.encode() for t in texts])
    for text, name, value in zip(texts, names, score, strict=True):
        if not any(c.isalpha() for c in text):
            assert (name, value) == ("und", 0.0)
            continue
        symbols = len(set(b"".join(samples.values())))
        cost = {n: plain_phrases(crossparse.plain(text.encode()), s, 2048) * math.log2((len(s) + 1) * (symbols + 1)) for n, s in samples.items()}
        order = sorted(cost, key=lambda n: (cost[n], n))
        assert name == order[0] and value == pytest.approx(1 - cost[order[0]] / cost[order[1]])


def test_a_language_of_a_few_bytes_does_not_win_by_cheap_phrases(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    model = crossparse.fit(docs)
    more = crossparse.LanguageModel(dict(zip(model.names, model.samples, strict=True)) | {"xx": b"q", "yy": b"zu und"})
    texts = [r.text.encode() for r in docs.select("text").limit(60).collect() if r.text]
    assert more.predict(texts)[0] == model.predict(texts)[0]


def test_plain_parts_words_and_lowers_all_scripts():
    assert crossparse.plain("  ÉTÉ-42 Straße\n\tX ".encode()) == "été straße x".encode()
    assert not crossparse.has_letter("42 € …".encode()) and crossparse.has_letter("42 ж".encode()) and not crossparse.has_letter(b"")


def test_held_out_documents_and_whole_table(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    rows = crossparse.identify(docs).join(docs, "doc_id").select("doc_id", "held_out", "lang_pred", "score", "lang", "text").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert {r.lang_pred for r in rows} <= {"de", "en", "es", "fr", "und"}


def test_only_text_and_language_of_learned_rows_matter(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").limit(150)
    base = {r[0]: tuple(r) for r in crossparse.identify(docs).collect()}
    lied = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit("xx")).otherwise(F.col("lang")))
    lied = lied.withColumns({"source": F.lit("s"), "p": F.lit(1), "k": F.lit(2), "n": F.lit(3), "piece": F.lit("q"), "h": F.lit(0)}).repartition(6)
    assert {r[0]: tuple(r) for r in crossparse.identify(lied).collect()} == base


def test_odd_tables(spark):
    kind = "doc_id bigint, text string, lang string"
    learn = [k for k in range(40) if zlib.crc32(str(k).encode()) % 3 != 1]
    rows = [(k, ["the cat sat on the mat", "der hund und die katze"][k % 2], ["en", "de"][k % 2]) for k in learn]
    rows += [rows[0], (None, "the mat", "en"), (None, None, None), (101, "", None), (102, "42", "zz"), (103, "Die Katze " * 40_000, None), (104, "the the", None)]
    found = [tuple(r) for r in crossparse.identify(spark.createDataFrame(rows, kind)).collect()]
    assert len(found) == len(rows) and sum(r[0] == rows[0][0] for r in found) == 2
    told = {r[0]: r[2] for r in found}
    assert told[101] == told[102] == "und" and told[103] == "de" and told[104] == "en"
    assert sorted(r[2] for r in found if r[0] is None) == ["en", "und"]
    none = crossparse.identify(spark.createDataFrame([(1, "the", None)], kind)).collect()
    assert [tuple(r)[2:] for r in none] == [("und", 0.0)]
    one = crossparse.identify(spark.createDataFrame([(learn[0], "the cat", "en"), (900, "zzz", None)], kind)).collect()
    assert [tuple(r)[2:] for r in one] == [("en", 1.0)] * 2
    assert crossparse.identify(spark.createDataFrame([], kind)).collect() == []
    few = crossparse.fit(spark.createDataFrame(rows, kind), languages=1)
    assert len(few.names) == 1
