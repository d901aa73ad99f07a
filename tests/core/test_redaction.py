"""Lines and rows of words, labels and their values, addresses."""

from pyspark.sql import functions as F

from ledgermill.operators import redaction as red

WORDS = "doc int, page int, words array<struct<x0:double,y0:double,x1:double,y1:double,text:string,block:int,line:int>>"


def words_of(lines):
    """One page of (x0, y0, text) lines, ten units a letter, each a block of its own."""
    out = []
    for block, (x0, y0, text) in enumerate(lines):
        for w in text.split(" "):
            out.append((x0, y0, x0 + 10.0 * len(w), y0 + 10.0, w, block, 0))
            x0 += 10.0 * len(w) + 10
    return [(1, 0, out)]


def test_every_label_of_a_line_is_found(spark):
    rows = [(1, "Telefon: 0532 Adres: X sok. Telefon: 0212"), (2, "Sayın Ad Soyad telefonu"), (3, ""), (4, None), (5, "T.C. Kimlik No: 1 tckn 2")]
    got = {r["doc"]: [(h["s"], h["e"], h["kind"]) for h in r["hits"]] for r in red.label_hits(spark.createDataFrame(rows, "doc int, text string")).collect()}
    assert got[1] == [(0, 8, "phone"), (14, 20, "address"), (28, 36, "phone")]
    assert got[2] == [(0, 6, "name"), (6, 15, "name")]
    assert got[3] == got[4] == []
    assert got[5] == [(0, 15, "tc"), (18, 23, "tc")]


def test_values_run_to_the_next_label_and_skip_transactions(spark):
    rows = [("Telefon: 0532 Telefon: 0212", False), ("12.05.2024 TELEFON AKSESUAR 120,00", True)]
    lines = spark.createDataFrame([(1, 0, k, 0, text, tx) for k, (text, tx) in enumerate(rows)], "doc int, page int, block int, line int, text string, is_tx boolean")
    assert sorted(r["value"] for r in red.label_values(lines).collect()) == ["0212", "0532"]


def test_address_lines_stand_under_label_or_value(spark):
    page = [(10.0, 0.0, "Adres: Gül Sok."), (80.0, 12.0, "No 5"), (300.0, 13.0, "Limit"), (10.0, 24.0, "Kadıköy"), (10.0, 36.0, "12.05.2024 MARKET 10,00"), (10.0, 48.0, "Moda")]
    lines = red.lines_of(spark.createDataFrame(words_of(page), WORDS)).withColumn("is_tx", F.col("text").contains("MARKET"))
    assert [r["text"] for r in red.address_lines(lines).orderBy("y0").collect()] == ["No 5", "Kadıköy"]


def test_words_of_near_centres_are_one_row(spark):
    page = [(50.0, 0.0, "MARKET"), (10.0, 2.0, "12.05.2024"), (10.0, 30.0, "Toplam")]
    rows = red.visual_rows(spark.createDataFrame(words_of(page), WORDS)).orderBy("row").collect()
    assert [(r["y0"], r["text"]) for r in rows] == [(0.0, "12.05.2024 MARKET"), (30.0, "Toplam")]


def test_header_ends_above_the_first_transaction(spark):
    rows = spark.createDataFrame([(1, 0, 40.0, False), (1, 0, 90.0, True), (2, 0, 40.0, False)], "doc int, page int, y0 double, is_tx boolean")
    heights = spark.createDataFrame([(1, 0.0, 800.0), (2, 0.0, 800.0)], "doc int, top double, height double")
    assert {r["doc"]: r["y"] for r in red.header_zone(rows, heights).collect()} == {1: 88.0, 2: 200.0}


def test_counts_by_kind(spark):
    texts = spark.createDataFrame([(1, "a@b.com ve c@d.org"), (2, "yok")], "doc int, text string")
    assert [(r["doc"], r["total"], r["counts"]) for r in red.redaction_counts(texts).collect()] == [(1, 2, {"email": 2})]


def test_hits_are_found_once_and_after_rows_are_dealt_out(spark):
    """Neither is a text's cutting repeated for each label, nor done by the few tasks that read a table."""
    lines = spark.createDataFrame([(1, 0, 0, 0, "Telefon: 0532\x00 Sayın A B")], "doc int, page int, block int, line int, text string").repartition(8)
    got = red.label_values(lines)
    assert [(r.kind, r.value) for r in got.collect()] == [("phone", "0532\x00"), ("name", "A B")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.rindex("Repartition") > plan.index("regexp_extract_all")


def test_pages_are_put_together_in_tasks_of_few_rows(spark, monkeypatch):
    from ledgermill.plans import questions

    monkeypatch.setattr(questions, "PAGE_ROWS", 100)
    plan = questions.pii_address_lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    many = -(-spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count() // 100)
    assert plan.count(f", {many}), REPARTITION_BY_NUM") == plan.count("Exchange hashpartitioning") == 2
