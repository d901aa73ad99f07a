import zlib

import numpy as np

from ledgermill.llm import quality


def make(spark, n=900):
    rng = np.random.default_rng(3)
    words = ["sa", "rethi", "onde", "that", "lurem", "ipsa", "vento", "mara"]
    docs, labels = [], []
    for i in range(n):
        good = int(rng.random() < 0.7)
        text = " ".join(rng.choice(words, int(rng.integers(5, 80)))) + "."
        if not good:
            text = " ".join(x + "$$$" for x in text.split()) if i % 2 else " ".join(["mara"] * 50)
        docs.append((i, text, "x", 1))
        labels.append((i, good, 0))
    return spark.createDataFrame(docs, "doc_id bigint, text string, s string, score int"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), labels


def test_held_out_accuracy_and_purity(spark):
    docs, labels, rows = make(spark)
    got = {r.doc_id: r for r in quality.score(docs, labels).collect()}
    truth = {i: g for i, g, _ in rows}
    assert len(got) == len(truth)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    held = [i for i in got if got[i].held_out]
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.97
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.keep_good(docs, labels).count() == sum(r.predicted for r in got.values())


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels, rows = make(spark, 300)
    flipped = spark.createDataFrame([(i, 1 - g if zlib.crc32(str(i).encode()) % 3 == 1 else g, t) for i, g, t in rows], labels.schema)
    a, b = ({r.doc_id: r.score for r in quality.score(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_degenerate_inputs(spark):
    docs, labels, _ = make(spark, 30)
    none = labels.limit(0)
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(docs.limit(0), labels).count() == 0
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "a " * 100_000)], "doc_id bigint, text string")
    rows = quality.score(odd, spark.createDataFrame([(1, None, 0), (None, 1, 0), (2, 1, 0)], labels.schema)).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
