from collections import Counter

import corpus_pipeline as cp
from ledgermill.llm import packing, quality
from ledgermill.llm.common import materialize, read

from .test_simhash import slow_classes, slow_print
from .test_suffixdup import brute

FOLDER = "/root/testdata/sf0.001"


def test_every_stage_does_its_whole_work(spark):
    """Each stage against a brute-force version on its own input."""
    docs = read(spark, FOLDER, "documents").limit(120)
    columns, stages = docs.columns, dict(cp.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "repeats", "mixing", "packing"]
    good = materialize(stages["quality"](spark, docs, FOLDER))
    said = {r.doc_id: r.predicted for r in quality.score(docs, read(spark, FOLDER, "labels")).collect()}
    assert sorted(r.doc_id for r in good.collect()) == sorted(i for i, p in said.items() if p)

    single = materialize(stages["near_duplicates"](spark, good, FOLDER))
    classes = slow_classes({r.doc_id: slow_print(r.text) for r in good.collect()})
    assert sorted(r.doc_id for r in single.collect()) == sorted({i for i, c in classes.items() if i == c})

    cut = materialize(stages["repeats"](spark, single, FOLDER))
    before = sorted(single.collect(), key=lambda r: r.doc_id)
    after = {r.doc_id: r for r in cut.collect()}
    assert len(after) == len(before)
    for r, (n, removed, _, _) in zip(before, brute([r.text for r in before]), strict=True):
        kept = len((after[r.doc_id].text or "").encode())
        assert kept == n - removed if not removed else kept <= n - removed <= kept + 64

    mixed = materialize(stages["mixing"](spark, cut, FOLDER))
    assert Counter(map(tuple, mixed.collect())) == Counter(map(tuple, cut.collect()))
    assert all(x.columns == columns for x in (good, single, cut, mixed))

    packed = stages["packing"](spark, mixed, FOLDER).collect()
    fill = Counter()
    for r in packed:
        fill[r.sequence_id] += r.length
    assert {r.doc_id for r in packed} == set(after) and max(fill.values()) <= packing.CAPACITY
    assert len(fill) <= -(-sum(fill.values()) // packing.CAPACITY) + 1


def test_odd_tables(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp bigint, s int, lo int"
    for rows in ([], [(None, None, None, None, None, 1, 1, 1), (1, "", "en", "a", 0, 2, 2, 2), (1, "", "en", "a", 0, 2, 2, 2), (2, "word " * 3000, "en", None, 1, 3, 3, 3)]):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in cp.STAGES:
            out = stage(spark, docs, FOLDER)
            assert name == "packing" or out.columns == docs.columns
            assert out.count() <= max(len(rows), 4) * 3


def test_a_unique_text_under_a_repeated_id_passes_all_stages(spark):
    """The id 5 stands beside a copy and beside a text of its own; only the copy goes."""
    docs = read(spark, FOLDER, "documents").filter("length(text) > 600").limit(3).collect()
    w, u, x = (r.text for r in docs)
    rows = [(1, w, "en", "a", len(w)), (5, w, "en", "a", len(w)), (5, u, "en", "b", len(u)), (None, w, "en", "b", len(w)), (None, x, "en", "c", len(x))]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    single = dict(cp.STAGES)["near_duplicates"](spark, table, FOLDER)
    assert sorted(map(tuple, single.collect()), key=repr) == sorted([rows[0], rows[2], rows[4]], key=repr)
    for _, stage in cp.STAGES[2:4]:
        single = materialize(stage(spark, single, FOLDER))
    assert single.count() == 3
    packed = dict(cp.STAGES)["packing"](spark, single, FOLDER)
    assert {r.doc_id for r in packed.collect()} == {1, 5, None}


def test_sequences_follow_the_mixture(spark):
    """The small source holds its tempered share of tokens along sequence_id until it runs dry."""
    rows = [(i, "word and thing " * 2700, "small" if i % 10 == 0 else "large") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    stages = dict(cp.STAGES)
    packed = stages["packing"](spark, materialize(stages["mixing"](spark, docs, FOLDER)), FOLDER).collect()
    small, every = Counter(), Counter()
    for r in packed:
        every[r.sequence_id] += r.length
        small[r.sequence_id] += r.length * (r.doc_id % 10 == 0)
    want = 0.1**cp.POWER / (0.1**cp.POWER + 0.9**cp.POWER)
    ids, seen, tokens = sorted(every), 0, 0
    for k, s in enumerate(ids):
        seen, tokens = seen + small[s], tokens + every[s]
        if 0.1 < k / len(ids) < 0.35:
            assert abs(seen / tokens - want) < 0.05
    assert sum(every.values()) == sum(r.length for r in packed) and len({(r.doc_id, r.piece) for r in packed}) == len(packed)
