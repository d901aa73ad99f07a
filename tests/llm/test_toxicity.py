import zlib

import numpy as np

from ledgermill.llm import toxicity

KINDS = (["vrakor", "smeltik", "drozz"], ["phlumbering", "yirrowgate", "oksu"])


def make(spark, n=1800):
    rng = np.random.default_rng(6)
    plain = ["sa", "rethi", "onde", "that", "lurem", "ipsa", "vento", "mara", "été"]
    docs, labels, kinds = [], [], []
    for i in range(n):
        words = list(rng.choice(plain, int(rng.integers(5, 60))))
        kind = int(rng.integers(2)) if rng.random() < 0.25 else -1
        for w in rng.choice(KINDS[kind], 3) if kind >= 0 else ():
            words.insert(int(rng.integers(len(words))), w.upper() if i % 3 else w + "!")
        docs.append((i, " ".join(words), "s", 0.1))
        labels.append((i, 1, int(kind >= 0)))
        kinds.append(kind)
    return spark.createDataFrame(docs, "doc_id bigint, text string, words string, p_toxic double"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), kinds


def test_every_link_of_the_chain_holds_on_the_held_out_third(spark):
    docs, labels, kinds = make(spark)
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    held = [i for i in got if got[i].held_out]
    truth = np.array([kinds[i] for i in held])
    first, second, toxic = (np.array([getattr(got[i], c) >= 0.5 for i in held]) for c in ("p_theme_1", "p_theme_2", "p_toxic"))
    if (first & (truth == 0)).sum() < (first & (truth == 1)).sum():
        first, second = second, first
    for said, true in ((first, truth == 0), (second, truth == 1), (toxic, truth >= 0)):
        assert (said & true).sum() > 0.95 * true.sum() and (said & true).sum() > 0.95 * said.sum()
    assert [got[i].predicted for i in held] == toxic.astype(int).tolist()


def test_toxic_rows_of_the_tables(spark):
    """Held-out recall and precision on the given tables."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, labels).filter("held_out").join(labels, "doc_id").selectExpr("sum(predicted * toxic) AS hit", "sum(predicted) AS said", "sum(toxic) AS true").first()
    assert got.true > 50 and got.hit > 0.8 * got.true and got.hit > 0.9 * got.said


def test_themes_of_the_tables_are_categories_that_the_chain_uses(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    seen = {}

    def spied(words, y, names, fit=toxicity.fit_chain, **more):
        # Learned on one half, each link must find its category in the other.
        half = fit(words[::2], y[::2], names)
        seen["y"], seen["said"] = y, toxicity.apply_chain(half, words[1::2], names) >= 0.5
        seen["chain"] = fit(words, y, names, **more)
        return seen["chain"]

    monkeypatch.setattr(toxicity, "fit_chain", spied)
    held = toxicity.score(docs, labels).filter("held_out").selectExpr("sum(int(p_theme_1 >= 0.5)) AS a", "sum(int(p_theme_2 >= 0.5)) AS b").first()
    y, said = seen["y"], seen["said"]
    assert (y[:, :2].sum(0) >= 0.1 * y[:, 2].sum()).all() and (y[:, :2].sum(1) <= y[:, 2]).all()
    for k in range(3):
        true = y[1::2, k] > 0
        assert (said[:, k] & true).sum() > 0.5 * true.sum() and (said[:, k] & true).sum() > 0.9 * said[:, k].sum()
    assert min(seen["chain"][2].earlier) > 1 and min(held) >= 10


def test_a_theme_too_small_to_learn_gives_way_to_equal_parts():
    rng = np.random.default_rng(0)
    words = (rng.random((400, 12)) < 0.3).astype(np.float32)
    toxic = (np.arange(400) < 100).astype(float)
    words[:100, :4] = rng.random((100, 4)) < 0.9
    words[0, :] = 0
    words[0, 3] = 1
    for themes in (2, 3):
        got = toxicity.themes_of(words, toxic, themes)
        assert (got[100:] == -1).all() and np.bincount(got[:100] + 1, minlength=themes + 1)[1:].min() >= 10
    assert (toxicity.themes_of(words, np.zeros(400)) == -1).all() and (toxicity.themes_of(words, np.ones(400)) == -1).all()


def test_earlier_probabilities_win_where_words_alone_cannot():
    """The last label is the exclusive-or of two words: linear only beside the earlier label, both words together."""
    rng = np.random.default_rng(1)
    words = (rng.random((3000, 2)) < 0.5).astype(np.float32)
    y = np.column_stack([words.all(1), words.sum(1) == 1]).astype(float)
    said = {}
    for chained in (True, False):
        chain = toxicity.fit_chain(words[:2000], y[:2000], [11, 22], chained=chained)
        assert [len(m.earlier) for m in chain] == ([0, 1] if chained else [0, 0])
        said[chained] = ((toxicity.apply_chain(chain, words[2000:], [11, 22])[:, 1] > 0.5) == y[2000:, 1]).mean()
    assert said[True] > 0.95 and said[False] < 0.8


def test_earlier_probabilities_are_out_of_fold():
    """A label that is noise: told in-fold, the next model would lean on it; out-of-fold it can't."""
    rng = np.random.default_rng(2)
    words = np.eye(300, dtype=np.float32)
    noise = (rng.random(300) < 0.5).astype(float)
    chain = toxicity.fit_chain(words, np.column_stack([noise, noise]), list(range(300)))
    assert chain[1].earlier[0] < 1


def test_degenerate_inputs(spark):
    docs, labels, _ = make(spark, 60)
    assert toxicity.score(docs, labels.limit(0)).count() == 60
    assert toxicity.score(docs.limit(0), labels).count() == 0
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "drozz " * 50_000)], "doc_id bigint, text string")
    rows = toxicity.score(odd, labels).collect()
    assert len(rows) == 4 and all(0 <= r.p_toxic <= 1 for r in rows)


def test_null_and_conflicting_labels(spark):
    docs, labels, _ = make(spark)
    want = sorted((r.doc_id, r.p_toxic) for r in toxicity.score(docs, labels).collect())
    more = labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, 1, None), (999_999, 1, 1)], labels.schema))
    more = more.unionByName(labels.filter("toxic = 1").selectExpr("doc_id", "quality", "CAST(0 AS INT) AS toxic"))
    assert sorted((r.doc_id, r.p_toxic) for r in toxicity.score(docs, more).collect()) == want
