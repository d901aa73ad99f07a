import numpy as np
from pyspark.sql import functions as F

from ledgermill.llm import vptree


def brute(ids, x, k):
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % 100 == 0:
            d = np.sqrt(((x - q) ** 2).sum(1))
            out[i] = sorted((a, j) for a, j in zip(d, ids, strict=True) if j != i)[:k]
    return out


def frame(spark, n=1500, dim=8):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(n, dim)) + rng.integers(0, 6, (n, 1)) * 4, 1).astype(np.float32)
    x[1200:1230] = x[100]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    bad = [(10_000, None, 0), (10_100, [0.0] * dim, 0), (10_200, [float("nan")] * dim, 0), (None, [1.0] * dim, 0), (10_300, [1.0, 2.0], 0)]
    return spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>, rank int"), np.arange(n), x.astype(float)


def test_factor_one_is_exact(spark):
    vectors, ids, x = frame(spark)
    want = brute(ids, x, 10)
    for kw in ({}, {"shard": 200, "query_block": 4}):
        got = {}
        for r in vptree.nearest(vectors, F.col("vec_id") % 100 == 0, factor=1.0, **kw).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.score, r.vec_id))
            assert r.rank == len(got[r.query_id])
        assert got == want


def recall_and_share(monkeypatch, x, shards=2, k=10):
    """Of the tuned search in production form: recall, and the share of all distances that it computes."""
    rng, n, done = np.random.default_rng(5), len(x), [0]
    order = rng.permutation(n)
    pilot, ids, own = x[order[: vptree.PILOT]], np.arange(n), np.arange(0, n, 100)
    factor = vptree.tuned(pilot, k)
    far = vptree.distances(x, x[own])
    far[np.arange(len(own)), own] = np.inf
    near = far[:, order[: vptree.PILOT]]
    bound, plain = vptree.kth(near, k), vptree.distances
    d, found = [], []
    for part in np.array_split(rng.permutation(n), shards):
        tree = vptree.build(x[part])
        monkeypatch.setattr(vptree, "distances", lambda a, q: (done.__setitem__(0, done[0] + len(a) * len(q)), plain(a, q))[1])
        best = vptree.search(tree, x[part], part, x[own], own, k, factor, bound)
        monkeypatch.setattr(vptree, "distances", plain)
        d.append(best.d)
        found.append(best.id)
    d = np.sort(np.concatenate(d, 1), axis=1)[:, :k]
    return (d <= np.sort(far, axis=1)[:, k - 1 : k] * (1 + 1e-9)).mean(), done[0] / (n * len(own)), factor


def test_the_tuned_factor_keeps_recall_and_prunes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("embedding").toArrow()
    given = np.array([v for v in table.column(0).to_pylist() if v is not None and len(v) == 64 and None not in v and np.isfinite(v).all() and any(v)], float)
    copies = np.repeat(rng.normal(size=(60, 64)), 50, axis=0) + rng.normal(size=(3000, 64)) * 0.05
    for x, most in ((given, 1.0), (rng.normal(size=(6000, 3)), 0.5), (copies, 1.0), (rng.normal(size=(6000, 64)), 1.1)):
        recall, share, _ = recall_and_share(monkeypatch, x)
        assert recall >= 0.9 and share < most


def test_few_and_no_candidates(spark):
    schema = "vec_id bigint, embedding array<double>"
    assert vptree.nearest(spark.createDataFrame([], schema), F.col("vec_id") % 100 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [3.0]), (2, [2.0]), (2, [2.0])], schema)
    got = vptree.nearest(few, F.col("vec_id") % 100 == 0).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(1, 2, 1.0), (2, 1, 2.0)]
