import math

import numpy as np

from ledgermill.llm import neardup


def slow(rows, cosine=0.9):
    units = {}
    for k, (_, v, _) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            units[k] = np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float))
    links = {k: {j for j in units if j != k and len(units[j]) == len(units[k]) and units[j] @ units[k] >= cosine - 1e-12} for k in units}
    label = {k: k for k in range(len(rows))}
    for _ in rows:
        label = {k: min([label[k], *(label[j] for j in links.get(k, ()))]) for k in label}
    return [(len(links.get(k, ())), label[k]) for k in range(len(rows))]


def rows():
    rng = np.random.default_rng(9)
    out = []
    for _ in range(60):
        base = rng.normal(size=16)
        out.append(base)
        for scale in (0.1, 0.25, 0.4, 0.5):
            out.append(base * 3 + 3 * scale * rng.normal(size=16))
    vectors = [v.astype(np.float32).tolist() for v in out] + [out[0].astype(np.float32).tolist()] * 3
    vectors += [None, [], [0.0] * 16, [-0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [0.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [1.0, 0.0, -0.0], [1.0, 0.0, 0.0], [3e38] * 16, [1e-38] * 16]
    return [(i, v, i % 3) for i, v in enumerate(vectors)]


def test_matches_brute_force_for_any_blocks_and_parts(spark):
    data = rows()
    frame = spark.createDataFrame(data, "vec_id bigint, embedding array<float>, node int")
    want = slow(data)
    for blocks, side in ((4, 16384), (4, 40), (1, 60), (5, 90)):
        got = {r.vec_id: r for r in neardup.near_duplicates(frame, blocks=blocks, side=side).collect()}
        assert [(got[i].n_links, got[i].component_id) for i in range(len(data))] == want
        assert all(r.kept == (r.component_id == r.vec_id) for r in got.values())


def test_empty_and_odd_ids(spark):
    schema = "vec_id bigint, embedding array<double>"
    assert neardup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    odd = spark.createDataFrame([(None, [1.0, 2.0]), (4, [1.0, 2.0]), (4, [1.0, 2.01]), (None, None)], schema)
    got = sorted((r.vec_id or -1, r.n_links, r.component_id) for r in neardup.near_duplicates(odd).collect() if r.component_id)
    assert got == [(-1, 2, 4), (4, 2, 4), (4, 2, 4)]
