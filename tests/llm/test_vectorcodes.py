"""Vector codes against plain loops over all entries, and odd tables."""

import hashlib
import math

import numpy as np
import pytest

from ledgermill.llm import vectorcodes


def plain(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label_error, sha) by comparing every part with every entry, in Python integers."""
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = -(-len(kept[0][1]) // parts)
    whole = [[math.floor(4096 * x) for x in r[1]] + [0] * (parts * width - len(r[1])) for r in kept]
    cut = [[w[p * width : (p + 1) * width] for p in range(parts)] for w in whole]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            named = [near(p, c[p])[1] for c in cut]
            for k in range(len(books[p])):
                mine = [c[p] for c, n in zip(cut, named, strict=True) if n == k]
                if mine:
                    books[p][k] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[near(p, c[p]) for p in range(parts)] for c in cut]
    error = [sum(d for d, _ in f) for f in found]
    label = {}
    for r, e in zip(kept, error, strict=True):
        label[r[2]] = label.get(r[2], 0) + e
    return [(r[0], "".join(f"{k:02x}" for _, k in f), e, label[r[2]], sha) for r, f, e in zip(kept, found, error, strict=True)]


def got(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    return [tuple(r) for r in vectorcodes.compress(df, **more).collect()]


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


def test_equal_average_finds_what_all_comparisons_find():
    rng = np.random.default_rng(3)
    for width, spread in ((1, 3), (2, 4), (5, 50), (8, 4096)):
        entries = rng.integers(-spread, spread + 1, (16, width))
        x = rng.integers(-spread, spread + 1, (400, width))
        all_of = ((x[:, None] - entries[None]) ** 2).sum(2)
        search = vectorcodes.EqualAverage(entries)
        index, distance = search.nearest(x)
        assert (index == all_of.argmin(1)).all() and (distance == all_of.min(1)).all()
        assert search.compared < 400 * 16  # the sums leave entries unseen


@pytest.mark.parametrize("dim", [8, 24, 20, 3])
def test_against_plain_loops(spark, dim):
    rng = np.random.default_rng(dim)
    rows = [(int(i), [float(np.float32(v)) for v in rng.normal(0, 0.3, dim)], int(i % 3) if i % 5 else None) for i in range(90)]
    rows += [(200, rows[4][1], 1), (201, rows[4][1], 1), (5, rows[5][1], rows[5][2])]
    assert sorted(got(spark, rows), key=key) == sorted(plain(rows), key=key)


def test_ties_take_the_lower_index(spark):
    rows = [(i, [float(np.float32(v))] * 8, 0) for i, v in enumerate([0, 0, 1, 1, 0.5, 0.5, -0.25] * 6)]
    assert sorted(got(spark, rows), key=key) == sorted(plain(rows), key=key)


def test_odd_rows_go_or_count_as_said(spark):
    fine = [(i, [0.1 * i, -0.2 * i, 0.3] * 8, None) for i in range(5)]
    fine = [(i, [float(np.float32(x)) for x in v], n) for i, v, n in fine]
    odd = [(10, None, 1), (11, [], 1), (12, [1.0, None] * 12, 1), (13, [float("nan")] * 24, 1), (14, [float("inf")] * 24, 1), (15, [1.0], 1)]
    rows = [*fine, *odd, (None, fine[2][1], None)]
    found = got(spark, rows)
    assert sorted(found, key=key) == sorted(plain(rows), key=key) and len(found) == 6
    huge = got(spark, [(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1), (3, [0.5] * 8, 2)])
    assert [r[2] for r in huge] == [0, 0, 0]
    assert got(spark, odd[:1]) == [] and got(spark, []) == []


def test_other_columns_and_many_tasks_change_nothing(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(0, 1, 16).astype(np.float32)], 7) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").selectExpr("*", "'x' as code", "1 as error", "2 as v", "3 as of", "4 as part")
    found = sorted(map(tuple, vectorcodes.compress(df.repartition(7)).collect()))
    assert found == sorted(got(spark, rows))
