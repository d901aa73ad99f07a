import bisect
import math
from collections import Counter
from fractions import Fraction
from itertools import islice

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgermill.llm import mixing, queries


def in_order(blocks, weights):
    """Names, blocks and whole weights of the sources in the order in which they run dry."""
    names = sorted(blocks)
    k = dict(zip(names, mixing.whole([weights[s] for s in names]), strict=True))
    names.sort(key=lambda s: (Fraction(blocks[s], k[s]), s))
    return names, [blocks[s] for s in names], [k[s] for s in names]


def flow(blocks, weights):
    """Slot at which the ideal flow has taken j blocks of source i, for all j, by walking from one source's end to the next."""
    ends, left, taken, t = [[Fraction(0)] for _ in blocks], set(range(len(blocks))), [Fraction(0)] * len(blocks), Fraction(0)
    while left:
        total = sum(weights[i] for i in left)
        step = min((blocks[i] - taken[i]) * total / weights[i] for i in left)
        for i in left:
            rate = Fraction(weights[i], total)
            while len(ends[i]) <= taken[i] + step * rate:
                ends[i].append(t + (len(ends[i]) - taken[i]) / rate)
            taken[i] += step * rate
        t += step
        left = {i for i in left if taken[i] < blocks[i]}
    return ends


def slow_order(blocks, weights):
    """Slot by slot: of the blocks that the flow has entered, the one that it leaves first; each source stays within a block of the flow."""
    ends, done, out = flow(blocks, weights), [0] * len(blocks), []
    for t in range(sum(blocks)):
        ready = [(math.ceil(ends[i][done[i] + 1]), i) for i in range(len(blocks)) if done[i] < blocks[i] and math.floor(ends[i][done[i]]) <= t]
        due, i = min(ready)
        assert due > t
        out.append(i)
        done[i] += 1
        for x, e in enumerate(ends):
            assert done[x] == 0 or e[done[x] - 1] < t + 1
            assert done[x] == blocks[x] or e[done[x] + 1] > t + 1
    return out


def test_order_is_the_slow_one():
    rng = np.random.default_rng(2)
    cases = [({"a": 500, "b": 70, "c": 1}, {"a": 0.2, "b": 0.5, "c": 0.3}), ({"a": 9}, {"a": 3.0}), ({"a": 40, "b": 40, "c": 40}, {"a": 1.0, "b": 1.0, "c": 1.0})]
    cases += [({f"s{i}": int(rng.integers(1, 60)) for i in range(n)}, {f"s{i}": float(rng.random() ** 4 + 1e-6) for i in range(n)}) for n in (2, 7, 30)]
    cases += [({f"s{i:02}": 1 + i % 2 for i in range(50)}, {f"s{i:02}": 1e300 if i == 7 else 1e-300 for i in range(50)})]
    for blocks, weights in cases:
        names, n, k = in_order(blocks, weights)
        got = list(mixing.edf(n, k))
        assert Counter(names[i] for i in got) == blocks
        assert got == slow_order(n, k)


def frame(spark, n=600):
    rng = np.random.default_rng(1)
    rows = [(i, "x" * int(rng.integers(0, 400)), "hot" if rng.random() < 0.4 else f"s{rng.integers(5)}", 1) for i in range(n)]
    rows += [(None, None, None, 1), (None, None, None, 1), (5, "y" * 9000, "s1", 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, slot int"), rows


def slow_slots(blocks, weights):
    names, n, k = in_order(blocks, weights)
    done, out = Counter(), {}
    for t, i in enumerate(slow_order(n, k)):
        out[t] = (names[i], done[i])
        done[i] += 1
    return out


def test_schedule_is_whole_and_follows_the_targets(spark):
    docs, rows = frame(spark)
    for weights, power in ((None, 1.0), (None, 0.0), ({"s0": 0.5, "hot": 0.1}, 1.0)):
        got = mixing.schedule(docs, weights, block=256, bucket=20, power=power).collect()
        assert len(got) == len(rows)
        streams = {}
        for r in got:
            streams.setdefault(r.mix_source, []).append(r)
        slots = {}
        for s, x in streams.items():
            at = 0
            for r in sorted(x, key=lambda r: r.mix_start):
                assert r.mix_start == at and r.mix_block == at // 256
                at += r.mix_bytes
                assert slots.setdefault(r.mix_slot, (s, r.mix_block)) == (s, r.mix_block)
        total = {s: sum(r.mix_bytes for r in x) for s, x in streams.items()}
        want = slow_slots({s: -(-b // 256) for s, b in total.items()}, {s: (weights or {}).get(s, (b / sum(total.values())) ** power) for s, b in total.items()})
        assert all(want[t] == x for t, x in slots.items())


def test_sources_of_the_query_run_dry_one_after_the_other(spark):
    """With equal targets each source has the same number of blocks, less than one apart, until the smallest runs dry."""
    got = queries.op10_mixing(spark, "/root/testdata/sf0.1").collect()
    last, size = {}, {}
    for r in got:
        last[r.source] = max(last.get(r.source, 0), r.slot)
        size[r.source] = max(size.get(r.source, 0), r.block + 1)
    least, n = min(size.values()), len(size)
    for r in got:
        if r.block < least:
            assert r.block - 1 < (r.slot + 1) / n and r.block + 1 > r.slot / n
    assert len(set(size.values())) > 3 and size[max(last, key=last.get)] >= max(size.values()) - 2


def test_rows_without_an_id_are_placed_by_their_text(spark):
    rows = [(None, f"text {i}", "a") for i in range(300)]
    got = mixing.schedule(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), block=64, bucket=10).collect()
    again = mixing.schedule(spark.createDataFrame(rows[::-1], "doc_id bigint, text string, source string"), block=64, bucket=10).collect()
    assert {r.text: r.mix_start for r in got} == {r.text: r.mix_start for r in again} and len({r.mix_start for r in got}) == 300


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a", "x", 0.5, 3), (2, "b", "y", 0.25, 4)], "doc_id bigint, text string, source string, mix_ratio double, mix_slot int")
    got = mixing.schedule(docs)
    assert got.columns == [*docs.columns, *(f"mix__{x}" for x in ("source", "bytes", "start", "block", "slot"))]
    assert sorted(map(tuple, mixing.mixed(docs).collect())) == sorted(map(tuple, docs.collect()))


def test_mixed_keeps_columns_and_rows(spark):
    docs, rows = frame(spark, 50)
    out = mixing.mixed(docs, partitions=3)
    assert out.columns == docs.columns
    assert Counter(map(tuple, out.collect())) == Counter(rows)
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_sources_stay_within_one_block_of_their_true_weights_over_many_periods():
    rng = np.random.default_rng(4)
    weights = {f"s{i}": float(w) for i, w in enumerate(rng.random(20) ** 3 + 1e-5)} | {"rare": 2e-4}
    total, n = sum(weights.values()), 60_000
    names, blocks, k = in_order(dict.fromkeys(weights, n), weights)
    got = np.fromiter(islice(mixing.edf(blocks, k), n), int, n)
    for i, s in enumerate(names):
        assert np.abs(np.cumsum(got == i) - np.arange(1, n + 1) * weights[s] / total).max() < 1


def test_schedule_without_broadcast_is_the_same(spark, monkeypatch):
    docs, _ = frame(spark, 200)
    key = lambda r: tuple(map(str, r))
    small = sorted(mixing.schedule(docs, block=256).collect(), key=key)
    monkeypatch.setattr(mixing, "BROADCAST", 0)
    assert sorted(mixing.schedule(docs, block=256).collect(), key=key) == small


def test_many_sources(spark):
    """20,000 sources of one to three blocks and a hot one: every slot once, none a block or more from the flow."""
    n, size = 20_000, 64
    rows = spark.range(3 * n).selectExpr("id as doc_id", f"repeat('x', {size}) as text", f"case when id < {n} or id % 7 = 0 then concat('s', id % {n}) else 'hot' end as source")
    rows = rows.withColumn("text", F.concat("text", F.col("doc_id").cast("string")).substr(-size, size))
    got = mixing.schedule(rows, block=size, power=0.5).select("mix_source", "mix_block", "mix_slot").toPandas()
    assert sorted(got.mix_slot) == list(range(3 * n))
    blocks = got.groupby("mix_source").size()
    weights = {s: (b / (3 * n)) ** 0.5 for s, b in blocks.items()}
    names, count, k = in_order(blocks.to_dict(), weights)
    dry = [Fraction(b, w) for b, w in zip(count, k, strict=True)]
    gone, left = np.cumsum([0, *count]), [sum(k)]
    for w in k:
        left.append(left[-1] - w)
    place = {s: i for i, s in enumerate(names)}

    def leaves(i, j):
        at = bisect.bisect_left(dry, Fraction(j, k[i]))
        return int(gone[at]) + Fraction(j * left[at], k[i])

    for s, j, t in got.itertuples(index=False):
        assert math.floor(leaves(place[s], j)) <= t < math.ceil(leaves(place[s], j + 1))


def test_blocks_grow_once_the_schedule_is_long(spark, monkeypatch):
    docs, rows = frame(spark, 300)
    monkeypatch.setattr(mixing, "SLOTS", 50)
    got = mixing.schedule(docs, block=16).collect()
    size = -(-sum(r.mix_bytes for r in got) // 50)
    assert len(got) == len(rows) and all(r.mix_block == r.mix_start // size for r in got)
    assert max(r.mix_slot for r in got) < 50 + len({r.mix_source for r in got})


def test_weights_that_are_not_above_zero(spark):
    docs, _ = frame(spark, 20)
    for bad in (0.0, -1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            mixing.schedule(docs, {"hot": bad})
