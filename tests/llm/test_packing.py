import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from ledgermill.llm import packing


def check(spark, texts, **kw):
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id bigint, text string, length int")
    rows = packing.pack(docs, **kw).collect()
    capacity = kw.get("capacity", packing.CAPACITY)
    slow = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        ids = np.array([*slow.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted(by[i], key=lambda r: r.piece)
        assert [r.start for r in mine] == list(range(0, len(ids), capacity))
        assert [(r.length, r.ids_crc32) for r in mine] == [(len(p), zlib.crc32(p.tobytes())) for p in (ids[a : a + capacity] for a in range(0, len(ids), capacity))]
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(r.length for r in rows) // capacity)


def texts(n=150):
    rng = np.random.default_rng(8)
    words = ["The", "cat", "l'été", "a\x1cb", "12.5", "<|endoftext|>", "naïve", "　x", "don't"]
    return [None, "", " \n", "wort " * 9000, *(" ".join(rng.choice(words, int(rng.integers(1, 300)))) for _ in range(n))]


def test_pieces_and_sequences(spark):
    got, least = check(spark, texts())
    assert got <= least + 1


def test_groups_islands_and_small_capacity(spark):
    got, least = check(spark, texts(80), capacity=256, group=30, islands=3, epochs=2, crossovers=6)
    assert got <= 1.25 * least + 4


def test_evolution_beats_plain_best_fit():
    rng = np.random.default_rng(0)
    length = np.concatenate([rng.integers(300, 700, 240), rng.integers(340, 1025, 240)])
    plain = packing.best_fit(np.full(480, -1), length, np.argsort(-length, kind="stable"), 2048)
    best = packing.evolve(length, [], 2048, 4, 30, np.random.default_rng(1))
    assert packing.worth(best, length, 2048) <= packing.worth(plain, length, 2048)
    assert np.bincount(best, weights=length).max() <= 2048 and best.min() >= 0


def test_crossover_is_whole():
    rng = np.random.default_rng(3)
    length = rng.integers(1, 1500, 400)
    a, b = (packing.best_fit(np.full(400, -1), length, rng.permutation(400), 2048) for _ in range(2))
    for _ in range(10):
        a = packing.crossover(a, b, length, 2048, rng)
        assert (a >= 0).all() and np.bincount(a, weights=length).max() <= 2048


def test_degenerate_tables(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack(empty).count() == 0
    odd = spark.createDataFrame([(None, "a"), (None, "a"), (7, "b c"), (7, "b c")], "doc_id bigint, text string")
    assert packing.pack(odd).count() == 4


def test_groups_are_contiguous_ranges_of_an_order(spark):
    slot = [(i * 37) % 101 * 1000 for i in range(101)]
    docs = spark.createDataFrame([(i, "word " * (i * 7 + 1), s, i) for i, s in enumerate(slot)], "doc_id bigint, text string, slot bigint, at bigint")
    rows = packing.pack(docs, capacity=256, group=30, order=("slot", "at")).collect()
    assert sum(r.length for r in rows) == packing.pack(docs, capacity=256, group=30).agg({"length": "sum"}).first()[0]
    ranges = {}
    for r in rows:
        ranges.setdefault(r.sequence_id >> 32, []).append(slot[r.doc_id])
    parts = [ranges[g] for g in sorted(ranges)]
    assert len(parts) > 5 and all(max(a) <= min(b) for a, b in zip(parts, parts[1:]))
    assert max(map(len, parts)) <= min(map(len, parts)) + 1


def hard_lengths(n=2700, capacity=2048):
    """Lengths that fill n / 3 sequences exactly, three in each: largest first, best fit misses that by far."""
    rng = np.random.default_rng(n)
    a = rng.integers(capacity // 4, capacity // 2, n // 3)
    b = rng.integers(capacity // 4, np.minimum(capacity // 2, capacity - a - capacity // 5))
    return np.concatenate([a, b, capacity - a - b])


def test_crossover_gains_bins_where_best_fit_misses_the_bound():
    length = hard_lengths()
    plain = packing.best_fit(np.full(len(length), -1), length, np.argsort(-length, kind="stable"), 2048)
    best = packing.evolve(length, [], 2048, packing.POPULATION, packing.CROSSOVERS, np.random.default_rng(1))
    assert packing.worth(best, length, 2048)[0] <= packing.worth(plain, length, 2048)[0] - 4


def test_islands_and_migration_gain_bins_on_documents(spark):
    rows = [(i, "a " * (n - 1), "s") for i, n in enumerate(hard_lengths(120, 256).tolist())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    count = lambda **kw: packing.pack(docs, capacity=256, **kw).select("sequence_id").distinct().count()
    plain = count(islands=1, epochs=1, population=1, crossovers=0)
    alone = count(islands=1, epochs=1)
    assert count(islands=3, epochs=3) <= alone <= plain - 1


def test_an_elite_of_the_neighbour_island_is_taken_in():
    """An island without time of its own ends with the better packing that has moved in."""
    length = hard_lengths(120)
    good = packing.evolve(length, [], 2048, 8, 200, np.random.default_rng(5))
    got = packing.evolve(length, [good], 2048, 2, 0, np.random.default_rng(6))
    assert packing.worth(got, length, 2048) == packing.worth(good, length, 2048)
    assert packing.worth(packing.evolve(length, [], 2048, 2, 0, np.random.default_rng(6)), length, 2048) > packing.worth(good, length, 2048)
