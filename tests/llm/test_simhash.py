import collections
import re

import numpy as np
import xxhash

from ledgermill.llm import simhash
from ledgermill.llm.common import connected_components


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(prints):
    parent = dict.fromkeys(prints)
    group = {i: i for i in prints}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    ids = sorted(parent)
    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def texts():
    rng = np.random.default_rng(5)
    words = ["alpha", "Beta", "gamma", "delta", "ÉTÉ", "x"]
    out = [None, "", " \t ", "one", "One two", "one\x0btwo three", "a b c " * 4000]
    for _ in range(40):
        base = " ".join(rng.choice(words, 60)).split(" ")
        out.append(" ".join(base))
        out.append(" ".join([*base, "more"]))
        out.append(" ".join(base))
    return out


def test_fingerprints_and_classes_match_brute_force(spark):
    rows = [(i, t, "src", len(t or "")) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string, component int")
    slow = {i: slow_print(t) for i, t, *_ in rows}
    want = slow_classes(slow)
    for direct in (1024, 2):
        got = simhash.near_duplicates(docs, direct=direct).collect()
        assert {r.doc_id: int(r.fingerprint, 16) for r in got} == slow
        assert {r.doc_id: r.component_id for r in got} == want


def test_crowded_bucket_takes_the_exact_path(spark):
    rng = np.random.default_rng(1)
    base = int(rng.integers(1 << 62))
    prints = {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 60, (80, 2))}
    prints |= {int(x) for x in rng.integers(1 << 62, size=50)}
    frame = spark.createDataFrame([(x,) for x in prints], "fp bigint")
    want = slow_classes({x: x for x in prints})
    found = {r.node: r.component for r in connected_components(simhash.links(frame, direct=3)).collect()}
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert groups({x: found.get(x, x) for x in prints}) == groups(want)


def test_degenerate_tables(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.near_duplicates(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (3, "a b c"), (5, None)], "doc_id bigint, text string")
    got = collections.Counter((r.doc_id, r.component_id) for r in simhash.near_duplicates(odd).collect())
    assert got == {(None, 3): 1, (3, 3): 2, (5, 5): 1}
    assert sorted(map(tuple, simhash.drop_near_duplicates(odd).collect())) == [(3, "a b c"), (5, None)]
    assert simhash.drop_near_duplicates(empty).count() == 0


def test_rows_that_share_an_id_are_judged_by_their_own_texts(spark):
    w, u, x = ("one two three four five six seven", "quite another text that nobody repeats", "a third one stands under no id at all")
    rows = [(1, w, "s"), (5, w, "s"), (5, u, "t"), (None, w, "n"), (None, x, "n"), (None, x, "m"), (7, x, "q"), (9, u, "r"), (9, u, "r"), (2, None, "e"), (2, "", "f"), (-4, "b b b b", None), (-4, "c c c c", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _key string")
    for direct in (simhash.DIRECT, 2):
        kept = simhash.drop_near_duplicates(docs.repartition(3), direct)
        assert kept.columns == docs.columns
        found = sorted(map(tuple, kept.collect()), key=repr)
        # Brute force: a row goes if a link chain leads to a row with a smaller (id, nulls last).
        prints = [slow_print(t) for _, t, _ in rows]
        classes = slow_classes(dict(enumerate(prints)))
        want = len(set(classes.values()))
        assert len(found) == want
        best = {}
        for k, c in classes.items():
            best.setdefault(c, []).append((rows[k][0] is None, rows[k][0] or 0))
        by_class = {slow_print(t): classes[k] for k, (_, t, _) in enumerate(rows)}
        for i, t, _ in found:
            assert (i is None, i or 0) == min(best[by_class[slow_print(t)]])
        assert (5, u, "t") in found and (5, w, "s") not in found and not [r for r in found if r[0] is None]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 140)}}
