import hashlib

import numpy as np

from ledgermill.llm import suffixdup as sd


def brute(texts, length=sd.LENGTH):
    seen, out = set(), []
    for text in texts:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            else:
                seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = np.random.default_rng(11)
    words = np.array(["ab", "été", "cide", "fgh", "io", "zz", "lorem", "q"])
    fresh = lambda n: " ".join(rng.choice(words, n))
    passage, texts = fresh(60), [None, "", "x" * 99, "y" * 100, "z" * 101, "ha " * 400, "\0" * 300]
    for i in range(60):
        body = fresh(int(rng.integers(5, 120)))
        if i % 3 == 0:
            body += " " + passage + " " + fresh(20)
        texts.append(body)
        if i % 5 == 0:
            texts.append(body)
        if i % 7 == 0 and len(body) > 40:
            k = int(rng.integers(20, len(body)))
            texts.append(body[:k] + "#" + body[k:])
    return texts


def test_equals_brute_force_with_and_without_crowded_classes(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, content string, lo int")
    want = brute(texts)
    for crowd, size in ((sd.CROWD, sd.BIN), (2, 4)):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.substring_report(docs, crowd, size).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_merged_transform_equals_sorting_all_suffixes(monkeypatch):
    rng = np.random.default_rng(2)
    bodies = [bytes(rng.integers(97, 99, int(rng.integers(100, 169))).astype(np.uint8)) for _ in range(30)]
    bodies += [bodies[0][3:] + b"abc", bodies[4]]
    windows = np.array([len(b) - sd.LENGTH + 1 for b in bodies])
    seen, want = set(), []
    for b, n in zip(bodies, windows, strict=True):
        for i in range(n):
            want.append(b[i : i + sd.LENGTH] in seen)
            seen.add(b[i : i + sd.LENGTH])
    for shard in (2048, 5, 1):
        monkeypatch.setattr(sd, "SHARD", shard)
        assert sd.repeated(bodies, windows).tolist() == want


def test_long_texts_are_cut_without_loss(monkeypatch):
    rng = np.random.default_rng(4)
    raw = rng.integers(97, 101, 3000).astype(np.uint8)
    _, _, lo, n = sd.anchors(raw)
    assert int(n.sum()) == 3000 - sd.LENGTH + 1 and lo[0] == 0


def test_removal_keeps_rows_and_columns(spark):
    long = "the quick brown fox " * 20
    rows = [(1, long + "tail one", "en", 408, 7), (2, "head " + long, "en", 405, 8), (None, long, "fr", 400, 9), (4, None, None, None, 1), (4, None, None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n_chars bigint, _key int")
    out = sd.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == 5
    kept = {r.doc_id: r for r in out.collect()}
    assert kept[4].text is None and kept[2].n_chars == len(kept[2].text) < 405 and kept[None].text == ""
    assert sd.substring_report(docs.limit(0)).count() == 0


def test_rows_without_an_id_or_with_a_shared_one_are_documents_of_their_own(spark):
    texts = corpus()
    passage = "a passage at the same offset of two rows, " * 4
    texts += [passage + "one", passage + "two", "clean text that repeats nothing " + "".join(map(chr, range(200, 500)))]
    ids = [(None, 7, None, 3, i)[i % 5] for i in range(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id bigint, text string")
    rows = docs.selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()
    rows.sort(key=lambda r: (r.doc_id is None, r.doc_id or 0, r.h))
    want = sorted(((str(r.doc_id), *x) for r, x in zip(rows, brute([r.text for r in rows]), strict=True)))
    for crowd, size in ((sd.CROWD, sd.BIN), (2, 4)):
        got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.substring_report(docs, crowd, size).collect())
        assert got == want
    kept = sd.remove_repeats(docs.withColumn("n_chars", docs.doc_id)).collect()
    assert len(kept) == len(texts) and any(r.text == texts[-1] for r in kept)
