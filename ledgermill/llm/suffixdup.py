"""Repeated-substring removal by merging Burrows-Wheeler transforms of shards.

A string of LENGTH bytes that occurs twice selects the same minimizer (the leftmost
smallest hashed GRAM) in both places. Every window therefore belongs to one class, its
minimizer's hash, and equal windows never lie in different classes. That splits the one
global transform into independent parts exactly:

1. every anchor (a selected minimizer) owns a run of windows; the bytes they cover are its
   content. Anchors whose class occurs once are retired.
2. equal contents are one string with a multiplicity; all but the first are removed whole.
3. classes with several contents go to bins. In a bin, each shard's contents get a
   Burrows-Wheeler transform over SYMBOL-byte symbols; the transforms are merged by
   iterative interleave refinement, whose splits give the common-prefix lengths; intervals
   with a common prefix of LENGTH bytes are the repeats.
4. classes with more than CROWD contents are resolved exactly by grouping their windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, release, texts_of

LENGTH = 100
GRAM = 32
SPAN = LENGTH - GRAM + 1
SYMBOL = 20
#: Contents of a class beyond which its windows are grouped exactly instead of binned.
CROWD = 4096
#: Mean contents of a bin, and most contents of a shard in it.
BIN, SHARD = 8192, 2048
#: Texts are cut here, overlapping by LENGTH - 1 bytes, while anchors are sought.
CUT = 1 << 22
_MUL = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 24) - 1)
_LAST = (1 << 63) - 1
#: Places of the grams that cover a content, and the odd factors that join their hashes.
_STEPS = np.arange(0, SPAN + LENGTH - 1, GRAM)
_WEIGHTS = np.cumprod(np.full(len(_STEPS), 0x94D049BB133111EB, np.uint64))


def _rolling(raw: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of every ``width``-byte substring, by doubling."""
    done, h, power, wide = 0, None, _MUL, raw.astype(np.uint64) + np.uint64(1)
    n, k = len(raw) - width + 1, 1
    while k <= width:
        if width & k:
            part = wide[done : done + n]
            h = part if h is None else h * power + part
            done += k
        if 2 * k <= width:
            wide = wide[:-k] * power + wide[k:]
        power = np.uint64(int(power) ** 2 % 2**64)
        k *= 2
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _content_hash(h: np.ndarray, lo: np.ndarray, size: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Hash of each content, its length and its anchor's place, from hashes of grams that cover it."""
    grams = h.take(np.minimum(lo[:, None] + _STEPS, (lo + size - GRAM)[:, None]))
    mixed = (size * 128 + off).astype(np.uint64) * _MUL + grams @ _WEIGHTS
    return mixed ^ (mixed >> np.uint64(31))


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(class, content hash, first window, windows) of each run of windows with one minimizer."""
    h = _rolling(raw, GRAM)
    key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    rows = np.full(-(-len(key) // SPAN) * SPAN, np.uint64(2**64 - 1))
    rows[: len(key)] = key
    rows = rows.reshape(-1, SPAN)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(raw) - LENGTH + 1
    at = (np.minimum(after[:n], before[SPAN - 1 : SPAN - 1 + n]) & _PLACE).astype(np.int64)
    edge = np.ones(n + 1, bool)
    edge[1:n] = at[1:] != at[:-1]
    bounds = np.flatnonzero(edge)
    lo, windows = bounds[:-1], bounds[1:] - bounds[:-1]
    at = at[lo]
    return h[at], _content_hash(h, lo, windows + LENGTH - 1, at - lo), lo, windows


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["class", "content", "doc_id", "lo", "windows"]
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for first in range(0, len(ids), 512):
            docs, bases, found = [], [], []
            for doc, text in zip(ids[first : first + 512], texts_of(batch.column(1).slice(first, 512)), strict=True):
                for base in range(0, max(1, len(text) - LENGTH + 1), CUT):
                    piece = text[base : base + CUT + LENGTH - 1]
                    if len(piece) >= LENGTH:
                        docs.append(doc)
                        bases.append(base)
                        found.append(anchors(np.frombuffer(piece, np.uint8)))
            if found:
                cls, content, lo, windows = (np.concatenate(x) for x in zip(*found, strict=True))
                n = [len(x[0]) for x in found]
                columns = (cls.view(np.int64), content.view(np.int64), np.repeat(np.array(docs, np.int64), n), (lo + np.repeat(bases, n)).astype(np.int32), windows.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, cls, lo, windows, body = [], [], [], [], []
        for doc, text, wanted in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            for w in wanted:
                docs.append(doc)
                cls.append(w["class"])
                lo.append(w["lo"])
                windows.append(w["windows"])
                body.append(text[w["lo"] : w["lo"] + w["windows"] + LENGTH - 1])
        yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(docs, pa.int64()), pa.array(lo, pa.int32()), pa.array(windows, pa.int32()), pa.array(body, pa.binary())], ["class", "doc_id", "lo", "windows", "body"])


def _order(key: np.ndarray, most: int) -> np.ndarray:
    """Stable order of keys between 0 and ``most``: key and place are sorted as one number where both fit."""
    bits = len(key).bit_length()
    if most >> (63 - bits):
        return np.argsort(key, kind="stable")
    return np.sort((key.astype(np.int64) << bits) | np.arange(len(key))) & ((1 << bits) - 1)


def _ranks(key: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Dense ranks of keys that stand together in ``order``."""
    sorted_key = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]]))
    return rank


def _names(h: np.ndarray) -> np.ndarray:
    """Dense numbers of 64-bit hashes; the full sort is for hashes that differ in their low bits only."""
    low = np.uint64((1 << len(h).bit_length()) - 1)
    packed = np.sort((h & ~low) | np.arange(len(h), dtype=np.uint64))
    order = (packed & low).astype(np.int64)
    same = (packed[1:] & ~low) == (packed[:-1] & ~low)
    if (same & (h[order[1:]] != h[order[:-1]])).any():
        order = np.argsort(h)
    return _ranks(h, order)


def shard_transform(symbol: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Suffix array, transform, its LF mapping, and how many suffixes are terminators.

    Each position is a suffix of a string of SYMBOL-byte symbols that ends at ``end``, where
    symbol 0 is the terminator; equal suffixes are ordered by position.
    """
    n = len(symbol)
    here = np.arange(n)
    sa = _order(symbol, int(symbol.max()))
    rank, step, longest = _ranks(symbol, sa), SYMBOL, int((end - begin).max()) + 1
    while step < longest:
        most = int(rank.max()) + 1
        key = rank * most + rank[np.minimum(here + step, end)]
        sa = _order(key, most * most)
        rank = _ranks(key, sa)
        step *= 2
    before = sa - SYMBOL
    has = before >= begin[sa]
    before = np.maximum(before, 0)
    row = np.empty(n, np.int32)
    row[sa] = here
    return sa, np.where(has, symbol[before], -1).astype(np.int32), np.where(has, row[before], -1).astype(np.int32), int((symbol == 0).sum())


def merge_transforms(parts: list[tuple[np.ndarray, np.ndarray, int]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave shard transforms (bwt, lf, terminators) until ``depth`` symbols are compared.

    Returns the interleave (row numbers of the concatenated shards, in merged order) and the
    common-prefix length of each row with the row before it, -1 where it is ``depth`` or more.
    """
    base = np.cumsum([0] + [len(p[0]) for p in parts]).astype(np.int32)
    bwt = np.concatenate([p[0] for p in parts])
    lf = np.concatenate([p[1] + b for p, b in zip(parts, base, strict=False)])
    stop = np.concatenate([np.arange(p[2], dtype=np.int32) + b for p, b in zip(parts, base, strict=False)])
    most = int(bwt.max(initial=0))
    order, block = np.arange(len(bwt), dtype=np.int32), np.zeros(len(bwt), np.int32)
    prefix = np.full(len(bwt), -1, np.int8)
    prefix[:1] = 0
    for level in range(depth):
        c = bwt.take(order)
        has = np.flatnonzero(c >= 0)
        c = c.take(has)
        perm = _order(c, most)
        c, has = c.take(perm), has.take(perm)
        own = block.take(has)
        order = np.concatenate([stop, lf.take(order.take(has))])
        edge = np.zeros(len(bwt), bool)
        edge[len(stop) : len(stop) + 1] = True
        edge[len(stop) + 1 :] = (c[1:] != c[:-1]) | (own[1:] != own[:-1])
        fresh = edge & (prefix < 0)
        prefix[fresh] = level
        block = np.cumsum(edge, dtype=np.int32)
        if level and not fresh.any():
            break
    return order, prefix


def repeated(bodies: list[bytes], windows: np.ndarray) -> np.ndarray:
    """For every window of every content, in order: does an equal one stand before it?"""
    size = np.array([len(x) for x in bodies]) + 1
    base = np.concatenate([[0], np.cumsum(size)])
    flat = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8)
    begin, end = np.repeat(base[:-1], size), np.repeat(base[1:] - 1, size)
    here = np.arange(len(flat))
    symbol = np.zeros(len(flat), np.int64)
    whole = np.flatnonzero(here + SYMBOL <= end)
    symbol[whole] = _names(_rolling(flat, SYMBOL)[whole]) + 1
    parts, rows = [], []
    for k in range(0, len(bodies), SHARD):
        a, b = base[k], base[min(k + SHARD, len(bodies))]
        sa, bwt, lf, ends = shard_transform(symbol[a:b], begin[a:b] - a, end[a:b] - a)
        parts.append((bwt, lf, ends))
        rows.append(sa + a)
    order, prefix = merge_transforms(parts, LENGTH // SYMBOL)
    place = np.concatenate(rows).take(order)
    interval = np.cumsum(prefix >= 0, dtype=np.int32)
    counts = np.flatnonzero((here < begin + np.repeat(windows, size)).take(place))
    place, interval = place.take(counts), interval.take(counts)
    edge = np.concatenate([[True], interval[1:] != interval[:-1]])[: len(place)]
    heads = np.flatnonzero(edge)
    mark = np.zeros(len(flat), bool)
    if len(heads):
        mark[place] = np.minimum.reduceat(place, heads)[np.cumsum(edge) - 1] < place
    starts = np.repeat(base[:-1], windows) + (np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows))
    return mark[starts]


def _merge_bin(table: pa.Table) -> pa.Table:
    table = table.sort_by([("doc_id", "ascending"), ("lo", "ascending")])
    docs, lo, windows = (np.asarray(table.column(c)) for c in ("doc_id", "lo", "windows"))
    found = repeated(table.column("body").to_pylist(), windows)
    start = np.repeat(lo, windows) + (np.arange(len(found)) - np.repeat(np.cumsum(windows) - windows, windows))
    owner = np.repeat(np.arange(len(lo)), windows)
    at = np.flatnonzero(found)
    if not len(at):
        return pa.table({"doc_id": pa.array([], pa.int64()), "lo": pa.array([], pa.int32()), "hi": pa.array([], pa.int32())})
    new = np.concatenate([[True], (np.diff(at) > 1) | (owner[at[1:]] != owner[at[:-1]])])
    last = np.append(np.flatnonzero(new)[1:], len(at)) - 1
    return pa.table({"doc_id": pa.array(docs[owner[at[new]]], pa.int64()), "lo": pa.array(start[at[new]].astype(np.int32)), "hi": pa.array((start[at[last]] + LENGTH).astype(np.int32))})


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            key, low, docs, at = [], [], [], []
            part = batch.slice(first, 256)
            for doc, lo, windows, body in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True):
                for k in range(windows):
                    h = xxhash.xxh3_128_digest(body[k : k + LENGTH])
                    key.append(h[:8])
                    low.append(h[8:])
                    docs.append(doc)
                    at.append(lo + k)
            both = [pa.array(np.frombuffer(b"".join(x), np.int64)) for x in (key, low)]
            yield pa.RecordBatch.from_arrays([*both, pa.array(docs, pa.int64()), pa.array(at, pa.int32())], ["k1", "k2", "doc_id", "lo"])


def repeats(docs: DataFrame, crowd: int = CROWD, bin_size: int = BIN) -> DataFrame:
    """(doc_id, lo, hi): byte ranges that hold every repeated byte; ranges may overlap.

    ``docs`` has doc_id (unique, not null) and text. Order is by doc_id, then start.
    """
    spark = docs.sparkSession
    seen = materialize(docs.mapInArrow(_scan, "class bigint, content bigint, doc_id bigint, lo int, windows int"))
    classes = materialize(seen.groupBy("class").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("class"))
    release(spark)
    shared = materialize(seen.join(classes, "class"))
    release(spark)
    discard(seen)
    discard(classes)
    firsts = materialize(
        shared.groupBy("class", "content").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "lo", "windows")).alias("f")).select("class", "content", "n", "f.*")
    )
    release(spark)
    again = firsts.filter("n > 1").select("class", "content", F.col("doc_id").alias("d"), F.col("lo").alias("l"))
    whole = shared.join(again, ["class", "content"]).filter("doc_id <> d or lo <> l").select("doc_id", "lo", (F.col("lo") + F.col("windows") + (LENGTH - 1)).alias("hi"))
    whole = materialize(whole)
    release(spark)
    discard(shared)
    mixed = firsts.groupBy("class").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1")
    wanted = firsts.join(mixed, "class").groupBy("doc_id").agg(F.collect_list(F.struct("class", "lo", "windows")).alias("wanted"))
    bodies = docs.join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(_contents, "class bigint, doc_id bigint, lo int, windows int, body binary")
    bodies = materialize(bodies)
    sized = materialize(firsts.groupBy("class").agg(F.count(F.lit(1)).alias("contents")).filter(F.col("contents") > crowd).select("class"))
    release(spark)
    discard(firsts)
    bins = max(1, bodies.count() // bin_size)
    calm = bodies.join(sized, "class", "left_anti").withColumn("bin", F.pmod(F.xxhash64("class"), F.lit(bins)))
    found = calm.select("bin", "doc_id", "lo", "windows", "body").groupBy("bin").applyInArrow(_merge_bin, "doc_id bigint, lo int, hi int")
    each = bodies.join(sized, "class", "left_semi").select("doc_id", "lo", "windows", "body").mapInArrow(_windows, "k1 bigint, k2 bigint, doc_id bigint, lo int")
    least = each.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "lo")).alias("f")).filter("n > 1")
    rest = each.join(least, ["k1", "k2"]).filter(F.struct("doc_id", "lo") > F.col("f")).select("doc_id", "lo", (F.col("lo") + LENGTH).alias("hi"))
    spans = materialize(whole.unionByName(found).unionByName(rest))
    release(spark)
    discard(bodies)
    discard(whole)
    return spans


def _edges(spans: pa.Array, size: np.ndarray) -> list[list[int]]:
    """For each row the starts and ends, in turn, of the disjoint runs that its ranges cover."""
    flat, n = spans.flatten(), pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(n)), n)
    base = np.concatenate([[0], np.cumsum(size + 1)])
    lo, hi = (np.asarray(flat.field(c)).astype(np.int64) for c in ("lo", "hi"))
    hi = np.minimum(hi, size[row])
    some = np.flatnonzero(lo < hi)
    lo, hi = lo[some] + base[row[some]], hi[some] + base[row[some]]
    order = np.argsort(lo)
    lo, top = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo) + 1, bool)
    new[1:-1] = lo[1:] > top[:-1]
    if not len(lo):
        return [[] for _ in n]
    bounds = np.flatnonzero(new)
    start, end = lo[bounds[:-1]], top[bounds[1:] - 1]
    own = np.searchsorted(base, start, side="right") - 1
    both = np.stack([start - base[own], end - base[own]], axis=1).ravel().tolist()
    cuts = (2 * np.searchsorted(own, np.arange(len(n) + 1))).tolist()
    return [both[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _keep(text: bytes, edges: list[int]) -> bytes:
    if not edges:
        return text
    return b"".join(text[a:b] for a, b in zip([0, *edges[1::2]], [*edges[::2], len(text)], strict=True))


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = texts_of(batch.column(1))
        size = np.array([len(x) for x in texts], np.int64)
        edges = _edges(batch.column(2), size)
        kept = [_keep(t, e) for t, e in zip(texts, edges, strict=True)]
        columns = [pa.array(size), pa.array(size - [len(x) for x in kept], pa.int64()), pa.array([len(e) // 2 for e in edges], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


@F.arrow_udf(returnType=T.StringType())
def _kept_text(text: pa.Array, spans: pa.Array) -> pa.Array:
    texts = texts_of(text)
    edges = _edges(spans, np.array([len(x) for x in texts], np.int64))
    return pa.array([_keep(t, e).decode("utf-8", "ignore") for t, e in zip(texts, edges, strict=True)], pa.string())


def _numbered(docs: DataFrame, key: str) -> DataFrame:
    """A copy of the documents, numbered by doc_id, nulls last, then by hashes of the text.

    Copies of a row are told apart by their place in the input, so that they are spread too.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    order = [F.col("doc_id").cast("bigint").asc_nulls_last(), F.xxhash64(text), F.xxhash64(text, F.lit(1)), F.col(key)]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.withColumn(key, F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order)
    copy = materialize(rows.withColumn(key, F.monotonically_increasing_id()))
    release(spark)
    return copy


def _marked(docs: DataFrame, crowd: int, bin_size: int) -> tuple[DataFrame, str, str]:
    """The documents with a key of their own and the list of their repeated ranges."""
    key, spans = "_key", "_spans"
    while {key, spans} & set(docs.columns):
        key, spans = key + "_", spans + "_"
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)))
    if not keyed.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        keyed = _numbered(docs, key)
    found = repeats(keyed.select(F.col(key).alias("doc_id"), F.col("text").cast("string").alias("text")), crowd, bin_size)
    lists = found.groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(F.struct("lo", "hi")).alias(spans))
    return keyed.join(lists, key, "left"), key, spans


def substring_report(docs: DataFrame, crowd: int = CROWD, bin_size: int = BIN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every input row.

    A byte goes if a LENGTH-byte string that also starts earlier covers it. Null text is
    empty. Rows without an id come last in the order; they and rows that share an id are
    documents of their own, ordered by a hash of the text. Other columns are ignored; an
    empty table gives no rows.
    """
    marked, _, spans = _marked(docs.select("doc_id", "text"), crowd, bin_size)
    return marked.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), spans).mapInArrow(
        _report, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    )


def remove_repeats(docs: DataFrame, crowd: int = CROWD, bin_size: int = BIN) -> DataFrame:
    """The documents with repeated bytes cut out of their texts, all rows and columns kept.

    A code point that a cut leaves incomplete is dropped; ``n_chars``, where there is one, is
    counted anew. A text without repeats, null included, stays as it is.
    """
    marked, _, spans = _marked(docs, crowd, bin_size)
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(_kept_text(F.col("text").cast("string"), F.col(spans)))
    out = marked.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(docs.columns)
