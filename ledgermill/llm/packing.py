"""Best-fit packing of token sequences by a grouping genetic algorithm.

Documents are tokenised, closed by id 0 and cut into pieces of at most CAPACITY tokens. The
pieces are dealt evenly to groups of bounded size. Islands evolve packings of each group
from their own seeds; after every epoch an island's elite moves to the next island of its
group; the best packing of a group wins. A group wastes at most a part of its last bin.
Where the rows have an order to follow, groups are contiguous ranges of it instead, and
sequences are numbered along it.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, release, texts_of

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
#: Pieces of a group on average, islands of a group, epochs, and an island's population and crossovers in an epoch.
GROUP, ISLANDS, EPOCHS, POPULATION, CROSSOVERS = 8192, 2, 2, 6, 40
#: Words whose ids a Python worker remembers, at most, in each of two generations.
REMEMBERED = 120_000
# How this tokenizer splits a normalised word; letters that normalising leaves as they are.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
LATIN = regex.compile("[!-~\u00a1-\u012f\u0131-\u017f]+")
#: Byte-level tokenizers write a byte as a letter: itself if printable, else the next one from 256 up.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(_PLAIN))}
#: Places of an order that are summed up in one task.
PLACES = 4096
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, deal bigint"


class _Remembered:
    """Ids by word in two generations: when the young one is full it becomes the old one."""

    def __init__(self, size: int = REMEMBERED) -> None:
        self.size, self.young, self.old = size, {}, {}

    def put(self, word, ids: bytes) -> bytes:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[word] = ids
        return ids


_MODELS: dict[str, tuple] = {}


def word_ids(path: str) -> Callable[[bytes], bytes]:
    """ids of a text as packed little-endian 32-bit words.

    ASCII white space always ends a token of this tokenizer, so words are encoded apart and
    remembered, for as long as the Python worker lives. Printable words of Latin letters are
    already in the tokenizer's normal form once lower-cased, so their pieces go straight to
    its merge model; all others take its whole way.
    """
    if path not in _MODELS:
        from tokenizers import Tokenizer

        _MODELS[path] = (Tokenizer.from_file(path), _Remembered(), _Remembered())
    tokenizer, words, parts = _MODELS[path]
    merge, whole = tokenizer.model.tokenize, tokenizer.encode

    def piece(text: str) -> bytes:
        ids = parts.young.get(text) or parts.old.get(text)
        if ids is None:
            bytes_as_letters = text if text.isascii() else text.encode().decode("latin-1").translate(BYTE_LETTERS)
            ids = array("I", [x.id for x in merge(bytes_as_letters)]).tobytes()
            if len(text) <= 48:
                parts.put(text, ids)
        return ids

    def fresh(word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if "<|" in text or not (text.isascii() and text.isprintable() or LATIN.fullmatch(text)):
            ids = array("I", whole(text, add_special_tokens=False).ids).tobytes()
        else:
            text = text.lower()
            ids = piece(text) if text.isalpha() else b"".join([piece(p) for p in PIECE.findall(text)])
        return words.put(word, ids) if len(word) <= 48 else ids

    def encode(text: bytes) -> bytes:
        young, old, out = words.young, words.old, []
        for word in text.split():
            ids = young.get(word)
            if ids is None:
                ids = old.get(word)
                if ids is None:
                    ids = fresh(word)
                    young, old = words.young, words.old
            out.append(ids)
        return b"".join(out)

    return encode


def _pieces(path: str | None, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encode = word_ids(path or public_tokenizers.path(TOKENIZER))
        width = 4 * capacity
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            rows: list[int] = []
            for row, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True)):
                ids = encode(text) + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    crc = zlib.crc32(part)
                    deal = zlib.crc32(f"{doc} {k} {row}".encode()) << 31 | crc >> 1
                    for to, x in zip(out, (doc, k, at // 4, len(part) // 4, crc, deal), strict=True):
                        to.append(x)
                    rows.append(row)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            places = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[2:]]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, k) for x, k in zip(out, kinds, strict=True)), *places], ["doc_id", "piece", "start", "length", "ids_crc32", "deal", *batch.schema.names[2:]])

    return run


def pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, order: tuple[str, str] | None = None) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, a number to deal by, and with an order ord1, ord2."""
    along = [F.col(c).cast("bigint").alias(f"ord{k}") for k, c in enumerate(order or (), 1)]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *along)
    return rows.mapInArrow(_pieces(tokenizer_path, capacity), PIECES + "".join(f", ord{k} bigint" for k in range(1, len(along) + 1)))


def _ranked(cut: DataFrame) -> DataFrame:
    """The pieces with their rank (from 0) by ord1, ord2, piece to deal by; only counts go through one task."""
    chunk = F.floor(F.col("ord1") / F.lit(PLACES)).alias("chunk")
    counts = cut.groupBy("ord1").agg(F.count(F.lit(1)).alias("n")).withColumn("chunk", chunk)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy("chunk").agg(F.sum("n").alias("n"))
    sums = sums.select("chunk", F.coalesce(F.sum("n").over(before(Window.partitionBy(F.lit(0)).orderBy("chunk"))), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("n").over(before(Window.partitionBy("chunk").orderBy("ord1"))), F.lit(0))
    bases = counts.withColumn("within", within).join(sums, "chunk").select("ord1", (F.col("base") + F.col("within")).alias("base"))
    inside = Window.partitionBy("ord1").orderBy("ord2", "doc_id", "piece", "ids_crc32", "length")
    return cut.join(bases, "ord1").withColumn("deal", F.col("base") + F.row_number().over(inside) - 1).drop("ord1", "ord2", "base")


class _Room:
    """Bins by free room; the tightest that fits is found with one bit operation."""

    def __init__(self) -> None:
        self.mask, self.bins = 0, {}

    def add(self, room: int, name: int) -> None:
        if room:
            self.bins.setdefault(room, []).append(name)
            self.mask |= 1 << room

    def take(self, need: int) -> tuple[int, int] | None:
        m = self.mask >> need
        if not m:
            return None
        room = need + (m & -m).bit_length() - 1
        names = self.bins[room]
        name = names.pop()
        if not names:
            del self.bins[room]
            self.mask &= ~(1 << room)
        return room, name


def best_fit(assign: np.ndarray, length: np.ndarray, items: np.ndarray, capacity: int) -> np.ndarray:
    """Place ``items`` (in that order) beside what ``assign`` holds; others of it at -1 stay out."""
    held = assign >= 0
    names, assign = np.full(len(assign), -1), assign.copy()
    if held.any():
        _, names[held] = np.unique(assign[held], return_inverse=True)
        assign = names
    fill = np.bincount(assign[held], weights=length[held]).astype(int).tolist() if held.any() else []
    room = _Room()
    for name, used in enumerate(fill):
        room.add(capacity - used, name)
    fresh, sizes = len(fill), length[items].tolist()
    for item, need in zip(items.tolist(), sizes, strict=True):
        found = room.take(need)
        if found is None:
            assign[item] = fresh
            room.add(capacity - need, fresh)
            fresh += 1
        else:
            assign[item] = found[1]
            room.add(found[0] - need, found[1])
    return assign


def worth(assign: np.ndarray, length: np.ndarray, capacity: int) -> tuple[int, float]:
    """Bins (fewer is better), then mean squared fill, negated: smaller is fitter."""
    fill = np.bincount(assign, weights=length) / capacity
    return len(fill), -float((fill**2).mean())


def crossover(a: np.ndarray, b: np.ndarray, length: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Whole well-filled bins of ``b`` go into ``a``; bins of ``a`` that hold their items are
    broken up, and what that displaces is placed again by best fit, largest first."""
    fill = np.bincount(b, weights=length)
    good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    pick = np.zeros(len(fill), bool)
    pick[rng.choice(good, max(1, len(good) // 4), replace=False)] = True
    moved = pick[b]
    broken = np.zeros(int(a.max()) + 1, bool)
    broken[a[moved]] = True
    fa = np.bincount(a, weights=length)
    broken |= (fa <= np.partition(fa, min(3, len(fa) - 1))[min(3, len(fa) - 1)])
    child = np.where(moved, b + len(broken), np.where(broken[a], -1, a))
    loose = np.flatnonzero(child < 0)
    return best_fit(child, length, loose[np.argsort(-length[loose], kind="stable")], capacity)


def evolve(length: np.ndarray, seeds: list[np.ndarray], capacity: int, population: int, crossovers: int, rng: np.random.Generator) -> np.ndarray:
    """The elite of a population that starts from ``seeds`` and best-fit packings of shuffled orders.

    Ends early once the bins are as few as the total length allows.
    """
    least = -(-int(length.sum()) // capacity)
    pool = list(seeds)
    while len(pool) < population:
        noise = length + (rng.normal(0, 0.02 * capacity * len(pool), len(length)) if pool else 0)
        pool.append(best_fit(np.full(len(length), -1), length, np.argsort(-noise, kind="stable"), capacity))
        if worth(pool[-1], length, capacity)[0] <= least:
            return pool[-1]
    score = [worth(p, length, capacity) for p in pool]
    for _ in range(crossovers):
        if min(score)[0] <= least:
            break
        i, j = rng.choice(len(pool), 2, replace=False)
        child = crossover(pool[i], pool[j], length, capacity, rng)
        got = worth(child, length, capacity)
        worst = max(range(len(pool)), key=score.__getitem__)
        if got < score[worst]:
            pool[worst], score[worst] = child, got
    return pool[min(range(len(pool)), key=score.__getitem__)]


ELITE = "island int, grp bigint, bins int, fit double, assign array<int>"


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("deal", "ascending"), ("ids_crc32", "ascending")])


def _island(capacity: int, population: int, crossovers: int, epoch: int):
    def run(items: pa.Table, elites: pa.Table) -> pa.Table:
        group, island = items.column("grp")[0].as_py(), items.column("island")[0].as_py()
        length = np.asarray(_sorted(items).column("length"))
        seeds = [np.array(x, np.int64) for x in elites.column("assign").to_pylist()]
        best = evolve(length, seeds, capacity, population, crossovers, np.random.default_rng([group, island, epoch]))
        bins, fit = worth(best, length, capacity)
        return pa.table({"island": pa.array([island], pa.int32()), "grp": pa.array([group], pa.int64()), "bins": pa.array([bins], pa.int32()), "fit": pa.array([fit]), "assign": pa.array([best.astype(np.int32)], pa.list_(pa.int32()))})

    return run


def _along(name: np.ndarray, deal: np.ndarray) -> np.ndarray:
    """Bins renumbered along the order: a bin stands where its longest piece, its first, does."""
    _, first, bins = np.unique(name, return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(deal[first])] = np.arange(len(first))
    return rank[bins]


def _place(ordered: bool):
    def run(items: pa.Table, elites: pa.Table) -> pa.Table:
        items = _sorted(items)
        best = min(elites.to_pylist(), key=lambda e: (e["bins"], e["fit"], e["island"]))
        name, length = np.array(best["assign"], np.int64), np.asarray(items.column("length"))
        if ordered:
            name = _along(name, np.asarray(items.column("deal")))
        order = np.argsort(name, kind="stable")
        before = np.cumsum(length[order]) - length[order]
        first = np.concatenate([[True], name[order][1:] != name[order][:-1]])
        offset = np.empty(len(name), np.int64)
        offset[order] = before - before[first][np.cumsum(first) - 1]
        columns = {c: items.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
        return pa.table(columns | {"sequence_id": pa.array(best["grp"] * (1 << 32) + name), "offset": pa.array(offset)})

    return run


def pack(
    docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, group: int = GROUP, islands: int = ISLANDS, epochs: int = EPOCHS, population: int = POPULATION, crossovers: int = CROSSOVERS,
    order: tuple[str, str] | None = None,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece.

    Null and empty texts are the single token 0. Repeated rows are packed each; rows without
    an id keep their null. Other columns are ignored; an empty table gives no rows.
    ``order`` names two whole-number columns, not null, that order the documents: groups are
    then contiguous ranges of it, and within a group sequences follow their longest pieces.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, tokenizer_path, capacity, order))
    n = cut.count()
    groups = max(1, round(n / group))
    if order:
        loose, cut = cut, materialize(_ranked(cut))
        discard(loose)
        dealt = cut.withColumn("grp", F.expr(f"deal * {groups} div {max(1, n)}"))
    else:
        dealt = cut.withColumn("grp", F.pmod("deal", F.lit(groups)))
    spread = dealt.select("grp", "doc_id", "piece", "length", "deal", "ids_crc32", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    elites = spark.createDataFrame([], ELITE)
    for epoch in range(epochs):
        moved = elites.withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int"))
        visible = moved.unionByName(elites).select("grp", "island", "assign") if islands > 1 else elites.select("grp", "island", "assign")
        elites = materialize(spread.groupBy("grp", "island").cogroup(visible.groupBy("grp", "island")).applyInArrow(_island(capacity, population, crossovers, epoch), ELITE))
    release(spark)
    return dealt.groupBy("grp").cogroup(elites.groupBy("grp")).applyInArrow(
        _place(order is not None), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    )
