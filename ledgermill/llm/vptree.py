"""Nearest neighbours by vantage-point trees, one for each shard of the candidates.

A tree splits its vectors at the median distance from a vantage point. A search leaves out
the far side when the query is further from the split than ``factor`` times its current
k-th distance; by the triangle inequality factor one (or more) loses nothing, and a smaller
factor trades recall for work. Every query starts from the k-th distance in a pilot sample,
so that no shard begins without a bound; the factor shortens that distance, which does not
shrink during the search, so a query among many close vectors is not cut off from them. The
factor is tuned on the pilot: the smallest that keeps the recall. Every row is indexed;
shards' results are merged by rank.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .neardup import usable

NEIGHBOURS = 10
#: Factors that tuning tries, in order; recall that it asks for; queries and levels that it tries them with.
FACTORS, RECALL, TRIED, LEVELS = (0.15, 0.17, 0.2, 0.3, 0.5), 0.95, 128, 6
#: Candidates of a shard at most and, while there are fewer shards than cores, at least; queries of a block; vectors of a leaf.
SHARD, SMALL_SHARD, QUERY_BLOCK, LEAF = 65_536, 8192, 2048, 128
#: Vectors that give each query its first bound, at most: those with the smallest hashes.
PILOT = 2048


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of every row of ``q`` (rows) from every row of ``x`` (columns)."""
    out = np.empty((len(q), len(x)))
    step = max(1, (1 << 21) // max(1, x.size))
    for k in range(0, len(q), step):
        gap = q[k : k + step, None, :] - x[None, :, :]
        out[k : k + step] = np.sqrt((gap * gap).sum(2))
    return out


def build(x: np.ndarray, leaf: int = LEAF, seed: int = 1) -> dict[str, np.ndarray]:
    """A tree over the rows of ``x``: their order, and per node vantage row, split, range, children."""
    rng = np.random.default_rng(seed)
    order, nodes = np.arange(len(x)), []
    todo = [(0, len(x), -1, 0)]
    while todo:
        lo, hi, parent, side = todo.pop()
        me = len(nodes)
        nodes.append([-1, 0.0, lo, hi, -1, -1])
        if parent >= 0:
            nodes[parent][4 + side] = me
        if hi - lo <= leaf:
            continue
        pick = lo + int(rng.integers(hi - lo))
        order[[lo, pick]] = order[[pick, lo]]
        rest = order[lo + 1 : hi]
        d = distances(x[rest], x[order[lo]][None, :])[0]
        sort = np.argsort(d, kind="stable")
        order[lo + 1 : hi] = rest[sort]
        half = lo + 1 + len(rest) // 2
        nodes[me][0], nodes[me][1] = order[lo], float(d[sort[len(rest) // 2]])
        todo += [(lo + 1, half, me, 0), (half, hi, me, 1)]
    table = np.array(nodes, float).reshape(-1, 6)
    return {"order": order, "vantage": table[:, 0].astype(int), "split": table[:, 1], "range": table[:, 2:4].astype(int), "child": table[:, 4:].astype(int)}


class _Best:
    """The k best (distance, id) of each query so far."""

    def __init__(self, n: int, k: int, own: np.ndarray) -> None:
        self.d, self.id, self.own = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max), own

    def offer(self, q: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
        d = np.where(ids[None, :] == self.own[q][:, None], np.inf, d)
        # Most queries gain nothing from most leaves.
        gains = (d <= self.d[q, -1:]).any(1) & np.isfinite(d).any(1)
        q, d = q[gains], d[gains]
        if not len(q):
            return
        k = self.d.shape[1]
        alld = np.concatenate([self.d[q], d], 1)
        alli = np.concatenate([self.id[q], np.broadcast_to(ids, d.shape)], 1)
        alli = np.where(np.isinf(alld), np.iinfo(np.int64).max, alli)
        best = np.lexsort((alli, alld), axis=1)[:, :k]
        self.d[q], self.id[q] = np.take_along_axis(alld, best, 1), np.take_along_axis(alli, best, 1)


def search(tree: dict[str, np.ndarray], x: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, factor: float, bound: np.ndarray | None = None) -> _Best:
    """k nearest rows of ``x`` for each query, its own id left out; queries go down together.

    ``bound`` is a distance within which each query has k candidates anywhere; without one
    the search is exact.
    """
    best = _Best(len(queries), k, own)
    bound = np.full(len(queries), np.inf) if bound is None else bound
    todo = [(0, np.arange(len(queries)), None)] if len(x) else []
    while todo:
        node, q, gap = todo.pop()
        if gap is not None:
            go = gap <= np.minimum(best.d[q, -1], factor * bound[q])
            q = q[go]
        if not len(q):
            continue
        lo, hi = tree["range"][node]
        if tree["vantage"][node] < 0:
            rows = tree["order"][lo:hi]
            best.offer(q, ids[rows], distances(x[rows], queries[q]))
            continue
        row = tree["vantage"][node]
        d = distances(x[row][None, :], queries[q])
        best.offer(q, ids[[row]], d)
        gap = d[:, 0] - tree["split"][node]
        inside = gap < 0
        inner, outer = tree["child"][node]
        # Last in, first out: each query's near side comes before its far side is judged.
        todo += [(inner, q[~inside], gap[~inside]), (outer, q[inside], -gap[inside]), (inner, q[inside], None), (outer, q[~inside], None)]
    return best


def kth(near: np.ndarray, k: int) -> np.ndarray:
    """The k-th smallest of each row, infinite if there are fewer; a little more, as sums may be rounded otherwise in another shape."""
    if near.shape[1] < k:
        return np.full(len(near), np.inf)
    return np.partition(near, k - 1, axis=1)[:, k - 1] * (1 + 1e-9)


def tuned(x: np.ndarray, k: int = NEIGHBOURS) -> float:
    """The smallest of FACTORS with which a search of the sample ``x`` keeps RECALL; one if none does.

    Bounds come from an eighth of the sample, and the tree has as many levels as a large shard's.
    """
    queries = x[:TRIED]
    own, ids = np.arange(len(queries)), np.arange(len(x))
    d = distances(x, queries)
    d[own, own] = np.inf
    eighth = max(k + 1, len(x) // 8)
    if len(x) <= 4 * k:
        return 1.0
    bound, tree = kth(d[:, -eighth:], k), build(x, max(2, len(x) >> LEVELS))
    true = np.sort(d, axis=1)[:, k - 1]
    for factor in FACTORS:
        found = search(tree, x, ids, queries, own, k, factor, bound)
        if (found.d <= true[:, None] * (1 + 1e-9)).mean() >= RECALL:
            return factor
    return 1.0


def _pack(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _matrix(table: pa.Table) -> np.ndarray:
    width = len(table.column("v")[0]) if table.num_rows else 0
    return table.column("v").combine_chunks().flatten().to_numpy().astype(float).reshape(table.num_rows, width)


def _index(table: pa.Table) -> pa.Table:
    table = table.sort_by([("vec_id", "ascending")])
    x, ids = _matrix(table), table.column("vec_id").to_numpy()
    packed = _pack(build(x) | {"x": x.astype(np.float32) if (x.astype(np.float32) == x).all() else x, "ids": ids})
    return pa.table({"dim": table.column("dim")[:1], "shard": table.column("shard")[:1], "tree": pa.array([packed], pa.binary())})


def _search(k: int, factor: float):
    def run(queries: pa.Table, trees: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if queries.num_rows:
            own, q, bound = queries.column("vec_id").to_numpy(), _matrix(queries), queries.column("bound").to_numpy()
            for packed in trees.column("tree").to_pylist():
                with np.load(io.BytesIO(packed)) as z:
                    tree = {c: z[c] for c in z.files}
                best = search(tree, tree["x"].astype(float), tree["ids"], q, own, k, factor, bound)
                hit = np.isfinite(best.d)
                for to, col in zip(out, (np.broadcast_to(own[:, None], hit.shape)[hit], best.id[hit], best.d[hit]), strict=True):
                    to.append(col)
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table({c: pa.array(np.concatenate(x) if x else [], t) for c, x, t in zip(("query_id", "vec_id", "score"), out, kinds, strict=True)})

    return run


def _by_length(pilot: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors and ids of the pilot by the vectors' length."""
    parts = {d: pilot.filter(pa.compute.equal(pilot.column("dim"), d)) for d in sorted(set(pilot.column("dim").to_pylist()))}
    return {d: (_matrix(t), t.column("vec_id").to_numpy()) for d, t in parts.items()}


def _bounds(samples: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """Adds to queries the k-th distance among the pilot vectors of other ids, infinite if they are fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, v, d in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "v", "dim")), strict=True):
                x, ids = samples.get(d, (np.zeros((0, d)), np.zeros(0)))
                out.append(float(kth(np.where(ids != i, distances(x, np.array([v], float)), np.inf), k)[0]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, "bound"])

    return run


def nearest(vectors: DataFrame, is_query: F.Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEIGHBOURS, factor: float | None = None, shard: int | None = None, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest candidates found, by distance, then id.

    Every row is a candidate but those of the query's own id; queries are the rows for which
    ``is_query`` (on ``vec_id``) holds. Without a ``factor`` it is tuned on the pilot. Null, zero and non-finite vectors and rows without an
    id take no part; vectors only meet those of their own length. A query that is repeated is
    answered once, by its vector with the smallest hash. Other columns are ignored; an empty
    table gives no rows.
    """
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("v")).filter(usable("v") & F.col("vec_id").isNotNull())
    rows = rows.withColumn("dim", F.size("v"))
    first = F.min(F.struct(F.xxhash64("v").alias("h"), "v", "dim")).alias("f")
    wanted = rows.filter(is_query).groupBy("vec_id").agg(first).select("vec_id", "f.v", "f.dim")
    pilot = rows.orderBy(F.xxhash64("vec_id", F.lit(4)), F.xxhash64("v")).limit(PILOT).select("vec_id", "v", "dim").toArrow()
    samples = _by_length(pilot)
    if factor is None:
        factor = max((tuned(x, k) for x, _ in samples.values()), default=1.0)
    wanted = wanted.mapInArrow(_bounds(samples, k), f"vec_id bigint, v array<{kind}>, dim int, bound double")
    size, asked = rows.count(), rows.filter(is_query).count()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    shards = -(-size // shard) if shard else max(-(-size // SHARD), min(cores, -(-size // SMALL_SHARD)))
    shards, blocks = max(1, shards), max(1, -(-asked // query_block))
    part = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    trees = materialize(rows.withColumn("shard", part(shards, 5)).groupBy("dim", "shard").applyInArrow(_index, "dim int, shard int, tree binary"), "snappy")
    left = wanted.withColumn("block", part(blocks, 6)).select("*", every(shards).alias("shard")).groupBy("dim", "shard", "block")
    right = trees.select("*", every(blocks).alias("block")).groupBy("dim", "shard", "block")
    found = left.cogroup(right).applyInArrow(_search(k, factor), "query_id bigint, vec_id bigint, score double")
    ranked = found.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
