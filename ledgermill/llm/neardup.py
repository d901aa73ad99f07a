"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine c or more are at squared distance 2 - 2c or less. After a rotation
the coordinates are split into blocks; in at least one block the squared distance is within
a share of that budget proportional to the block's size. Each block is joined by range on
its leading coordinate: a vector goes to its own cell, a radius wide, and to the next. The
union of what passes a block's budget is verified exactly, in double precision; a link is
counted in the first block that finds it. Tasks compare two bounded sets of vectors and
send on counts and a spanning forest of links, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, forest, materialize, release

COSINE, BLOCKS = 0.9, 4
#: Vectors of one side of a task; rows of one comparison in it.
SIDE, STRIP = 16384, 128
#: Added to budgets; links are sought at half of it, so that rounding loses none.
SLACK = 1e-6
#: Added where block distances are computed in single precision, to choose pairs for the exact check.
ROUGH = 1e-5


def usable(column: str) -> F.Column:
    """Vectors that take part: not null, all components finite, not all zero."""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def rotation(dim: int, seed: int = 17) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def block_edges(dim: int, blocks: int) -> list[tuple[int, int]]:
    cuts = np.linspace(0, dim, min(blocks, dim) + 1).astype(int)
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def _radius(a: int, b: int, dim: int, cosine: float) -> float:
    return math.sqrt((2 - 2 * cosine) * (b - a) / dim + SLACK)


_ROTATIONS: dict[int, np.ndarray] = {}


def rotation_of(dim: int) -> np.ndarray:
    if dim not in _ROTATIONS:
        _ROTATIONS[dim] = rotation(dim)
    return _ROTATIONS[dim]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=-1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=-1, keepdims=True))


def _leads(blocks: int, cosine: float):
    """The cell of each block's leading coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for v in batch.column(1).to_pylist():
                y = unit(np.asarray(v, float)) @ rotation_of(len(v))
                cells.append([math.floor(y[a] / _radius(a, b, len(v), cosine)) for a, b in block_edges(len(v), blocks)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], ["node", "v", "copies", "cells"])

    return run


def compare(x: np.ndarray, y: np.ndarray, block: int, blocks: int, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked rows of ``x`` and ``y`` (unit vectors) that ``block`` is the first to find."""
    dim = x.shape[1]
    turn, edges = rotation_of(dim), block_edges(dim, blocks)
    a, b = edges[block]
    px, py = ((z @ turn[:, a:b]).astype(np.float32) for z in (x, y))
    nx, ny = (px * px).sum(1), (py * py).sum(1)
    budget = np.float32(_radius(a, b, dim, cosine) ** 2 + ROUGH)
    py *= -2
    left, right = [np.zeros(0, int)], [np.zeros(0, int)]
    for k in range(0, len(x), STRIP):
        gap = px[k : k + STRIP] @ py.T
        gap += ny[None, :]
        i, j = np.nonzero(gap <= (budget - nx[k : k + STRIP])[:, None])
        i += k
        if same:
            i, j = i[i < j], j[i < j]
        for s in range(0, len(i), 1 << 15):
            u, v = i[s : s + (1 << 15)], j[s : s + (1 << 15)]
            near = (x[u] * y[v]).sum(1) >= cosine
            u, v = u[near], v[near]
            # Without BLAS, so that a pair's distances don't depend on the task that has it.
            moved = np.einsum("ij,jk->ik", x[u] - y[v], turn, optimize=False) ** 2
            within = np.stack([moved[:, p:q].sum(1) <= _radius(p, q, dim, cosine) ** 2 - SLACK / 2 for p, q in edges], 1)
            first = within.argmax(1) == block
            left.append(u[first])
            right.append(v[first])
    return np.concatenate(left), np.concatenate(right)


OUT = "a bigint, b bigint, n bigint"


def _task(blocks: int, cosine: float):
    """Links of one pair of sets: a spanning forest (n null) and the links of each node (b null)."""

    def run(table: pa.Table) -> pa.Table:
        block, i, j = (table.column(c)[0].as_py() for c in ("block", "i", "j"))
        second = table.column("second").to_numpy()
        node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        width = len(table.column("v")[0])
        x = unit(table.column("v").combine_chunks().flatten().to_numpy().astype(float).reshape(-1, width))
        one, two = np.flatnonzero(~second), np.flatnonzero(second)
        if i == j:
            two = one
        if not len(one) or not len(two):
            return pa.table({c: pa.array([], pa.int64()) for c in "abn"})
        u, v = compare(x[one], x[two], block, blocks, cosine, i == j)
        u, v = one[u], two[v]
        count = (np.bincount(u, weights=copies[v], minlength=len(node)) + np.bincount(v, weights=copies[u], minlength=len(node))).astype(np.int64)
        hit = np.flatnonzero(count)
        a, b = forest(node[u], node[v])
        return pa.table(
            {
                "a": pa.concat_arrays([pa.array(a, pa.int64()), pa.array(node[hit], pa.int64())]),
                "b": pa.concat_arrays([pa.array(b, pa.int64()), pa.nulls(len(hit), pa.int64())]),
                "n": pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(count[hit])]),
            }
        )

    return run


PLACE = "array<struct<at:int,i:int,j:int,second:boolean>>"


def _places(cell: str, part: str, parts: str, last: str, following: str) -> F.Column:
    """The comparisons that a vector takes part in, as (cell, i, j, is it on the j side).

    Parts of a cell meet as (i, j) with i <= j; parts of the cell before meet a cell's own as
    (-1 - i, j).
    """
    c, p = F.col(cell), F.col(part)

    def each(n: F.Column, keep, make) -> F.Column:
        span = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(F.filter(span, keep), make).cast(PLACE)

    def place(at, i, j, second) -> F.Column:
        return F.struct(at.alias("at"), i.alias("i"), j.alias("j"), second.alias("second"))

    return F.concat(
        each(F.col(parts), lambda k: k <= p, lambda k: place(c, k, p, k < p)),
        each(F.col(parts), lambda k: k > p, lambda k: place(c, p, k, F.lit(False))),
        each(F.coalesce(following, F.lit(0)), lambda k: F.lit(True), lambda k: place(c + 1, -1 - p, k, F.lit(False))),
        each(F.coalesce(last, F.lit(0)), lambda k: F.lit(True), lambda k: place(c, -1 - k, p, F.lit(True))),
    )


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, blocks: int = BLOCKS, side: int = SIDE) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each input row.

    Vectors link at cosine ``cosine`` or more in double precision, whatever their labels, and
    only with vectors of their own length. Null, zero or non-finite vectors link with
    nothing: n_links 0, component_id their own id. Equal vectors are one node with a number
    of copies and link with each other. Rows without an id count as links and are kept with
    a null component unless linked; rows that share an id are vectors of their own. Other
    columns are ignored; an empty table gives no rows.
    """
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("v")).withColumn("ok", usable("v"))
    zero = F.lit(0).cast(kind)
    rows = rows.withColumn("v", F.when(F.col("ok"), F.transform("v", lambda x: F.when(x == zero, zero).otherwise(x)))).withColumn("h", F.xxhash64("v"))
    distinct = rows.filter("ok").groupBy("h", "v").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    distinct = materialize(distinct.withColumn("node", F.monotonically_increasing_id()))
    cells = distinct.select("node", "v", "copies").mapInArrow(_leads(blocks, cosine), f"node bigint, v array<{kind}>, copies bigint, cells array<int>")
    cells = materialize(cells.select("node", "copies", "v", F.size("v").alias("dim"), F.posexplode("cells").alias("block", "cell")))
    # At most 2 / radius + 2 cells for each block and vector length: a table of bounded size.
    sizes = cells.groupBy("dim", "block", "cell").agg(F.ceil(F.count(F.lit(1)) / side).cast("int").alias("parts"))
    near = Window.partitionBy("dim", "block").orderBy("cell").rangeBetween
    sizes = sizes.select("dim", "block", "cell", "parts", F.max("parts").over(near(-1, -1)).alias("last"), F.max("parts").over(near(1, 1)).alias("following"))
    own = cells.join(F.broadcast(sizes), ["dim", "block", "cell"]).withColumn("part", F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts")).cast("int"))
    dealt = own.select("dim", "block", "node", "copies", "v", F.explode(_places("cell", "part", "parts", "last", "following")).alias("t"))
    dealt = dealt.select("dim", "block", "t.at", "t.i", "t.j", "t.second", "node", "copies", "v")
    found = materialize(dealt.groupBy("dim", "block", "at", "i", "j").applyInArrow(_task(blocks, cosine), OUT))
    release(vectors.sparkSession)
    counts = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    groups = connected_components(found.filter("b is not null").select("a", "b"))
    named = distinct.join(counts, "node", "left").join(groups, "node", "left").select("h", "v", "first_id", "copies", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    classes = named.join(least, "component").select(F.col("h").alias("g"), F.col("v").alias("w"), (F.col("n") + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = rows.join(classes, (F.col("h") == F.col("g")) & (F.col("v") == F.col("w")) & F.col("ok"), "left")
    component = F.coalesce("component_id", "vec_id")
    return linked.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
