"""What the terms of a text add to a forest's margins: path-dependent Shapley values.

Along the path to a leaf every feature holds or doesn't, and what isn't known counts by the
share of rows that went that way. A leaf's value is shared among its path's features by a
polynomial in those shares; since a path has few features, the shares of every pattern of
held features are worked out once a leaf and looked up for each row.
"""

from __future__ import annotations

from collections.abc import Callable
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .boosting import TOGETHER, Forest, Tree, add_margins
from .vectorizer import Cells

#: Features with the largest absolute values that an explanation names.
TOP = 8


def leaf_paths(tree: Tree) -> list[tuple[float, dict[int, tuple[int, int, float]]]]:
    """For each leaf its value, and for each feature on its path the bins (lo, hi] that hold and the share of rows that hold."""
    found = []
    todo: list[tuple[int, dict[int, tuple[int, int, float]]]] = [(0, {})]
    while todo:
        node, path = todo.pop()
        f = tree.feature[node]
        if f < 0:
            found.append((tree.value[node], path))
            continue
        lo, hi, share = path.get(f, (-1, 1 << 30, 1.0))
        for child, low, high in ((tree.left[node], lo, min(hi, tree.cut[node])), (tree.right[node], max(lo, tree.cut[node]), hi)):
            todo.append((child, path | {f: (low, high, share * tree.cover[child] / max(1, tree.cover[node]))}))
    return found


def pattern_values(shares: list[float]) -> np.ndarray:
    """(patterns, features): each feature's part of a leaf's value, by the bits of the features that hold."""
    m = len(shares)
    weight = np.array([factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)])
    held = (np.arange(1 << m)[:, None] >> np.arange(m)) & 1
    out = np.zeros((1 << m, m))
    for j in range(m):
        # Coefficients by the number of known features among the others.
        poly = np.zeros((1 << m, m))
        poly[:, 0] = 1.0
        for i in (i for i in range(m) if i != j):
            poly = poly * shares[i] + np.concatenate([np.zeros((1 << m, 1)), poly[:, :-1]], axis=1) * held[:, i : i + 1]
        out[:, j] = (held[:, j] - shares[j]) * (poly @ weight)
    return out


def class_values(forest: Forest, k: int, bins: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Values of class ``k`` for rows of ``bins``, by column."""
    out = np.zeros(bins.shape)
    for trees in forest.rounds:
        for value, path in leaf_paths(trees[k]):
            if path:
                at = column[list(path)]
                lo, hi, share = (np.array(x) for x in zip(*path.values(), strict=True))
                mine = bins[:, at]
                pattern = ((mine > lo) & (mine <= hi)) @ (1 << np.arange(len(at)))
                out[:, at] += value * pattern_values(share.tolist())[pattern]
    return out


def explainer(forest: Forest) -> Callable[[Column, Column, Column], Column]:
    """Function from slots, bins and a class number to margin, base, and the terms' values.

    ``values`` lists (slot, phi, present) of all features that the class's trees ask for, whether the
    row has the term or not, where the value isn't zero; base plus all values is the margin.
    """
    kind = "struct<margin: double, base: double, values: array<struct<slot: int, phi: double, present: boolean>>>"

    @F.arrow_udf(returnType=kind)
    def run(slots: pa.Array, bins: pa.Array, number: pa.Array) -> pa.Array:
        base = forest.base()
        column, width = forest.used(forest.rounds)
        slot_of = np.zeros(width, np.int32)
        slot_of[column[column >= 0]] = np.flatnonzero(column >= 0)
        parts = []
        for k in range(0, max(1, len(slots)), TOGETHER):
            cells = Cells(slots.slice(k, TOGETHER), bins.slice(k, TOGETHER))
            which = number.slice(k, TOGETHER).to_numpy(zero_copy_only=False)
            margins = add_margins(np.tile(np.array(forest.start, float), (len(cells), 1)), cells, forest, forest.rounds)
            dense = cells.dense(column, width)
            phi = np.zeros(dense.shape)
            for c in np.unique(which):
                phi[which == c] = class_values(forest, int(c), dense[which == c], column)
            row, col = np.nonzero(phi)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(cells)))])
            each = pa.StructArray.from_arrays([pa.array(slot_of[col]), pa.array(phi[row, col]), pa.array(dense[row, col] > 0)], ["slot", "phi", "present"])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)
            parts.append(pa.StructArray.from_arrays([pa.array(margins[np.arange(len(cells)), which]), pa.array(base[which]), lists], ["margin", "base", "values"]))
        return pa.concat_arrays(parts)

    return run


def explained(rows: DataFrame, row_id: str) -> DataFrame:
    """row_id, margin, base, active, absent: the sums of what the row's own terms and the missing ones add.

    ``rows`` has a column ``told`` as explainer() gives it.
    """
    total = lambda held: F.aggregate(F.filter("told.values", lambda v: v["present"] == held), F.lit(0.0), lambda s, v: s + v["phi"])
    return rows.select(F.col(row_id).alias("row_id"), "told.margin", "told.base", total(F.lit(True)).alias("active"), total(F.lit(False)).alias("absent"))


def term_values(rows: DataFrame, row_id: str, terms: DataFrame, present: bool = True) -> DataFrame:
    """row_id, term, phi of the terms that a row has, or lacks; ``terms`` is (slot, term), a vocabulary of bounded size."""
    each = rows.select(F.col(row_id).alias("row_id"), F.explode("told.values").alias("v")).filter(F.col("v.present") == F.lit(present))
    return each.select("row_id", F.col("v.slot").alias("slot"), F.col("v.phi").alias("phi")).join(F.broadcast(terms), "slot").select("row_id", "term", "phi")


def top_values(phi: DataFrame, k: int = TOP) -> DataFrame:
    """The k terms of each row with the largest absolute values, largest first, ties by term."""
    order = Window.partitionBy("row_id").orderBy(F.desc(F.abs("phi")), "term")
    return phi.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
