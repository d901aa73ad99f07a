"""Product codes of vectors, their codebooks trained in integers with equal-average search.

Every pass over the vectors is one Spark job: a task looks up the nearest entry of all its
parts and sends, for each codebook entry, the sum and the number of its parts. The codebooks
(parts x entries x components, a model of fixed size) are all that the driver holds.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Parts of a vector, entries of a codebook, rounds of training, and steps to one unit of a component.
PARTS, ENTRIES, ROUNDS, UNIT = 8, 16, 6, 4096


def span_limit(width: int) -> int:
    """Largest integer component of parts of ``width`` with which no sum of squares overflows 64 bits.

    That is above 16 million for 8 components; larger values count as the limit.
    """
    return max(1, math.isqrt((1 << 61) // max(1, width * width)) // 2)


def whole_parts(flat: np.ndarray, parts: int, unit: int) -> np.ndarray:
    """(rows, parts, width) integers floor(unit x component), the last part filled up with zeros."""
    rows, dim = flat.shape
    width = -(-dim // parts)
    x = np.zeros((rows, parts * width), np.int64)
    limit = span_limit(width)
    x[:, :dim] = np.floor(np.clip(flat.astype(np.float64) * unit, -limit, limit))
    return x.reshape(rows, parts, width)


class EqualAverage:
    """Nearest entries of one codebook by equal-average search.

    Entries are sorted by the sum of their components. From the place of a part's own sum
    the search goes outward, the nearer sum first; since (gap of sums)^2 / width is never
    above the squared distance, it ends once that strictly exceeds the best distance found,
    so entries at an equal distance are all seen and the lowest index wins.
    """

    def __init__(self, entries: np.ndarray) -> None:
        self.width = entries.shape[1]
        self.order = np.argsort(entries.sum(1), kind="stable")
        self.entries = entries[self.order]
        self.sums = self.entries.sum(1)
        self.compared = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the entry, squared distance) for every row of ``x``."""
        far = np.iinfo(np.int64).max
        n, k = len(x), len(self.sums)
        own = x.sum(1)
        right = np.searchsorted(self.sums, own)
        left = right - 1
        best, found = np.full(n, far), np.full(n, k)
        live = np.arange(n)
        while len(live):
            lo, hi, mine = left[live], right[live], own[live]
            below = np.where(lo >= 0, mine - self.sums[np.maximum(lo, 0)], far)
            above = np.where(hi < k, self.sums[np.minimum(hi, k - 1)] - mine, far)
            down = below <= above
            gap = np.where(down, below, above)
            inside = gap < far
            gap[~inside] = 0
            # gap^2 / width > best, in whole numbers
            inside &= -(-(gap * gap) // self.width) <= best[live]
            live, down, lo, hi = live[inside], down[inside], lo[inside], hi[inside]
            at = np.where(down, lo, hi)
            left[live] -= down
            right[live] += ~down
            gaps = x[live] - self.entries[at]
            distance = (gaps * gaps).sum(1)
            self.compared += len(live)
            index = self.order[at]
            better = (distance < best[live]) | ((distance == best[live]) & (index < found[live]))
            best[live[better]], found[live[better]] = distance[better], index[better]
        return found, best


def _components(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.Array) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim)


def _sums(books: list[np.ndarray], dim: int, parts: int, unit: int):
    """For each part and entry: how many of the task's parts are nearest to it, and their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [EqualAverage(b) for b in books]
        count = [np.zeros(len(b), np.int64) for b in books]
        total = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            x = whole_parts(_components(batch.column(0), dim), parts, unit)
            for p, s in enumerate(search):
                entry, _ = s.nearest(x[:, p])
                count[p] += np.bincount(entry, minlength=len(count[p]))
                np.add.at(total[p], entry, x[:, p])
        cells = [(p, e, c, i, int(total[p][e, i])) for p in range(parts) for e, c in enumerate(count[p].tolist()) if c for i in range(total[p].shape[1])]
        columns = list(zip(*cells, strict=True)) if cells else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["part", "entry", "n", "i", "total"])

    return run


def _codes(books: list[np.ndarray], dim: int, parts: int, unit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [EqualAverage(b) for b in books]
        for batch in batches:
            x = whole_parts(_components(batch.column(2), dim), parts, unit)
            found = [s.nearest(x[:, p]) for p, s in enumerate(search)]
            entries = np.stack([e for e, _ in found], 1).astype(np.uint8) if batch.num_rows else np.zeros((0, parts), np.uint8)
            error = np.sum([d for _, d in found], axis=0, dtype=np.int64) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes().hex() for x in entries], pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def usable(vector: Column) -> Column:
    """Whether a vector is there, has components, and all of them are finite numbers."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~odd, F.lit(False))


def train(vectors: DataFrame, dim: int, first: np.ndarray, parts: int = PARTS, rounds: int = ROUNDS, unit: int = UNIT) -> list[np.ndarray]:
    """Codebooks, one (entries, width) array for each part, from the starting vectors ``first``."""
    start = whole_parts(first, parts, unit)
    books = [start[:, p].copy() for p in range(parts)]
    for _ in range(rounds):
        sums = vectors.select("v").mapInArrow(_sums(books, dim, parts, unit), "part int, entry int, n bigint, i int, total bigint")
        # At most parts x entries x width rows, whatever the number of vectors.
        for part, entry, i, n, total in sums.groupBy("part", "entry", "i").agg(F.sum("n"), F.sum("total")).toLocalIterator():
            books[part][entry, i] = total // n
    return books


def codebooks_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, unit: int = UNIT) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable vector.

    Codebooks start as the vectors of the ``entries`` smallest ids (at most 256; fewer rows give
    fewer entries; of rows with one id the smaller vector comes first; rows without an id come
    last), are replaced ``rounds`` times by the whole means of their parts, and then code all
    vectors. Repeated rows are rows of their own. Null, empty and non-finite vectors go; the
    first starting vector tells how many components there are, vectors of another length go
    too, and parts are filled up with zeros where it isn't a multiple of ``parts``. Components
    beyond span_limit() count as that. ``label_error`` is the sum of ``error`` over the rows
    with the same label, nulls together. Other columns are ignored; an empty table gives no rows.
    """
    spark = rows.sparkSession
    kept = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("v")).filter(usable(F.col("v")))
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()
    if not first:
        return spark.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    dim = len(first[0]["v"])
    same = [x["v"] for x in first if len(x["v"]) == dim]
    kept = kept.filter(F.size("v") == dim)
    if len(same) < len(first):
        same = [x["v"] for x in kept.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()]
    books = train(kept, dim, np.array(same), parts, rounds, unit)
    coded = materialize(kept.select("vec_id", "label", "v").mapInArrow(_codes(books, dim, parts, unit), "vec_id bigint, label bigint, code string, error bigint"))
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, unit: int = UNIT) -> str:
    """The same in SQL: one pair of common tables a round, over all distances."""

    def nearest(k: int) -> str:
        return f"""a{k} AS (
  SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT x.r, x.p, b.e, sum((x.c - b.c) * (x.c - b.c)) AS d FROM x JOIN b{k} b ON b.p = x.p AND b.i = x.i GROUP BY x.r, x.p, b.e
  ) GROUP BY r, p
)"""

    def means(k: int) -> str:
        return f"""m{k} AS (
  SELECT x.p, a.e, x.i, CAST((sum(x.c) - ((sum(x.c) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS c
  FROM x JOIN a{k} a ON a.r = x.r AND a.p = x.p GROUP BY x.p, a.e, x.i
), b{k + 1} AS (
  SELECT b.p, b.e, b.i, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m ON m.p = b.p AND m.e = b.e AND m.i = b.i
)"""

    steps = ",\n".join(f"{nearest(k)},\n{means(k)}" for k in range(rounds))
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r, vec_id, label, embedding AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0
), w AS (SELECT len(v) // {parts} AS w FROM kept WHERE r = 0
), x AS (
  SELECT r, (j - 1) // w AS p, (j - 1) % w AS i, CAST(floor(CAST(v[j] AS DOUBLE) * {unit}) AS BIGINT) AS c
  FROM (SELECT r, v, w, unnest(range(1, len(v) + 1)) AS j FROM kept, w)
), b0 AS (SELECT p, r AS e, i, c FROM x WHERE r < {entries}
),
{steps},
{nearest(rounds)}, h AS (
  SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM b{rounds}
), y AS (
  SELECT k.vec_id, k.label, g.code, g.error
  FROM (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r) g JOIN kept k USING (r)
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM y, h
"""


ORACLE = oracle()
