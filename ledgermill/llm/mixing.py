"""Mixing sources to target weights by Pfair scheduling.

A source's stream of bytes is cut into blocks. In the ideal mixture all sources flow at once,
each at its weight's share of those that still have bytes, so a source that runs dry leaves its
share to the others. Block j may not start before the slot in which the ideal flow enters it
and must be scheduled by the slot in which the flow leaves it: with constant weights these are
the release floor(j / w) and the deadline ceil((j + 1) / w) of a periodic task. The ideal flow
fills every slot, so earliest-deadline-first meets every deadline, and at any slot each source
is less than one block from the ideal, from the first slot to the last.

The flow is known from running sums over the sources in the order in which they run dry, so
nothing is scheduled again when one does. Weights are whole numbers of about a 2^52th of
their sum; windows are computed from these without rounding. One task runs the schedule and
streams it out as rows (source, block, slot); it holds some 100 bytes for each source. Blocks grow
with the bytes once there would be more than SLOTS of them, so its work doesn't.
"""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_left
from collections.abc import Iterator, Mapping, Sequence
from itertools import accumulate, islice
from math import fsum

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Bytes of a block at least; blocks at most, not counting one for each source that it fills in part.
BLOCK, SLOTS = 1 << 16, 1 << 22
#: Documents of a (source, bucket) on average at most, within which sizes are summed up in one task.
BUCKET = 4096
#: Slots of the schedule that are held at once; blocks up to which the schedule is broadcast.
CHUNK, BROADCAST = 1 << 16, 1 << 17
#: What whole weights sum up to, about.
WHOLE = 1 << 52


def whole(weights: Sequence[float]) -> list[int]:
    """The weights as whole numbers, at least one, that sum up to about WHOLE."""
    top = max(weights)
    total = fsum(w / top for w in weights)
    return [max(1, round(w / top / total * WHOLE)) for w in weights]


def edf(blocks: Sequence[int], weights: Sequence[int]) -> Iterator[int]:
    """The index of the source of each slot, by earliest deadline among released blocks.

    Sources have at least one block and come in the order in which they run dry, that is by
    blocks / weight, which also decides between equal deadlines.
    """
    dry = array("d", (n / w for n, w in zip(blocks, weights, strict=True)))
    gone = array("q", accumulate(blocks, initial=0))
    left = array("q", accumulate(weights, lambda a, w: a - w, initial=sum(weights)))
    due, part, done = (array("q", bytes(8 * len(blocks))) for _ in range(3))

    def leave(i: int, j: int) -> None:
        """Set when the ideal flow has taken j blocks of source i: in whole slots, and whether a part of one is missing."""
        at = min(bisect_left(dry, j / weights[i]), len(dry) - 1)
        slots, rest = divmod(gone[at] * weights[i] + j * left[at], weights[i])
        due[i], part[i] = slots + (rest > 0), rest > 0

    def queue(i: int) -> int:
        leave(i, done[i] + 1)
        return due[i] << 32 | i

    waiting: list[int] = []
    ready = [queue(i) for i in range(len(blocks))]
    heapq.heapify(ready)
    for t in range(gone[-1]):
        while waiting and waiting[0] >> 32 <= t:
            heapq.heappush(ready, queue(heapq.heappop(waiting) & 0xFFFFFFFF))
        i = heapq.heappop(ready) & 0xFFFFFFFF
        yield i
        done[i] += 1
        if done[i] < blocks[i]:
            heapq.heappush(waiting, (due[i] - part[i]) << 32 | i)


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (source, blocks, weight) to rows (source, block, slot)."""
    sources = list(batches)
    if not sources:
        return
    table = pa.Table.from_batches(sources).rename_columns(["source", "blocks", "weight"]).sort_by("source")
    table = table.append_column("whole", pa.array(whole(table.column("weight").to_pylist()), pa.int64())).drop_columns("weight")
    dry = [n / w for n, w in zip(table.column("blocks").to_pylist(), table.column("whole").to_pylist(), strict=True)]
    table = table.append_column("dry", pa.array(dry)).sort_by([("dry", "ascending"), ("source", "ascending")]).combine_chunks()
    names = table.column("source").combine_chunks()
    order = edf(*(array("q", table.column(c).to_pylist()) for c in ("blocks", "whole")))
    done, start = array("q", bytes(8 * len(names))), 0
    while chunk := list(islice(order, CHUNK)):
        at = array("q")
        for i in chunk:
            at.append(done[i])
            done[i] += 1
        columns = [names.take(pa.array(chunk, pa.int64())), pa.array(at, pa.int64()), pa.array(range(start, start + len(chunk)), pa.int64())]
        start += len(chunk)
        yield pa.RecordBatch.from_arrays(columns, ["source", "block", "slot"])


def prefix(columns: list[str]) -> str:
    """What the schedule's own columns start with: "mix_", with more underscores where the input has such names."""
    out = "mix_"
    while any(c.startswith(out) for c in columns):
        out += "_"
    return out


def schedule(docs: DataFrame, weights: Mapping[str, float] | None = None, block: int = BLOCK, bucket: int = BUCKET, power: float = 1.0) -> DataFrame:
    """The documents with mix_source, mix_bytes, mix_start, mix_block and mix_slot.

    mix_start is a document's place in its source's stream of bytes, whose order is a hash's
    of id and text; mix_block is the block that it starts in and mix_slot the block's slot in
    the mixture. All rows stay. ``weights`` names target weights; without them, or for sources
    they don't name, a source's share of bytes to the given power is its weight: power one
    follows the shares, power zero draws all sources alike until they run dry. A null source
    counts as the empty name; null and empty texts, as one byte; repeated rows take a place
    each; rows without an id are placed by their text. Where the input has columns that start
    with mix_, the new ones take prefix() instead. Blocks hold ``block`` bytes, or a SLOTS-th of all
    bytes if that is more. There may be any number of sources; a weight that is not a finite
    number above zero raises ValueError.
    """
    spark, p = docs.sparkSession, prefix(docs.columns)
    source, size, key, buck, total, base, start, blk, slot = (p + x for x in ("source", "bytes", "key", "bucket", "sum", "base", "start", "block", "slot"))
    n_bytes = F.greatest(F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(1)), F.lit(1)).cast("bigint")
    rows = docs.withColumn(source, F.coalesce(F.col("source").cast("string"), F.lit(""))).withColumn(size, n_bytes)
    rows = rows.withColumn(key, F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string")))
    totals = materialize(rows.groupBy(source).agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("n")))
    every, most, sources = totals.agg(F.sum("bytes"), F.max("n"), F.count(F.lit(1))).first()
    if not sources:
        return rows.drop(key).withColumns({c: F.lit(0).cast("bigint") for c in (start, blk, slot)})
    block = max(block, -(-every // SLOTS))
    share = F.pow(F.col("bytes") / F.lit(float(every)), F.lit(float(power)))
    if weights:
        named = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], f"{source} string, weight double")
        totals, share = totals.join(named, source, "left"), F.coalesce("weight", share)
    flows = totals.select(source, F.ceil(F.col("bytes") / F.lit(block)).cast("bigint").alias("blocks"), share.alias("weight"))
    if not flows.filter("weight is null or not (weight > 0 and weight < double('infinity'))").isEmpty():
        raise ValueError("weights must be positive")
    # Several buckets for each task, so that those of a hot source spread evenly.
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), most // bucket)
    rows = rows.withColumn(buck, F.pmod(F.xxhash64(key, F.lit(1)), F.lit(buckets)))
    sums = rows.groupBy(source, buck).agg(F.sum(size).alias(total))
    before = Window.partitionBy(source).orderBy(buck).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(source, buck, F.coalesce(F.sum(total).over(before), F.lit(0)).alias(base))
    inside = Window.partitionBy(source, buck).orderBy(key, "doc_id", size).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(bases, [source, buck]).withColumn(start, F.col(base) + F.coalesce(F.sum(size).over(inside), F.lit(0)))
    placed = placed.withColumn(blk, F.floor(F.col(start) / F.lit(block)).cast("bigint"))
    steps = flows.repartition(1).mapInArrow(_slots, "source string, block bigint, slot bigint").toDF(source, blk, slot)
    steps = F.broadcast(steps) if every // block + sources <= BROADCAST else steps
    return placed.join(steps, [source, blk]).select(*docs.columns, source, size, start, blk, slot)


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None, block: int = BLOCK, partitions: int | None = None, power: float = 1.0) -> DataFrame:
    """All documents with their columns, in the order of the mixture: range-partitioned by slot.

    Nulls, repeats and clashing names are as in schedule(); an empty table stays empty.
    """
    placed, p = schedule(docs, weights, block, power=power), prefix(docs.columns)
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionByRange(n, f"{p}slot", f"{p}start").sortWithinPartitions(f"{p}slot", f"{p}start").select(docs.columns)
