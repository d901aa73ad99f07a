"""SimHash near-duplicates by deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, forest, materialize, release, texts_of
from .suffixdup import _LAST as LAST
from .suffixdup import _numbered

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SHINGLE = 3
SEED = 42
#: Members of a bucket that one task compares directly; larger buckets take the exact path.
DIRECT = 1024
#: Buckets (two longs each) that are broadcast at most; more are joined by shuffling.
BROADCAST_ROWS = 200_000
#: Fingerprints, with 64 variants each, that one task spreads on average.
TASK = 16_384


def fingerprint(text: bytes, width: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits of the XXH64 values of a text's word shingles, as an unsigned integer."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_digest, b" ".join
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        part = words[at : min(n, at + (1 << 15)) + width - 1]
        rows = [digest(join(x), seed) for x in zip(*(part[k:] for k in range(width)))] if len(words) >= width else [digest(join(words), seed)]
        bits = np.unpackbits(np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(x) for x in texts_of(batch.column(1))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(prints)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint as a signed bigint, one row for each input row.

    Null and empty texts have fingerprint zero. Other columns are not read.
    """
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id bigint, fp bigint")


def _variants(fp: str = "fp") -> F.Column:
    """Keys of both 32-bit segments with each of their bits deleted: slot in the high half."""
    keys = []
    for bit in range(64):
        shift = 32 * (bit // 32)
        segment = F.shiftrightunsigned(F.col(fp), shift).bitwiseAND(F.lit(0xFFFFFFFF & ~(1 << (bit - shift))))
        keys.append(segment.bitwiseOR(F.lit(bit << 32)))
    return F.array(*keys)


def _pairs_within(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for members in batch.column(0).to_pylist():
                v = np.array(members, np.int64).view(np.uint64)
                i, j = np.nonzero(np.bitwise_count(v[:, None] ^ v[None, :]) <= limit)
                a, b = forest(*(v.view(np.int64)[x[i < j]] for x in (i, j)))
                left.append(a)
                right.append(b)
            flat = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (left, right)]
            yield pa.RecordBatch.from_arrays(flat, ["a", "b"])

    return run


def links(distinct: DataFrame, direct: int = DIRECT) -> DataFrame:
    """Links (a, b) that connect exactly what pairs of fingerprints at two or fewer bits connect.

    Two fingerprints at Hamming distance two or less differ by at most one bit in one of
    two 32-bit segments, so they share a variant of it with one bit deleted. Variants are
    joined by equality; a bucket's links are reduced to a spanning star before they leave
    the task. Buckets of over ``direct`` members are not compared pairwise: their members
    get all variants with two of 64 bits deleted, which hold at most four fingerprints each.
    """
    tasks = max(distinct.sparkSession.sparkContext.defaultParallelism, distinct.count() // TASK + 1)
    spread = distinct.repartition(tasks, "fp").select("fp", F.explode(_variants()).alias("key"))
    buckets = materialize(spread.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    pairs = buckets.filter("n = 2").filter(near).select("a", "b")
    crowds = buckets.filter("n > 2").select("key", "n")
    members = spread.join(F.broadcast(crowds) if crowds.count() <= BROADCAST_ROWS else crowds, "key")
    small = members.filter(F.col("n") <= direct).groupBy("key").agg(F.collect_list("fp").alias("members")).select("members").mapInArrow(_pairs_within(2), "a bigint, b bigint")
    crowded = members.filter(F.col("n") > direct).select("fp").distinct()
    gone = [(1 << p) | (1 << q) for p in range(64) for q in range(p)]
    masks = F.array(*[F.lit(int(np.uint64(m).view(np.int64))) for m in gone])
    cliques = (
        crowded.select("fp", F.posexplode(masks).alias("slot", "mask"))
        .groupBy("slot", F.col("fp").bitwiseAND(F.bitwise_not("mask")).alias("rest"))
        .agg(F.collect_set("fp").alias("members"))
        .filter("size(members) > 1")
        .select(F.array_min("members").alias("a"), F.explode("members").alias("b"))
        .filter("a <> b")
    )
    return pairs.unionByName(small).unionByName(cliques).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", direct: int = DIRECT) -> DataFrame:
    """One row for each input row: doc_id, fingerprint (16 hex digits), component_id.

    Texts whose fingerprints differ by at most two bits are linked; component_id is the
    smallest doc_id reachable. Null and empty texts share fingerprint zero and so one
    component. A row without an id keeps its fingerprint and takes part in its class;
    repeated rows give repeated results; an empty table gives none. Columns beyond the id
    and the text are ignored.
    """
    prints = materialize(fingerprints(docs, id_col, text_col))
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = connected_components(links(classes.select("fp"), direct))
    release(docs.sparkSession)
    named = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return prints.join(named.join(least, "component").select("fp", "component_id"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, direct: int = DIRECT) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest doc_id, with all columns.

    Every row is judged alone: of rows that share an id each stays or goes by its own text,
    and where a group's smallest id stands in several rows, that with the smallest hash of
    its text stays. Rows without an id come after all others; of repeated rows one stays.
    Null and empty texts are one group, as in near_duplicates(); an empty table stays empty.
    """
    key = "_key"
    while key in docs.columns:
        key += "_"
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)))
    if not keyed.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        keyed = _numbered(docs, key)
    found = near_duplicates(keyed, key, direct=direct)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(key))
    return keyed.join(gone, key, "left_anti").select(docs.columns)
