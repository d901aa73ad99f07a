"""documents -> quality -> near-duplicates -> repeated passages -> mixture -> packed sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgermill.llm import mixing, packing, quality, simhash, suffixdup
from ledgermill.llm.common import discard, materialize, read

#: Target weight of a source in the mixture: its share of bytes to this power, so that small
#: sources are drawn more often than their size alone would have them, until they run dry.
POWER = 0.5


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels outside the held-out third, accepts."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near-duplicates."""
    return simhash.drop_near_duplicates(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the bytes that repeat what stands earlier."""
    return suffixdup.remove_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in the order of a mixture to the sources' shares of bytes to the POWER."""
    return mixing.mixed(docs, power=POWER)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences, numbered along the mixture.

    A table has no order of its rows, so the mixture's slots are computed again.
    """
    slots = mixing.schedule(docs.select("doc_id", "source", "text"), power=POWER)
    return packing.pack(slots, order=("mix_slot", "mix_start"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", remove_repeats),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL cannot express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next; a table goes once the next one is written."""
    docs, written = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        if written is not None:
            discard(written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
