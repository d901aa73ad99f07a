"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, crossparse, htmlcut, mixing, neardup, packing, quality, repair, simhash, suffixdup, toxicity, vectorcodes, vptree
from .common import read

#: Power of a source's share of bytes that is its target weight: zero, so all have the same.
EQUAL = 0.0


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlcut.extract(read(spark, sf_dir, "pages"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(read(spark, sf_dir, "conversations"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdup.substring_report(read(spark, sf_dir, "documents"))


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by 100, searched among all rows."""
    return vptree.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's block and slot; all sources have the same target weight, EQUAL, until they run dry."""
    rows = mixing.schedule(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), power=EQUAL)
    return rows.select("doc_id", "source", F.col("mix_bytes").alias("n_bytes"), F.col("mix_start").alias("source_start"), F.col("mix_block").alias("block"), F.col("mix_slot").alias("slot"))


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossparse.identify(read(spark, sf_dir, "documents"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(read(spark, sf_dir, "conversations"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compress(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html": op1_html,
    "op2_chat": op2_chat,
    "op3_suffix": op3_suffix,
    "op4_toxicity": op4_toxicity,
    "op5_neardup": op5_neardup,
    "op6_simhash": op6_simhash,
    "op7_nearest": op7_nearest,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_mixing": op10_mixing,
    "op11_language": op11_language,
    "op12_repair": op12_repair,
    "op13_codes": op13_codes,
}

ORACLE_SQL: dict[str, str] = {"op2_chat": chat.ORACLE, "op13_codes": vectorcodes.ORACLE}
