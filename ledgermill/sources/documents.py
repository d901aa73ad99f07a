"""Files to documents, with limits; bad files go to an error table and don't stop the others."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Most bytes of a file, pages, inflated bytes of a stream and of a file, least text.
MAX_FILE, MAX_PAGES, MAX_STREAM, MAX_TOTAL, MIN_TEXT, CHUNK = 15 << 20, 30, 50 << 20, 150 << 20, 20, 1 << 20


def read_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """path, length, content of all files below a folder, in any store that Spark reads."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def extract_pages(files: DataFrame, extractor: Callable[[bytes], list[str]]) -> DataFrame:
    """path, pages, error: ``extractor`` turns a file's bytes into page texts; what it raises is the error.

    No document library comes with the engine; the extractor is the place for one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pages, errors = [], []
            for content in batch["content"]:
                try:
                    pages.append(list(extractor(content)))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  one file's failure is its own row
                    pages.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"path": batch["path"], "pages": pages, "error": errors})

    return files.select("path", "content").mapInPandas(run, "path string, pages array<string>, error string")


def has_text_layer(pages: Column, least: int = MIN_TEXT) -> Column:
    return F.aggregate(F.coalesce(pages, F.array().cast("array<string>")), F.lit(0), lambda acc, p: acc + F.length(F.trim(F.coalesce(p, F.lit(""))))) >= least


@F.pandas_udf(T.LongType())
def _inflated(raw: pd.Series) -> pd.Series:
    def size(data: bytes | None) -> int:
        if data is None:
            return 0
        machine, total, rest = zlib.decompressobj(), 0, data
        try:
            while rest and total <= MAX_STREAM:
                total += len(machine.decompress(rest, CHUNK))
                rest = machine.unconsumed_tail
        except zlib.error:
            return len(data)
        return total

    return raw.map(size)


def inflated_size(raw: Column) -> Column:
    """Bytes that a deflated stream grows to, in bounded steps and not far past the limit; corrupt ones as they are."""
    return _inflated(raw)


def over_budget(streams: DataFrame) -> DataFrame:
    """path, total, too_large of (path, raw, is_deflated): other streams count as they are."""
    sized = streams.select("path", F.when(F.col("is_deflated"), inflated_size(F.when(F.col("is_deflated"), F.col("raw")))).otherwise(F.length("raw")).alias("n"))
    return sized.groupBy("path").agg(F.sum("n").alias("total"), F.max("n").alias("largest")).withColumn("too_large", (F.col("total") > MAX_TOTAL) | (F.col("largest") > MAX_STREAM)).drop("largest")


def checked(files: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with doc and pages, errors with path and error) under the limits."""
    rows = files.select("path", "length").join(pages, "path", "left")
    count = F.coalesce(F.size("pages"), F.lit(0))
    error = (
        F.when(F.col("length") > MAX_FILE, "too_large")
        .when(F.col("error").isNotNull(), F.col("error"))
        .when(~count.between(1, MAX_PAGES), "page_count")
        .when(~has_text_layer(F.col("pages")), "scanned")
    )
    marked = rows.withColumn("error", error)
    return marked.filter("error is null").select(F.col("path").alias("doc"), "pages"), marked.filter("error is not null").select("path", "error")


def parse_statistics(parsed: DataFrame) -> DataFrame:
    """Per document: lines, dated, with an amount, both, parsed. Input is parse_lines' output."""
    from ..functions.money import date_tokens, tokens_of

    dated, priced = F.size(date_tokens(F.col("line"))) > 0, F.size(tokens_of(F.col("line"))) > 1
    return parsed.groupBy("doc").agg(F.count(F.lit(1)).alias("lines"), F.count_if(dated).alias("dated"), F.count_if(priced).alias("priced"), F.count_if(dated & priced).alias("both"), F.count("tx").alias("parsed"))
