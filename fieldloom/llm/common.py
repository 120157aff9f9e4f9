"""Pieces that several text operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.session import read_table, shared_dir

#: White space that separates words; the same six characters for every operator.
BLANKS = "\t\n\x0b\x0c\r "
BLANK_RUN = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

__all__ = ["BLANKS", "BLANK_RUN", "ascii_lower", "documents", "hashed_windows", "read_table", "row_key", "short_reads", "small_batches", "shared_dir", "split_words", "stored", "union_length"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone. Pure ASCII texts, the common case, take the faster built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_words(text: Column, separators: str = BLANK_RUN) -> Column:
    """The non-empty pieces between runs of separators; an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separators), lambda w: w != "")


def row_key(*columns: Column) -> Column:
    """16 bytes that stand for a row's values: repeated rows share it, nulls differ from any value."""
    parts = [F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n")) for c in columns]
    return F.unhex(F.md5(F.concat_ws("\x00", *parts)))


def hashed_windows(df: DataFrame, words: str, size: int, out: str) -> DataFrame:
    """Adds `out`: 64-bit hashes of all `size`-word windows of the array column `words`, in order.

    Windows of 1, 2, 4, ... words are built from pairs of half windows, so each window costs
    log2(size) hash calls rather than one over all its words.
    """
    made, span, name = df.withColumn(out, F.transform(words, lambda w: F.xxhash64(w))), 1, F.col(out)
    while span < size:
        step = min(span, size - span)
        made = made.withColumn(out, F.zip_with(name, F.slice(name, step + 1, F.greatest(F.size(name), F.lit(1))), lambda a, b: F.xxhash64(a, b)))
        span += step
    return made.withColumn(out, F.slice(name, 1, F.greatest(F.size(name) - (size - 1), F.lit(0))))


def union_length(starts: Column, width: int) -> Column:
    """Positions covered by windows of one width that start at the given sorted, distinct positions."""
    gaps = F.transform(starts, lambda p, j: F.least(F.lit(width), F.coalesce(F.get(starts, j + 1) - p, F.lit(width))))
    return F.aggregate(gaps, F.lit(0), lambda total, x: total + x)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: later stages restart from files that any executor sees."""
    path = f"{shared_dir(df.sparkSession)}/fieldloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "4m") -> None:
    """Arrow batches of at most so many texts, and of 4 MB or `size`: some are very long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


@contextmanager
def short_reads(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """Parquet is read in batches of at most so many rows meanwhile: a batch of long texts or arrays is held as a whole."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    given = spark.conf.get(key)
    spark.conf.set(key, str(min(int(given), rows)))
    try:
        yield
    finally:
        spark.conf.set(key, given)
