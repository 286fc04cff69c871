"""How a range is cut into chunks, as DataFrames of (chunk_id, start, end), half open."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def auto_size(length: int, workers: int) -> int:
    """A quarter of a worker's share, at least 1."""
    return max(1, ceil(length / (4 * workers)))


def _check(size: int) -> int:
    if size <= 0:
        raise ValueError("chunk size must be positive")
    return size


def dynamic(spark: SparkSession, length: int, size: int) -> DataFrame:
    """Chunks of one size, the last one shorter; workers take the next free one."""
    n = ceil(length / _check(size))
    return spark.range(n).select(F.col("id").alias("chunk_id"), (F.col("id") * size).alias("start"), F.least((F.col("id") + 1) * size, F.lit(length)).cast("long").alias("end"))


fixed = dynamic


def auto(spark: SparkSession, length: int, workers: int) -> DataFrame:
    return dynamic(spark, length, auto_size(length, workers))


def balanced(spark: SparkSession, length: int, workers: int) -> DataFrame:
    """One chunk for each worker; the first length % workers have one index more. Empty chunks are left out."""
    share, more = divmod(length, workers)
    start = F.col("id") * share + F.least(F.col("id"), F.lit(more))
    return spark.range(min(workers, length)).select(F.col("id").alias("chunk_id"), start.cast("long").alias("start"), (start + share + F.when(F.col("id") < more, 1).otherwise(0)).cast("long").alias("end"))


def static(spark: SparkSession, chunks: list[tuple[int, int]]) -> DataFrame:
    """Given chunks, in order."""
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(chunks)], "chunk_id long, start long, end long")


def guided(spark: SparkSession, length: int, least: int = 1) -> DataFrame:
    """Each chunk is half of what is left, at least `least`, at most the rest: their number grows as the logarithm of the length."""
    _check(least)
    out, start = [], 0
    while start < length:
        size = min(max((length - start) // 2, least), length - start)
        out.append((start, start + size))
        start += size
    return static(spark, out)


def assign(df: DataFrame, order: str, size: int) -> DataFrame:
    """Adds the dynamic chunk of each position."""
    return df.withColumn("chunk_id", F.floor(F.col(order) / _check(size)))
