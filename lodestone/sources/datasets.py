"""Sources: seeded arrays, ranges, layered graphs and generators, as DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The generator's constants, and the pattern that is looked for.
MULTIPLIER, INCREMENT = 6364136223846793005, 1442695040888963407
NEEDLE, NEEDLE_SWAP = 0x9E3779B97F4A7C15, 0xA0761D6478BD642F


def array(spark: SparkSession, values: Iterable, kind: str = "long", out: str = "v") -> DataFrame:
    """Values in memory with their positions."""
    return spark.createDataFrame(list(enumerate(values)), f"idx long, {out} {kind}")


def index_range(spark: SparkSession, start: int, end: int, partitions: int | None = None) -> DataFrame:
    return spark.range(start, max(start, end), 1, partitions).withColumnRenamed("id", "idx")


def lcg(spark: SparkSession, length: int, seed: int, needle: int = NEEDLE, chunk: int = 1 << 16) -> DataFrame:
    """idx and v of a linear congruential sequence, with the needle three quarters in; values are 64-bit patterns as longs.

    A task jumps to its chunk's state in logarithmic time and makes the chunk with running products and sums of the
    multiplier, so chunks are made in parallel and their values all at once.
    """
    mask = (1 << 64) - 1

    def jump(state: int, n: int) -> int:
        a, c = MULTIPLIER, INCREMENT
        while n:
            if n & 1:
                state = (state * a + c) & mask
            a, c, n = a * a & mask, (a + 1) * c & mask, n >> 1
        return state

    def run(batches):
        import pyarrow as pa

        powers = np.multiply.accumulate(np.full(chunk, MULTIPLIER, np.uint64))
        sums = np.cumsum(np.r_[np.uint64(1), powers[:-1]], dtype=np.uint64) * np.uint64(INCREMENT)
        for batch in batches:
            for b in batch.column(0).to_pylist():
                begin, end = b * chunk, min((b + 1) * chunk, length)
                states = powers[: end - begin] * np.uint64(jump(seed | 1, begin)) + sums[: end - begin]
                values = states ^ (states >> np.uint64(33))
                values[values == np.uint64(needle)] ^= np.uint64(NEEDLE_SWAP)
                if begin <= length * 3 // 4 < end:
                    values[length * 3 // 4 - begin] = needle
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(begin, end)), pa.array(values.view(np.int64))], names=["idx", "v"])

    return spark.range(0, -(-length // chunk)).mapInArrow(run, "idx long, v long")


def generated(spark: SparkSession, produce: Callable[[int], object] | Callable[[Column], Column], stop: int, kind: str = "long", out: str = "v", partitions: int | None = None) -> DataFrame:
    """A bounded generator: token and produce(token) for each token below stop.

    produce is asked with the token column first; one that gives an expression stays an expression. Any other is called
    for each token over Arrow batches.
    """
    rows = spark.range(0, stop, 1, partitions).select(F.col("id").alias("token"))
    try:
        made = produce(F.col("token"))
    except Exception:  # noqa: BLE001  an opaque function may do anything with a column
        made = None
    if isinstance(made, Column):
        return rows.select("token", made.cast(kind).alias(out))
    return rows.select("token", F.pandas_udf(lambda t: t.map(produce), kind)("token").alias(out))


def level_graph(spark: SparkSession, length: int, levels: int, seed: int = 7) -> DataFrame:
    """Edges (src, dst) of a layered graph: every node of a level has one to four successors in the next. Node ids are level * length + place.

    Successors come from a multiplicative generator modulo 2**31 - 1 that starts at the node, in column expressions.
    """
    step = lambda x: x * 48271 % 2147483647
    start = step(step((F.col("id") + 1) * 16807 % 2147483647 + seed))
    drawn = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.aggregate(F.sequence(F.lit(1), k), start, lambda x, _: step(x)) % length)
    rows = spark.range(length * max(levels - 1, 0)).select("id", F.array_distinct(F.slice(drawn, 1, 1 + start % 4)).alias("places"))
    return rows.select(F.col("id").alias("src"), F.explode("places").alias("p")).select("src", ((F.floor(F.col("src") / length) + 1) * length + F.col("p")).alias("dst"))
