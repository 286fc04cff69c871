"""Ordered data-parallel algorithms over DataFrames: position is a column, and no step needs all rows in one task.

Every algorithm takes the order column by name; it must be a unique long. Running folds are two-phase block scans: a
block's total is aggregated, totals are scanned, in blocks again while they are many, and each block goes on from the
total before it. Blocks follow from the order column alone, so results don't depend on the partitioning.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.intmath import wrap64

#: Rows in a block of a scan or fold; the last level of totals has N / BLOCK ** LEVELS rows.
BLOCK = 65_536
LEVELS = 2
# Where the checksum begins, and its factor.
CHECKSUM_OFFSET, CHECKSUM_PRIME = 1469598103934665603, 1099511628211


@dataclass(frozen=True)
class Monoid:
    """A known associative operation: its aggregate, how two partial results combine, and whether order may change."""

    name: str
    aggregate: Callable[[Column], Column]
    combine: Callable[[Column, Column], Column]
    commutative: bool = True
    finish: Callable[[Column], Column] = staticmethod(lambda x: x)
    merge: Callable[[Column], Column] | None = None  # the aggregate over partial results, if it is another

    @property
    def over_totals(self) -> Monoid:
        return self if self.merge is None else replace(self, aggregate=self.merge, merge=None)


_decimal = lambda x: x.cast("decimal(38,0)")
SUM = Monoid("sum", F.sum, lambda a, b: a + b)
WRAPPING_SUM = Monoid("wrapping_sum", lambda x: F.sum(_decimal(x)), lambda a, b: (_decimal(a) + _decimal(b)).cast("decimal(38,0)"), finish=wrap64)
MIN = Monoid("min", F.min, F.least)
MAX = Monoid("max", F.max, F.greatest)
COUNT = Monoid("count", lambda x: F.sum(F.when(x.isNotNull(), 1).otherwise(0).cast("long")), lambda a, b: a + b, merge=F.sum)
BIT_AND = Monoid("bit_and", F.bit_and, lambda a, b: a.bitwiseAND(b))
BIT_OR = Monoid("bit_or", F.bit_or, lambda a, b: a.bitwiseOR(b))
BIT_XOR = Monoid("bit_xor", F.bit_xor, lambda a, b: a.bitwiseXOR(b))
ALL = Monoid("all", F.bool_and, lambda a, b: a & b)
ANY = Monoid("any", F.bool_or, lambda a, b: a | b)
MONOIDS = {m.name: m for m in (SUM, WRAPPING_SUM, MIN, MAX, COUNT, BIT_AND, BIT_OR, BIT_XOR, ALL, ANY)}


def check_order(df: DataFrame, order: str) -> None:
    """Raises ValueError if positions are null or not unique."""
    bad = df.groupBy(order).count().where((F.col("count") > 1) | F.col(order).isNull())
    if bad.limit(1).count():
        raise ValueError(f"{order} is no unique position")


#: Bits of monotonically_increasing_id() that count rows within a partition.
_WITHIN = 33


def with_index(df: DataFrame, *by: str, out: str = "idx") -> DataFrame:
    """Adds dense positions from 0 in the order of `by`, nulls first; rows equal in all of `by` are numbered in any order.

    Rows are dealt to partitions by ranges of all keys, so equal values of the first key alone don't share a task, and
    sorted there; a row's place is its partition's offset, from one count for each partition, and its place within. The
    sorted rows are checkpointed, as their ranges come from a sample that a second run would draw anew.
    """
    keys = [F.col(c).asc_nulls_first() for c in by]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()).checkpoint()
    block = F.shiftright("__at", _WITHIN)
    counts = ranged.groupBy(block.alias("__block")).agg(F.count("*").alias("__n"))
    before = counts.select("__block", F.coalesce(F.sum("__n").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # a row for each partition
    within = F.col("__at").bitwiseAND(F.lit((1 << _WITHIN) - 1))
    return ranged.withColumn("__block", block).join(F.broadcast(before), "__block").withColumn(out, (F.col("__before") + within).cast("long")).drop("__block", "__before", "__at")


def merge_sorted(frames: list[DataFrame], *by: Column) -> DataFrame:
    """Sorted frames of one schema as one sorted frame: their rows meet in ranges of the keys, each range sorted by one task."""
    import functools

    return functools.reduce(DataFrame.unionByName, frames).orderBy(*by)


def checksum(df: DataFrame, order: str, value: str, out: str = "checksum") -> DataFrame:
    """One row: the order-sensitive digest of 64-bit values, each step a wrapping product and an exclusive or.

    No two steps can be combined before the earlier is known, so one task folds the values in order, batch by batch; it
    holds one batch.
    """

    def fold(batches):
        state, mask = CHECKSUM_OFFSET, (1 << 64) - 1
        for batch in batches:
            for v in batch.column(0).to_pylist():
                state = (state * CHECKSUM_PRIME & mask) ^ (v & mask)
        yield pa.RecordBatch.from_arrays([pa.array([state - (1 << 64) if state >> 63 else state])], names=[out])

    return df.select(F.col(order).alias("i"), F.col(value).cast("long").alias("v")).repartition(1).sortWithinPartitions("i").select("v").mapInArrow(fold, f"{out} long").agg(F.coalesce(F.first(out), F.lit(CHECKSUM_OFFSET)).alias(out))


def transform(df: DataFrame, order: str, **exprs: Column) -> DataFrame:
    """The positions with each expression's value: a projection, in whole-stage code. No rows give no rows."""
    return df.select(order, *[e.alias(k) for k, e in exprs.items()])


def transform_batches(df: DataFrame, order: str, value: str, fn: Callable[[pd.Series], pd.Series], kind: str, out: str = "value") -> DataFrame:
    """transform() for an opaque function, over Arrow batches."""
    return df.select(order, F.pandas_udf(fn, kind)(F.col(value)).alias(out))


def for_each(df: DataFrame, **exprs: Column) -> DataFrame:
    """Columns replaced in place."""
    return df.withColumns(exprs)


def reduce(df: DataFrame, value: str | Column, monoid: Monoid, init=None, out: str = "value") -> DataFrame:
    """One row: init combined once, on the left, with the fold of all values; of no rows, init."""
    x = F.col(value) if isinstance(value, str) else value
    total = monoid.aggregate(x)
    if init is not None:
        start = init if isinstance(init, Column) else F.lit(init)
        total = F.when(total.isNull(), start).otherwise(monoid.combine(start, total))
    return df.agg(monoid.finish(total).alias(out))


def reduce_ordered_text(df: DataFrame, order: str, value: str, out: str = "value", block: int = BLOCK) -> DataFrame:
    """Texts joined in order, an associative operation that doesn't commute: blocks are joined first, then the blocks' texts."""
    rows = df.select(F.floor(F.col(order) / block).alias("b"), F.col(order).alias("i"), F.col(value).alias("v"))
    parts = rows.groupBy("b").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]), "").alias("v"))
    return parts.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "v"))), lambda x: x["v"]), "").alias(out))


def reduce_opaque(df: DataFrame, order: str, value: str, fold: Callable, init, kind: str, out: str = "value", block: int = BLOCK) -> DataFrame:
    """One row: init folded once, on the left, with all values in order, by an associative function of two values.

    Each round folds blocks in order to one value; rounds go on until one block is left, so no task holds more than a block.
    """
    import functools

    spark = df.sparkSession
    rows = df.select(F.col(order).cast("long").alias("i"), F.col(value).alias("v"))
    element = rows.schema["v"].dataType.simpleString()

    def one(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [int(group["i"].iloc[0]) // block], "v": [functools.reduce(fold, group.sort_values("i")["v"].tolist())]})

    top = rows.agg(F.max("i")).first()[0]
    if top is None:
        return spark.createDataFrame([(init,)], f"{out} {kind}")
    while True:
        rows = rows.groupBy(F.floor(F.col("i") / block)).applyInPandas(one, f"i long, v {element}")
        top //= block
        if not top:
            break
    return rows.select(F.udf(lambda v: fold(init, v), kind)("v").alias(out))


def find(df: DataFrame, order: str, predicate: Column, out: str = "idx") -> DataFrame:
    """One row: the least position whose row fulfils the predicate, null if none does."""
    return df.where(predicate).agg(F.min(order).alias(out))


def find_row(df: DataFrame, order: str, predicate: Column) -> DataFrame:
    """The first row that fulfils the predicate, or no row."""
    return df.where(predicate).orderBy(order).limit(1)


def _before(totals: DataFrame, monoid: Monoid, block: int, levels: int) -> DataFrame:
    """b and `before`, the fold of all totals of earlier blocks, null for the first."""
    if levels <= 1:
        window = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        return totals.select("b", monoid.aggregate(F.col("t")).over(window).alias("before"))
    inner = _scan(totals, "b", "t", monoid, block, levels - 1, exclusive=True)
    return inner.select("b", F.col("__out").alias("before"))


def _scan(df: DataFrame, order: str, value: str, monoid: Monoid, block: int, levels: int, exclusive: bool) -> DataFrame:
    rows = df.withColumn("__b", F.floor(F.col(order) / block))
    totals = rows.groupBy(F.col("__b").alias("b")).agg(monoid.aggregate(F.col(value)).alias("t"))
    before = _before(totals, monoid.over_totals, block, levels).withColumnRenamed("b", "__b")
    frame = Window.partitionBy("__b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    own = monoid.aggregate(F.col(value)).over(frame)
    both = rows.join(before, "__b").withColumn("__own", own)
    known = F.when(F.col("before").isNull(), F.col("__own")).when(F.col("__own").isNull(), F.col("before")).otherwise(monoid.combine(F.col("before"), F.col("__own")))
    return both.withColumn("__out", known).drop("__b", "before", "__own")


def inclusive_scan(df: DataFrame, order: str, value: str, monoid: Monoid, out: str = "value", block: int = BLOCK, levels: int = LEVELS) -> DataFrame:
    """Each position with the fold of all values up to it. No rows give no rows; null values add nothing."""
    x = df.select(F.col(order), F.col(value).alias("__v"))
    return _scan(x, order, "__v", monoid, block, levels, exclusive=False).select(order, monoid.finish(F.col("__out")).alias(out))


def exclusive_scan(df: DataFrame, order: str, value: str, monoid: Monoid, init, out: str = "value", block: int = BLOCK, levels: int = LEVELS) -> DataFrame:
    """Each position with init folded with all values before it; the first has init."""
    x = df.select(F.col(order), F.col(value).alias("__v"))
    start = F.lit(init)
    got = _scan(x, order, "__v", monoid, block, levels, exclusive=True)
    return got.select(order, monoid.finish(F.when(F.col("__out").isNull(), start).otherwise(monoid.combine(start, F.col("__out")))).alias(out))


def scan_opaque(df: DataFrame, order: str, value: str, accumulate: Callable, combine: Callable, out: str = "value", block: int = BLOCK) -> DataFrame:
    """An inclusive scan by opaque functions: accumulate(array) gives an array's running fold, combine(a, array) puts a before each.

    Blocks are folded in Arrow batches; the totals, one for each block, are scanned in blocks too while they exceed one.
    Positions may leave gaps, of whole blocks too.
    """
    return _scan_opaque(df, order, value, accumulate, combine, out, block, exclusive=False).drop("known")


def _scan_opaque(df: DataFrame, order: str, value: str, accumulate: Callable, combine: Callable, out: str, block: int, exclusive: bool) -> DataFrame:
    """order, out and known; where nothing stands before a position of an exclusive scan, known is false and out has no meaning."""
    kind = df.schema[value].dataType.simpleString()
    rows = df.select(F.col(order).cast("long").alias("i"), F.col(value).alias("v")).withColumn("b", F.floor(F.col("i") / block))

    def total(group: pd.DataFrame) -> pd.DataFrame:
        folded = accumulate(group.sort_values("i")["v"].to_numpy())
        return pd.DataFrame({"i": [group["b"].iloc[0]], "v": [folded[-1]]})

    totals = rows.groupBy("b").applyInPandas(total, f"i long, v {kind}")
    top = df.agg(F.max(order)).first()[0]
    if top is None:
        return df.select(F.col(order).cast("long").alias(order), F.col(value).alias(out), F.lit(False).alias("known"))

    def before(folded: np.ndarray, first, known: bool) -> dict:
        """What stands before each value of a running fold."""
        return {"v": np.r_[np.array([first], folded.dtype), folded[:-1]], "known": np.r_[known, np.ones(len(folded) - 1, bool)]}

    if top // block > block:
        scanned = _scan_opaque(totals, "i", "v", accumulate, combine, "v", block, exclusive=True)
    else:

        def whole(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("i")
            folded = accumulate(group["v"].to_numpy())
            return pd.DataFrame({"i": group["i"].to_numpy(), **before(folded, folded[0], False)})

        scanned = totals.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(whole, f"i long, v {kind}, known boolean")  # at most `block` totals
    carried = scanned.select(F.col("i").alias("b"), F.col("v").alias("carry"), "known")

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("i")
        folded, known = accumulate(group["v"].to_numpy()), bool(group["known"].iloc[0])
        carry = group["carry"].iloc[0].astype(folded.dtype) if known else folded[0]
        if known:
            folded = combine(carry, folded)
        got = before(folded, carry, known) if exclusive else {"v": folded, "known": np.ones(len(folded), bool)}
        return pd.DataFrame({order: group["i"].to_numpy(), out: got["v"], "known": got["known"]})

    joined = rows.join(carried, "b", "left").na.fill({"known": False}).na.fill(0, ["carry"])
    return joined.groupBy("b").applyInPandas(finish, f"{order} long, {out} {kind}, known boolean")


def sort(df: DataFrame, value: str, order: str) -> DataFrame:
    """Rows by value ascending, nulls first; ties by position, so that the result is one."""
    return df.orderBy(F.col(value).asc_nulls_first(), order)


def sort_by(df: DataFrame, *keys: Column) -> DataFrame:
    """Rows by the keys that stand for a comparison; name the position last."""
    return df.orderBy(*keys)


def sort_array_by(array: Column, compare: Callable[[Column, Column], Column]) -> Column:
    """A bounded array sorted by an opaque comparison of two elements."""
    return F.array_sort(array, compare)


def parallel_for(spark, start: int, end: int, partitions: int | None = None, out: str = "idx", **body: Column) -> DataFrame:
    """Every index of [start, end) once, with the body's values; an empty range gives no rows."""
    df = spark.range(start, max(start, end), 1, partitions).withColumnRenamed("id", out)
    return df.select(out, *[e.alias(k) for k, e in body.items()])


def parallel_for_effect(spark, start: int, end: int, body: Callable[[int], None], partitions: int | None = None) -> None:
    """Calls body with every index of [start, end), once unless a task is retried, on the executors."""

    def run(rows):
        for r in rows:
            body(r.id)

    spark.range(start, max(start, end), 1, partitions).foreachPartition(run)
