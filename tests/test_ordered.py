import functools
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import intmath, kernels
from lodestone.operators import ordered
from lodestone.plans import chunks
from lodestone.sources import datasets


def column(df, name="value", order="idx"):
    return [r[name] for r in df.orderBy(order).collect()]


@pytest.mark.parametrize("parts", [1, 3, 8])
@pytest.mark.parametrize("block,levels", [(1000, 1), (7, 2), (4, 3)])
def test_scans_don_t_depend_on_partitions_or_blocks(spark, parts, block, levels):
    v = [(k * 48271 + 1234567) % 1003 for k in range(150)]
    df = datasets.array(spark, v).repartition(parts)
    assert column(ordered.inclusive_scan(df, "idx", "v", ordered.SUM, block=block, levels=levels)) == list(itertools.accumulate(v))
    assert column(ordered.inclusive_scan(df, "idx", "v", ordered.COUNT, block=block, levels=levels)) == list(range(1, 151))
    assert column(ordered.exclusive_scan(df, "idx", "v", ordered.SUM, 10, block=block, levels=levels)) == list(itertools.accumulate([10, *v[:-1]]))


def test_scan_plan_has_no_single_partition_exchange_over_rows(spark):
    df = ordered.inclusive_scan(spark.range(1000).withColumnRenamed("id", "idx").withColumn("v", F.col("idx")), "idx", "v", ordered.SUM, block=10, levels=1)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange SinglePartition") == 1


def test_empty_inputs(spark):
    none = datasets.array(spark, [])
    assert ordered.inclusive_scan(none, "idx", "v", ordered.SUM).count() == 0
    assert ordered.transform(none, "idx", value=F.col("v")).count() == 0
    assert ordered.reduce(none, "v", ordered.SUM, 42).first()[0] == 42
    assert ordered.reduce_opaque(none, "idx", "v", lambda a, b: a + b, 42, "long").first()[0] == 42
    assert ordered.find(none, "idx", F.col("v") == 1).first()[0] is None
    assert ordered.scan_opaque(none, "idx", "v", np.cumsum, lambda c, a: a + c).count() == 0


def test_init_counts_once_on_the_left(spark):
    df = datasets.array(spark, "abcdefgh", "string").repartition(5)
    assert ordered.reduce_opaque(df, "idx", "v", lambda a, b: a + b, ">", "string", block=3).first()[0] == ">abcdefgh"
    assert ordered.reduce_ordered_text(df, "idx", "v", block=3).first()[0] == "abcdefgh"
    assert ordered.reduce(datasets.array(spark, range(1, 1001)).repartition(7), "v", ordered.SUM, 5).first()[0] == 500505


def test_find_is_the_lowest_match(spark):
    tides = datasets.array(spark, [410, 95, 233, 95, 702, 18, 95]).repartition(5)
    assert ordered.find(tides, "idx", F.col("v") == 95).first()[0] == 1
    assert ordered.find(tides, "idx", F.col("v") > 1000).first()[0] is None
    assert ordered.find_row(tides, "idx", F.col("v") < 50).first()["idx"] == 5


@pytest.mark.parametrize("v", [list(range(50)), list(range(50))[::-1], [k % 3 for k in range(50)], [1] * 50, [k // 5 for k in range(50)]])
def test_sorts(spark, v):
    df = datasets.array(spark, v).repartition(6)
    assert [r.v for r in ordered.sort(df, "v", "idx").collect()] == sorted(v)
    assert [r.v for r in ordered.sort_by(df, F.desc("v"), F.col("idx")).collect()] == sorted(v, reverse=True)
    assert column(ordered.with_index(df.withColumnRenamed("idx", "was"), "v", "was"), "v") == sorted(v)


def test_wrapping_scan_and_sums(spark):
    g = random.Random(3)
    v = [g.randrange(-(2**63), 2**63) for _ in range(40)]
    wrap = lambda x: (x + 2**63) % 2**64 - 2**63
    df = datasets.array(spark, v).repartition(3)
    assert column(ordered.inclusive_scan(df, "idx", "v", ordered.WRAPPING_SUM, block=7)) == list(itertools.accumulate(v, lambda a, b: wrap(a + b)))
    assert ordered.reduce(df, "v", ordered.WRAPPING_SUM, 0).first()[0] == functools.reduce(lambda a, b: wrap(a + b), v)
    got = df.select("idx", intmath.wrapping_add(F.col("v"), F.lit(2**62)).alias("a"), intmath.rotate_left(F.col("v"), 7).alias("r"), kernels.scramble(F.col("v")).alias("s")).orderBy("idx").collect()
    rot = lambda x: wrap(((x % 2**64) << 7 | (x % 2**64) >> 57) % 2**64)
    assert [r.a for r in got] == [wrap(x + 2**62) for x in v]
    assert [r.r for r in got] == [rot(x) for x in v]
    assert [r.s for r in got] == [wrap(rot(x) + 0x9E3779B9) for x in v]
    assert [r.v for r in df.orderBy(intmath.unsigned_key(F.col("v"))).collect()] == sorted(v, key=lambda x: x % 2**64)


def test_opaque_product_wraps(spark):
    v = [(k * 48271) % 2**31 | 1 for k in range(60)]
    df = spark.createDataFrame(list(enumerate(v)), "idx long, v int").repartition(5)
    got = ordered.scan_opaque(df, "idx", "v", lambda a: np.multiply.accumulate(a.astype(np.int32), dtype=np.int32), lambda c, a: (a * c).astype(np.int32), block=8)
    assert column(got) == list(itertools.accumulate(v, lambda a, b: (a * b + 2**31) % 2**32 - 2**31))
    assert spark.range(1).select(intmath.wrapping_mul32(F.lit(2**31 - 1), F.lit(2**31 - 1))).first()[0] == 1


@pytest.mark.parametrize("block", [4, 8, 1000])
def test_opaque_scans_go_on_over_gaps(spark, block):
    at = [*range(10), *range(40, 53), 90, 700, *range(2000, 2020)]
    df = spark.createDataFrame([(i, 3 + k) for k, i in enumerate(at)], "idx long, v long").repartition(5)
    got = ordered.scan_opaque(df, "idx", "v", np.cumsum, lambda c, a: a + c, block=block)
    assert column(got) == list(itertools.accumulate(3 + k for k in range(len(at))))


def test_positions_are_checked(spark):
    with pytest.raises(ValueError):
        ordered.check_order(spark.createDataFrame([(1,), (1,)], "idx long"), "idx")
    ordered.check_order(datasets.array(spark, [1, 2]), "idx")


def test_chunks(spark):
    rows = lambda df: [(r.start, r.end) for r in df.orderBy("chunk_id").collect()]
    assert rows(chunks.dynamic(spark, 10, 4)) == [(0, 4), (4, 8), (8, 10)]
    assert rows(chunks.balanced(spark, 10, 4)) == [(0, 3), (3, 6), (6, 8), (8, 10)]
    assert rows(chunks.guided(spark, 100, 10)) == [(0, 50), (50, 75), (75, 87), (87, 97), (97, 100)]
    assert rows(chunks.auto(spark, 0, 4)) == []
    with pytest.raises(ValueError):
        chunks.fixed(spark, 10, 0)


def test_parallel_for(spark):
    assert column(ordered.parallel_for(spark, 3, 9, value=F.col("idx") * 2)) == [6, 8, 10, 12, 14, 16]
    assert ordered.parallel_for(spark, 5, 5).count() == 0


def test_kernels(spark):
    assert spark.range(60).where(kernels.is_prime(F.col("id"))).count() == 17
    work = lambda s: sum((i + k - s % 10) * (k - j + s % 10) for i in range(16) for j in range(16) for k in range(16)) % 999
    assert [r[0] for r in spark.range(25).select(kernels.matrix_work(F.col("id"))).collect()] == [work(s) for s in range(25)]
    got = spark.createDataFrame([(1e20,), (float("nan"),), (-3.7,)], "x double").select(kernels.clamp_int(F.col("x"))).collect()
    assert [r[0] for r in got] == [2**31 - 1, 0, -3]


def test_lcg_jumps(spark):
    state, out = 43, []
    for _ in range(300):
        state = (state * datasets.MULTIPLIER + datasets.INCREMENT) % 2**64
        out.append(state ^ (state >> 33))
    out[225] = datasets.NEEDLE
    assert [x % 2**64 for x in column(datasets.lcg(spark, 300, 43, chunk=64), "v")] == out


def test_dense_positions_with_ties_and_nulls(spark):
    rows = [(None if k % 7 == 0 else k % 3, k) for k in range(200)]
    df = spark.createDataFrame(rows, "a int, b long").repartition(5)
    got = {r.b: r.idx for r in ordered.with_index(df, "a", "b").collect()}
    assert got == {b: n for n, (_, b) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])))}
    assert ordered.with_index(df.limit(0), "a").count() == 0


def test_checksum_depends_on_order(spark):
    fold = lambda values: __import__("functools").reduce(lambda a, v: (a * ordered.CHECKSUM_PRIME % 2**64) ^ (v % 2**64), values, ordered.CHECKSUM_OFFSET)
    for values in ([], [5], [3, -1, 2**40, 0], list(range(300))):
        df = datasets.array(spark, values).repartition(4)
        assert ordered.checksum(df, "idx", "v").first()[0] % 2**64 == fold(values)


def test_sorted_frames_merge(spark):
    parts = [datasets.array(spark, v).orderBy("v") for v in ([1, 5, 9], [], [2, 5, 7])]
    assert [r.v for r in ordered.merge_sorted(parts, F.col("v")).collect()] == [1, 2, 5, 5, 7, 9]
