"""The benchmark workloads as DataFrames and task graphs."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import kernels
from lodestone.plans.graph import Flow
from lodestone.plans.runner import Executor


def async_tasks(executor: Executor, n: int) -> int:
    """n tasks that do nothing; how many ended."""
    return sum(h.wait() for h in [executor.async_task(lambda: 1) for _ in range(n)])


def binary_tree(levels: int) -> Flow:
    flow = Flow("binary_tree")
    nodes = [flow.spawn(lambda: None) for _ in range(2**levels - 1)]
    for k, n in enumerate(nodes):
        n.precede(*nodes[2 * k + 1 : 2 * k + 3])
    return flow


def linear_chain(n: int, body: Callable[[], object] = lambda: None) -> Flow:
    flow = Flow("linear_chain")
    nodes = [flow.spawn(body) for _ in range(n)]
    for a, b in zip(nodes, nodes[1:], strict=False):
        a.precede(b)
    return flow


def wavefront_graph(rows: int, cols: int, cell: Callable[[int, int], object]) -> Flow:
    """A grid in which each cell waits for the one above and the one to the left."""
    flow = Flow("wavefront")
    grid = [[flow.spawn(lambda i=i, j=j: cell(i, j)) for j in range(cols)] for i in range(rows)]
    for i in range(rows):
        for j in range(cols):
            grid[i][j].precede(*([grid[i][j + 1]] if j + 1 < cols else []), *([grid[i + 1][j]] if i + 1 < rows else []))
    return flow


def wavefront(spark: SparkSession, executor: Executor, size: int, block: int = 8) -> DataFrame:
    """The sum of i + j over all blocks of a grid, each added by its own task once those above and to the left have ended."""
    n, added = math.ceil(size / block), []
    executor.run(wavefront_graph(n, n, lambda i, j: added.append(i + j))).wait()
    return spark.createDataFrame([(sum(added), len(added))], "total long, n_tasks long")


def fibonacci(spark: SparkSession, n: int) -> DataFrame:
    return spark.sql(f"with recursive f(k, a, b) max recursion level {n + 10} as (select 0, 0L, 1L union all select k + 1, b, a + b from f where k < {n}) select max(a) as fib from f where k = {n}")


def primes(spark: SparkSession, limit: int) -> DataFrame:
    """How many primes are below limit."""
    return spark.range(limit).where(kernels.is_prime(F.col("id"))).agg(F.count("*").alias("n_primes"))


def nqueens(spark: SparkSession, n: int) -> DataFrame:
    """Solutions, by extending all partial boards a row at a time; the frontier is a DataFrame."""
    boards = spark.createDataFrame([([],)], "q array<int>")
    for row in range(n):
        safe = F.forall(F.sequence(F.lit(0), F.lit(row - 1)), lambda r: (F.get("q", r) != F.col("c")) & (F.abs(F.get("q", r) - F.col("c")) != row - r)) if row else F.lit(True)
        boards = boards.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).where(safe).select(F.concat("q", F.array("c")).alias("q"))
    return boards.agg(F.count("*").alias("n_solutions"))


def skynet(spark: SparkSession, depth: int) -> DataFrame:
    return spark.range(10**depth).agg(F.sum("id").alias("total"))


def mandelbrot(spark: SparkSession, width: int, height: int, degree: int = 2) -> DataFrame:
    pixels = spark.range(width * height).select((F.col("id") % width).alias("x"), F.floor(F.col("id") / width).alias("y"))
    at = pixels.select("x", "y", (F.lit(-2.5) + F.lit(3.5) / width * F.col("x")).alias("re"), (F.lit(-1.0) + F.lit(2.0) / height * F.col("y")).alias("im"))
    return at.select("x", "y", kernels.escape_time(degree)("re", "im").alias("n")).withColumn("colour", kernels.palette(F.col("n")))


def matrix_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v) of the product of matrices in (i, k, v) and (k, j, v) form; terms are summed in each task first."""
    left, right = a.select("i", "k", F.col("v").alias("va")), b.select("k", "j", F.col("v").alias("vb"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("va") * F.col("vb")).alias("v"))


def integrate(spark: SparkSession, start: float, end: float, epsilon: float = 1e-9) -> DataFrame:
    """The integral of (x * x + 1) * x by adaptive trapezoids: all intervals of a depth are halved at once."""
    f = lambda x: (x * x + 1) * x
    parts = spark.createDataFrame([(float(start), float(end))], "a double, b double")
    total, before = 0.0, None
    x = lambda c: F.col(c)
    while True:
        half = (x("b") - x("a")) / 2
        middle = x("a") + half
        whole = (f(x("a")) + f(x("b"))) / 2 * (x("b") - x("a"))
        halves = (f(x("a")) + f(middle)) / 2 * half + (f(middle) + f(x("b"))) / 2 * half
        tried = parts.select("a", "b", middle.alias("m"), halves.alias("area"), (F.abs(halves - whole) < epsilon).alias("done")).persist()
        done, left = tried.agg(F.sum(F.when(x("done"), x("area"))), F.count(F.when(~x("done"), 1))).first()
        total += done or 0.0
        if before is not None:
            before.unpersist()
        before = tried
        if not left:
            tried.unpersist()
            return spark.createDataFrame([(total,)], "area double")
        parts = tried.where("not done").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("m").alias("a"), "b"))).alias("p")).select("p.a", "p.b")


def graph_levels(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node and level: the least number of edges from a root, breadth first, one join a level."""
    seen = roots.select("node", F.lit(0).alias("level"))
    front, level = seen, 0
    while front.limit(1).count():
        level += 1
        front = edges.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("level", F.lit(level)).checkpoint()
        seen = seen.unionByName(front)
    return seen


def graph_carry(edges: DataFrame, length: int, levels: int) -> DataFrame:
    """node and value: the node's work plus the values of its predecessors, level by level."""
    spark = edges.sparkSession
    values = everything = None
    for k in range(levels):
        own = spark.range(k * length, (k + 1) * length).select(F.col("id").alias("node"), kernels.matrix_work(F.col("id")).cast("long").alias("work"))
        if values is None:
            now = own.select("node", F.col("work").alias("value"))
        else:
            carried = edges.join(values.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("value").alias("carry"))
            now = own.join(carried, "node", "left").select("node", (F.col("work") + F.coalesce("carry", F.lit(0))).alias("value"))
        everything = now if everything is None else everything.unionByName(now)
        values = now
    return everything


def data_stages(spark: SparkSession, tokens: int) -> DataFrame:
    """Eight typed stages over tokens: int, float, int, text, int, array, int, int."""
    def powered(n: int, power: int, whole: bool):
        def run(x: pd.Series) -> pd.Series:
            v = x.to_numpy(np.float64)
            for _ in range(n):
                v = (np.cos(v) * v + 1) ** power
                if whole:
                    v = np.fmod(np.trunc(np.clip(np.nan_to_num(v, nan=0.0), -(2.0**31), 2.0**31 - 1)), 2147483647)
                else:
                    v = v.astype(np.float32).astype(np.float64)
            return pd.Series(v.astype(np.int64) if whole else v)

        return run

    whole, real = F.pandas_udf(powered(100, 5, True), "long"), F.pandas_udf(powered(100, 4, False), "double")
    df = spark.range(tokens).select(F.col("id").alias("token"), F.col("id").alias("v"))
    df = df.select("token", whole("v").cast("float").alias("v"))
    df = df.select("token", kernels.clamp_int(real(F.col("v").cast("double"))).alias("v"))
    df = df.select("token", whole(F.col("v").cast("long")).cast("string").alias("v"))
    df = df.select("token", (kernels.lenient_int(F.col("v")).cast("long") + 50).alias("v"))
    df = df.select("token", F.array(whole("v")).alias("v"))
    df = df.select("token", whole(F.col("v")[0]).alias("v"))
    return df.select("token", whole("v").alias("v"))
