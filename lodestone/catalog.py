"""Every query of the engine by name, with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import workloads
from lodestone.functions import intmath, kernels
from lodestone.operators import ordered
from lodestone.plans import chunks
from lodestone.plans.graph import Flow
from lodestone.plans.observe import TraceObserver
from lodestone.plans.runner import Executor
from lodestone.sources import datasets
from lodestone.streaming import pipeline

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CENTS = "cast(round(value * 100) as bigint)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx and v, the value in cents."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), F.round(F.col("value") * 100).cast("long").alias("v"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("long").alias("v"))


LINES = "(select l_orderkey, l_partkey, l_linenumber, cast(round(l_extendedprice * 100) as bigint) as v from lineitem)"
EVENTS = f"(select event_id as idx, {CENTS} as v from events)"


@query(f"select idx, v * 2 + 1 as value from {EVENTS}")
def prj1_transform(spark, d):
    return ordered.transform(events(spark, d), "idx", value=F.col("v") * 2 + 1)


@query(f"select idx, cast(case when r >= 9223372036854775808 then r - 18446744073709551616 else r end as bigint) as value from (select idx, ((cast(v as hugeint) * 128) % 18446744073709551616 + (cast(v as hugeint) // 144115188075855872) + 2654435769) % 18446744073709551616 as r from {EVENTS})")
def prj1_transform_scramble(spark, d):
    return ordered.transform(events(spark, d), "idx", value=kernels.scramble(F.col("v")))


@query(f"select idx, v * v % 1009 as value from {EVENTS}")
def prj1_transform_batches(spark, d):
    return ordered.transform_batches(events(spark, d), "idx", "v", lambda v: v * v % 1009, "long")


@query("select i as idx, i * i as value from range(0, 5000) t(i)")
def prj2_parallel_for(spark, d):
    return ordered.parallel_for(spark, 0, 5000, value=F.col("idx") * F.col("idx"))


@query("select event_id, round(tan(value), 6) as value from events")
def prj3_for_each(spark, d):
    return ordered.for_each(table(spark, d, "events").select("event_id", "value"), value=F.round(F.tan("value"), 6))


@query(f"select min(idx) as idx from {EVENTS} where v > 9000")
def flt1_find_first(spark, d):
    return ordered.find(events(spark, d), "idx", F.col("v") > 9000)


@query(f"select min(idx) as idx from {EVENTS} where v < -1")
def flt1_find_none(spark, d):
    return ordered.find(events(spark, d), "idx", F.col("v") < -1)


@query(f"select idx, v from {EVENTS} where v % 1000 = 0 order by idx limit 1")
def flt1_find_row(spark, d):
    return ordered.find_row(events(spark, d), "idx", F.col("v") % 1000 == 0)


@query("select count(*) as n_primes from range(0, 100000) t(i) where i >= 2 and not exists (select 1 from range(2, 317) s(k) where k < i and k * k <= i and i % k = 0)")
def flt2_primes(spark, d):
    return workloads.primes(spark, 100000)


_REDUCED = {"sum": ("cast(7 + sum(v) as bigint)", 7), "min": ("least(5000, min(v))", 5000), "max": ("greatest(5000, max(v))", 5000), "bit_xor": ("xor(12345, bit_xor(v))", 12345), "bit_and": ("1048575 & bit_and(v)", 1048575), "bit_or": ("1 | bit_or(v)", 1), "count": ("cast(3 + count(v) as bigint)", 3)}


def _reduced(name: str, init: int):
    return lambda spark, d: ordered.reduce(lines(spark, d), "v", ordered.MONOIDS[name], F.lit(init).cast("long"))


for _name, (_sql, _init) in _REDUCED.items():
    _QUERIES[f"agg1_reduce_{_name}"] = _reduced(_name, _init)
    _SQL[f"agg1_reduce_{_name}"] = f"select cast({_sql} as bigint) as value from {LINES}"


@query(f"select cast(case when s >= 9223372036854775808 then s - 18446744073709551616 else s end as bigint) as value from (select sum(cast(v as hugeint) * 1000000007 * 999999937 % 9223372036854775783) % 18446744073709551616 as s from {LINES})")
def agg1_reduce_wrapping_sum(spark, d):
    big = F.col("v").cast("decimal(38,0)") * F.lit(1000000007 * 999999937).cast("decimal(20,0)") % F.lit("9223372036854775783").cast("decimal(38,0)")
    return ordered.reduce(lines(spark, d).select(big.cast("long").alias("v")), "v", ordered.WRAPPING_SUM, 0)


@query("select string_agg(n_name, '' order by n_nationkey) as value from nation")
def agg1_reduce_ordered_text(spark, d):
    return ordered.reduce_ordered_text(table(spark, d, "nation"), "n_nationkey", "n_name", block=4)


@query("select '>' || string_agg(n_name, '' order by n_nationkey) as value from nation")
def agg1_reduce_opaque(spark, d):
    return ordered.reduce_opaque(table(spark, d, "nation"), "n_nationkey", "n_name", lambda a, b: a + b, ">", "string", block=4)


@query("select cast(42 as bigint) as value")
def agg1_reduce_empty(spark, d):
    return ordered.reduce(events(spark, d).where("idx < 0"), "v", ordered.SUM, F.lit(42).cast("long"))


@query(f"select cast(sum(v) as bigint) as value from {LINES}")
def agg2_reduce_dynamic(spark, d):
    return ordered.reduce(lines(spark, d).repartition(16), "v", ordered.SUM, F.lit(0).cast("long"))


@query("select event_type, count(*) as n, cast(sum(cast(round(value * 100) as bigint)) as bigint) as total from events group by event_type")
def agg3_fan_out(spark, d):
    """A counter and a sum by many tasks: partial aggregates, not shared state."""
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("total"))


@query(f"select idx, cast(sum(v) over (order by idx) as bigint) as value from {EVENTS}")
def win1_inclusive_scan_sum(spark, d):
    return ordered.inclusive_scan(events(spark, d), "idx", "v", ordered.SUM, block=1024)


@query(f"select idx, max(v) over (order by idx) as value from {EVENTS}")
def win1_inclusive_scan_max(spark, d):
    return ordered.inclusive_scan(events(spark, d), "idx", "v", ordered.MAX)


@query(f"select idx, min(v) over (order by idx) as value from {EVENTS}")
def win1_inclusive_scan_min(spark, d):
    return ordered.inclusive_scan(events(spark, d), "idx", "v", ordered.MIN, block=1024, levels=3)


@query(f"select idx, cast(count(v) over (order by idx) as bigint) as value from {EVENTS}")
def win1_inclusive_scan_count(spark, d):
    return ordered.inclusive_scan(events(spark, d), "idx", "v", ordered.COUNT, block=512)


@query(f"select idx, cast(7 + coalesce(sum(v) over (order by idx rows between unbounded preceding and 1 preceding), 0) as bigint) as value from {EVENTS}")
def win2_exclusive_scan_sum(spark, d):
    return ordered.exclusive_scan(events(spark, d), "idx", "v", ordered.SUM, 7, block=1024)


@query(f"select idx, greatest(3000, coalesce(max(v) over (order by idx rows between unbounded preceding and 1 preceding), 0)) as value from {EVENTS}")
def win2_exclusive_scan_max(spark, d):
    return ordered.exclusive_scan(events(spark, d), "idx", "v", ordered.MAX, F.lit(3000).cast("long"), block=1024)


def _products(source: str, levels: int) -> str:
    """Running products of idx, v modulo 2**32 as signed numbers: each level multiplies by the product that ends where the level's span begins."""
    steps = [f"p0 as materialized (select idx, cast((cast(v as hugeint) % 4294967296 + 4294967296) % 4294967296 as hugeint) as p from {source})"]
    for k in range(levels):
        steps.append(f"p{k + 1} as materialized (select a.idx, a.p * coalesce(b.p, 1) % 4294967296 as p from p{k} a left join p{k} b on b.idx = a.idx - {1 << k})")
    return "with " + ", ".join(steps) + f" select idx, cast(case when p >= 2147483648 then p - 4294967296 else p end as int) as value from p{levels}"


@query(_products(f"(select idx, v * 2 + 1 as v from {EVENTS})", 18))
def win3_scan_wrapping_product(spark, d):
    x = events(spark, d).select("idx", (F.col("v") * 2 + 1).cast("int").alias("v"))
    return ordered.scan_opaque(x, "idx", "v", lambda a: np.multiply.accumulate(a.astype(np.int32), dtype=np.int32), lambda c, a: (a * c).astype(np.int32), block=1024)


@query(f"select idx, cast(sum(v) over (order by idx) as bigint) as value from {EVENTS}")
def win3_scan_opaque_sum(spark, d):
    return ordered.scan_opaque(events(spark, d), "idx", "v", np.cumsum, lambda c, a: a + c, block=1000)


ORDERS = "(select o_orderkey, cast(round(o_totalprice * 100) as bigint) as v from orders)"


def _ranked(df: DataFrame, *by: str) -> DataFrame:
    _checkpoint_dir(df.sparkSession)
    return ordered.with_index(df, *by)


@query(f"select o_orderkey, v, row_number() over (order by v, o_orderkey) - 1 as idx from {ORDERS}")
def srt1_sort_rank(spark, d):
    return _ranked(table(spark, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("v")), "v", "o_orderkey")


@query(f"select o_orderkey, v from {ORDERS}")
def srt1_sort(spark, d):
    return ordered.sort(table(spark, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("v")), "v", "o_orderkey")


@query(f"select o_orderkey, -v as key, row_number() over (order by v % 100 desc, o_orderkey) - 1 as idx from {ORDERS}")
def srt2_sort_by(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("v"))
    keyed = x.select("o_orderkey", (-F.col("v")).alias("key"), (-(F.col("v") % 100)).alias("by"))
    return _ranked(keyed, "by", "o_orderkey").drop("by")


@query(f"select o_orderkey, w, row_number() over (order by case when w < 0 then 1 else 0 end, w, o_orderkey) - 1 as idx from (select o_orderkey, case when o_orderkey % 3 = 0 then -v else v end as w from {ORDERS})")
def srt1_sort_unsigned(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("v"))
    x = x.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, -F.col("v")).otherwise(F.col("v")).alias("w"))
    return _ranked(x.withColumn("by", intmath.unsigned_key(F.col("w"))), "by", "o_orderkey").drop("by")


@query("select r_regionkey, list_sort(list(n_nationkey), 'desc')[1] as first_key, count(*) as n from region join nation on r_regionkey = n_regionkey group by r_regionkey")
def srt2_sort_array_by(spark, d):
    got = table(spark, d, "region").join(table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).groupBy("r_regionkey").agg(F.collect_list("n_nationkey").alias("a"))
    return got.select("r_regionkey", ordered.sort_array_by(F.col("a"), lambda x, y: (y - x).cast("int"))[0].alias("first_key"), F.size("a").cast("long").alias("n"))


@query("select k as chunk_id, k * 313 as start, least((k + 1) * 313, 10000) as \"end\" from range(0, 32) t(k)")
def pt1_chunks_auto(spark, d):
    return chunks.auto(spark, 10000, 8)


@query("select k as chunk_id, k * 1024 as start, least((k + 1) * 1024, 10000) as \"end\" from range(0, 10) t(k)")
def pt4_chunks_dynamic(spark, d):
    return chunks.dynamic(spark, 10000, 1024)


@query("select k as chunk_id, k * 1428 + least(k, 4) as start, (k + 1) * 1428 + least(k + 1, 4) as \"end\" from range(0, 7) t(k)")
def pt2_chunks_balanced(spark, d):
    return chunks.balanced(spark, 10000, 7)


@query("select * from (values (0::bigint, 0::bigint, 10::bigint), (1::bigint, 10::bigint, 25::bigint)) t(chunk_id, start, \"end\")")
def pt3_chunks_static(spark, d):
    return chunks.static(spark, [(0, 10), (10, 25)])


@query("with recursive c(k, a, b) as (select cast(0 as bigint), cast(0 as bigint), cast(5000 as bigint) union all select k + 1, b, b + least(greatest((10000 - b) // 2, 16), 10000 - b) from c where b < 10000) select k as chunk_id, a as start, b as \"end\" from c")
def pt5_chunks_guided(spark, d):
    return chunks.guided(spark, 10000, 16)


@query("select event_id // 500 as chunk_id, count(*) as n from events group by 1")
def pt4_chunk_counts(spark, d):
    return chunks.assign(table(spark, d, "events"), "event_id", 500).groupBy("chunk_id").agg(F.count("*").alias("n"))


def nation_flow() -> Flow:
    """nation -> region edges by key, as a fixed tree: a root, 5 regions and 25 nations."""
    flow = Flow("nations")
    root = flow.placeholder("root")
    regions = [flow.spawn(lambda: None, f"r{k}") for k in range(5)]
    root.precede(*regions)
    for k in range(25):
        regions[k % 5].precede(flow.spawn(lambda: None, f"n{k}"))
    return flow


@query("select 31 as num_tasks, 30 as num_edges, 1 as num_roots, 25 as num_leaves")
def g7_graph_summary(spark, d):
    s = nation_flow().inspect().summary
    return spark.createDataFrame([(s.num_tasks, s.num_edges, s.num_roots, s.num_leaves)], "num_tasks int, num_edges int, num_roots int, num_leaves int")


@query("select cast(k as int) as task_id from range(6, 31) t(k)")
def g7_graph_leaves(spark, d):
    flow = nation_flow()
    return flow.nodes_df(spark).select("task_id").join(flow.edges_df(spark).select(F.col("src").alias("task_id")), "task_id", "left_anti")


@query("select cast(k as int) as task_id from (values (1), (2), (3)) t(k)")
def g9_graph_cycle_nodes(spark, d):
    flow = Flow()
    a, b, c, e = (flow.spawn(lambda: None) for _ in range(4))
    a.precede(b)
    b.precede(c)
    c.precede(b, e)
    return spark.createDataFrame([(k,) for k in flow.cycle_nodes()], "task_id int")


@query("select c_custkey as node, 1 as level from customer union all select o_orderkey + 100000000, 2 from orders union all select -1, 0")
def w9_graph_traversal(spark, d):
    _checkpoint_dir(spark)
    customers = table(spark, d, "customer").select(F.lit(-1).cast("long").alias("src"), F.col("c_custkey").alias("dst"))
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + 100000000).alias("dst"))
    return workloads.graph_levels(customers.unionByName(orders), spark.createDataFrame([(-1,)], "node long"))


def _shared_dir(spark) -> str:
    """The folder that the driver and all executors share; only in local mode a temporary one where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        found = tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _checkpoint_dir(spark) -> None:
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(_shared_dir(spark))


def _totals(spark, d, where: str) -> DataFrame:
    return table(spark, d, "events").where(where).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("total"))


_TOTAL = f"count(*) as n, cast(sum({CENTS}) as bigint) as total"


@query(f"select {_TOTAL} from events where event_type = 'click'")
def c1_flow_condition(spark, d):
    """A condition reads a scalar and chooses which successor builds the result."""
    executor, flow = Executor(2, spark), Flow()
    choose = flow.spawn_condition(lambda: int(table(spark, d, "events").where("event_type = 'click'").limit(1).count() == 0))
    choose.precede(flow.spawn(lambda: _totals(spark, d, "event_type = 'click'"), "out"), flow.spawn(lambda: _totals(spark, d, "true"), "out"))
    flow.spawn(lambda: None).precede(choose)
    return executor.run(flow).wait().results["out"]


@query(f"select event_type, {_TOTAL} from events where event_type in ('click', 'view') group by event_type")
def c2_flow_multi_condition(spark, d):
    executor, flow = Executor(2, spark), Flow()
    kinds = ["click", "error", "view"]
    choose = flow.spawn_multi_condition(lambda: [0, 2])
    choose.precede(*[flow.spawn(lambda k=k: _totals(spark, d, f"event_type = '{k}'").select(F.lit(k).alias("event_type"), "n", "total"), k) for k in kinds])
    flow.placeholder().precede(choose)
    results = executor.run(flow).wait().results
    return results["click"].unionByName(results["view"])


@query("select 5 as rounds")
def c3_flow_loop(spark, d):
    executor, flow, seen = Executor(2, spark), Flow(), []
    body = flow.spawn(lambda: seen.append(1))
    again = flow.spawn_condition(lambda: 0 if len(seen) < 5 else 1)
    flow.placeholder().precede(body)
    body.precede(again)
    again.precede(body, flow.placeholder())
    executor.run(flow).wait()
    return spark.createDataFrame([(len(seen),)], "rounds int")


@query(f"select {_TOTAL} from events where event_type <> 'error'")
def c4_flow_subflow(spark, d):
    executor, flow, kept = Executor(2, spark), Flow(), []

    def build(inner):
        first = inner.spawn(lambda: kept.append("event_type <> 'error'"))
        first.precede(inner.placeholder())

    flow.spawn_subflow(build).precede(flow.spawn(lambda: _totals(spark, d, kept[0]), "out"))
    return executor.run(flow).wait().results["out"]


@query(f"select user_id % 3 as part, {_TOTAL} from events group by 1")
def c5_flow_compose(spark, d):
    """An inner flow, run three times by the outer one, decides into how many parts all events are totalled."""
    executor, inner, flow, seen = Executor(1, spark), Flow("inner"), Flow("outer"), []
    inner.spawn(lambda: seen.append(1))
    parts = [flow.compose(inner) for _ in range(3)]
    total = lambda: table(spark, d, "events").groupBy((F.col("user_id") % sum(seen)).alias("part")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("total"))
    flow.spawn(total, "out").succeed(*parts)
    return executor.run(flow).wait().results["out"]


@query("select 4 as n_runs, 3 as until_runs")
def r3_flow_run_n_and_until(spark, d):
    executor, flow, seen = Executor(2, spark), Flow(), []
    flow.spawn(lambda: seen.append(1))
    executor.run_n(flow, 4).wait()
    n = len(seen)
    executor.run_until(flow, lambda: len(seen) >= 7).wait()
    return spark.createDataFrame([(n, len(seen) - n)], "n_runs int, until_runs int")


@query("select l_returnflag, count(*) as n from lineitem group by l_returnflag")
def a6_async_fan_in(spark, d):
    executor = Executor(4, spark)
    count = lambda f: table(spark, d, "lineitem").where(F.col("l_returnflag") == f).count()
    flags = [r[0] for r in table(spark, d, "lineitem").select("l_returnflag").distinct().collect()]
    handles = {f: executor.async_task(lambda f=f: count(f)) for f in flags}
    return spark.createDataFrame([(f, h.wait()) for f, h in handles.items()], "l_returnflag string, n long")


@query("select 3 as n, 'abc' as order_run")
def a8_dependent_chain(spark, d):
    executor, seen = Executor(3, spark), []
    a = executor.silent_dependent_async(lambda: seen.append("a"))
    b = executor.silent_dependent_async(lambda: seen.append("b"), a)
    executor.dependent_async(lambda: seen.append("c"), a, b)[1].wait()
    return spark.createDataFrame([(len(seen), "".join(seen))], "n int, order_run string")


@query("select 55 as fib")
def a9_task_group_fibonacci(spark, d):
    executor = Executor(1, spark)

    def fib(n: int) -> int:
        if n < 2:
            return n
        out, group = {}, executor.task_group()
        group.silent_async(lambda: out.__setitem__("a", fib(n - 1)))
        out["b"] = fib(n - 2)
        group.corun()
        return out["a"] + out["b"]

    return spark.createDataFrame([(executor.async_task(lambda: fib(10)).wait(),)], "fib int")


@query("select t as token, cast(t % 4 as int) as line, t * 3 + 1 as value from range(0, 100) r(t)")
def p1_pipeline(spark, d):
    pipe = pipeline.Pipeline(spark, 4, [pipeline.Pipe.serial(pipeline.project(value=F.col("token") * 3)), pipeline.Pipe.parallel(pipeline.project(value=F.col("value") + 1))])
    return pipe.frame(100)


@query("select t as token, t * t as value from range(0, 37) r(t)")
def p3_pipeline_stop_token(spark, d):
    source = lambda c: c.stop() if c.token == 37 else c.token * c.token
    return pipeline.DataPipeline(spark, 3).source(source, "long").build().frame().select("token", "value")


@query(f"select idx as token, 'v' || v as value from {EVENTS}")
def p5_pipeline_typed(spark, d):
    rows = events(spark, d).select(F.col("idx").alias("token"), F.col("v").alias("value"))
    return pipeline.DataPipeline(spark).source_frame(rows).stage(pipeline.project(value=F.concat(F.lit("v"), F.col("value").cast("string")))).build().frame()


@query(f"select idx as token, v, cast(sum(v) over (order by idx) as bigint) as carried from {EVENTS}")
def p6_pipeline_serial_carry(spark, d):
    rows = events(spark, d).select(F.col("idx").alias("token"), "v")
    return pipeline.DataPipeline(spark).source_frame(rows).stage(pipeline.running("v", ordered.SUM, "carried"), pipeline.SERIAL).build().frame()


@query("select t as token, cast(t % 2 as int) as line, -t as value from range(0, 20) r(t)")
def p4_scalable_pipeline(spark, d):
    pipe = pipeline.ScalablePipeline(spark, 4)
    pipe.reset_with_lines_and_pipes(2, [pipeline.Pipe.serial(pipeline.project(value=-F.col("token")))])
    return pipe.frame(20)


@query(f"select event_id as token, {CENTS} * 2 as value from events")
def p5_pipeline_stream(spark, d):
    """The stages of a batch pipeline on a file stream, run until all that is there is read."""
    import uuid

    base = f"{_shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = table(spark, d, "events")
    rows = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(d) if not d.endswith("/events.parquet") else None
    rows = rows.select(F.col("event_id").alias("token"), F.round(F.col("value") * 100).cast("long").alias("value"))
    flow = pipeline.DataPipeline(spark).source_frame(rows).stage(lambda df: df.select("token", (F.col("value") * 2).alias("value"))).build()
    flow.stream(f"{base}/state", lambda df, k: df.write.mode("append").parquet(f"{base}/out")).awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query("select 'task-0' as name, 1 as n union all select 'named', 2")
def o2_trace_summary(spark, d):
    executor, flow, trace = Executor(2, spark), Flow(), TraceObserver()
    executor.add_observer(trace)
    flow.spawn(lambda: None).precede(flow.spawn(lambda: None, "named"), flow.spawn(lambda: None, "named"))
    executor.run(flow).wait()
    return trace.to_df(spark).groupBy("name").agg(F.count("*").cast("int").alias("n"))


@query("select 4 as nodes, 4 as executed, 4 as decrements, 3 as ready")
def o3_profile_counts(spark, d):
    executor, flow = Executor(4), Flow()
    root, left, right, join = flow.placeholder(), flow.spawn(lambda: None), flow.spawn(lambda: None), flow.spawn(lambda: None)
    root.precede(left, right)
    join.succeed(left, right)
    flow.set_profile_enabled(True)
    executor.run(flow).wait()
    p = flow.last_profile
    return spark.createDataFrame([(p.snapshot_nodes, p.graph_tasks_executed, p.graph_pending_decrements, p.graph_ready_successors)], "nodes int, executed int, decrements int, ready int")


@query("select 1023 as n_tasks")
def w2_binary_tree(spark, d):
    executor, flow = Executor(4), workloads.binary_tree(10)
    flow.set_profile_enabled(True)
    executor.run(flow).wait()
    return spark.createDataFrame([(flow.last_profile.graph_tasks_executed,)], "n_tasks int")


_D1 = "((ln(s / 40.0) + (0.05 + 0.2 * 0.2 / 2) * 0.5) / (0.2 * sqrt(0.5)))"


def _cdf(x: str) -> str:
    k = f"(1 / (1 + 0.2316419 * abs({x})))"
    poly = f"{k} * (0.319381530 + {k} * (-0.356563782 + {k} * (1.781477937 + {k} * (-1.821255978 + {k} * 1.330274429))))"
    upper = f"(1 - {poly} * 0.39894228040143270286 * exp(-0.5 * {x} * {x}))"
    return f"(case when {x} < 0 then 1 - {upper} else {upper} end)"


@query(f"select event_id, round(s * {_cdf('d1')} - 40 * exp(-0.05 * 0.5) * {_cdf('d2')}, 4) as price from (select event_id, s, {_D1} as d1, {_D1} - 0.2 * sqrt(0.5) as d2 from (select event_id, value + 20 as s from events))")
def w3_black_scholes(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("value") + 20).alias("s"))
    return e.select("event_id", F.round(kernels.black_scholes(F.col("s"), F.lit(40.0), F.lit(0.05), F.lit(0.2), F.lit(0.5), F.lit(False)), 4).alias("price"))


def _stages() -> str:
    """The eight stages, each a hundred rounds of powers of cosines; beyond a float's range is infinity, whose cosine is no number."""
    whole = "trunc(greatest(least(pow(cos(v) * v + 1, 5), 2147483647.0), -2147483648.0)) % 2147483647.0"
    real = "case when isnan(v) or isinf(v) then 'nan'::double when pow(cos(v) * v + 1, 4) > 3.4028235e38 then 'inf'::double else cast(cast(pow(cos(v) * v + 1, 4) as float) as double) end"
    starts = ["cast(t as double) from range(0, 256) r(t)", "cast(cast(v as float) as double)", "case when isnan(v) then 0.0 else trunc(greatest(least(v, 2147483647.0), -2147483648.0)) end", "v + 50", "v", "v"]
    parts = []
    for k, (start, step) in enumerate(zip(starts, (whole, real, whole, whole, whole, whole), strict=True)):
        source = start if k == 0 else f"{start} from s{k - 1} where k = 100"
        parts.append(f"s{k}(t, k, v) as (select t, 0, {source} union all select t, k + 1, {step} from s{k} where k < 100)")
    return "with recursive " + ", ".join(parts) + " select t as token, cast(v as bigint) as v from s5 where k = 100"


@query(_stages())
def w4_data_pipeline(spark, d):
    return workloads.data_stages(spark, 256)


@query("select 1000 as n")
def w1_async_tasks(spark, d):
    return spark.createDataFrame([(workloads.async_tasks(Executor(4), 1000),)], "n int")


_START = "cast(xor(cast(cast(event_id as hugeint) * 1315423911 % 18446744073709551616 as ubigint), cast(event_id >> 3 as ubigint)) as double) + 1.0"


@query(f"with recursive r(event_id, k, x, s) as (select event_id, 0, {_START}, 0::double from events union all select event_id, k + 1, sin(x) * 1.0000001 + cos(x), s + (sin(x) * 1.0000001 + cos(x)) from r where k < 32) select event_id, round(s, 6) as value from r where k = 32")
def w5_embarrassing(spark, d):
    return table(spark, d, "events").select("event_id", F.round(kernels.sine_rounds(F.col("event_id")), 6).alias("value"))


@query("select cast(6765 as bigint) as fib")
def w6_fibonacci(spark, d):
    return workloads.fibonacci(spark, 20)


def _drawn(length: int, levels: int) -> str:
    """src and dst of the layered graph."""
    start = "(((src + 1) * 16807 % 2147483647 + 7) * 48271 % 2147483647) * 48271 % 2147483647"
    steps = f"s0 as (select src, {start} as x0 from range(0, {length * (levels - 1)}) t(src))"
    for k in range(1, 5):
        steps += f", s{k} as (select *, x{k - 1} * 48271 % 2147483647 as x{k} from s{k - 1})"
    return f"{steps}, edges as (select distinct src, (src // {length} + 1) * {length} + p % {length} as dst from (select src, unnest(list_slice([x1, x2, x3, x4], 1, 1 + x0 % 4)) as p from s4))"


def _carried(length: int, levels: int) -> str:
    work = "(select sum((i + k - m % 10) * (k - j + m % 10)) % 999 from range(0, 16) a(i), range(0, 16) b(k), range(0, 16) c(j))"
    parts = [f"with {_drawn(length, levels)}, w as (select m as node, (({work} + 999) % 999)::bigint as work from range(0, {length * levels}) n(m))", f"l0 as (select node, work as value from w where node < {length})"]
    for k in range(1, levels):
        parts.append(f"l{k} as (select w.node, w.work + coalesce(c.carry, 0) as value from (select * from w where node // {length} = {k}) w left join (select dst, sum(value) as carry from edges join l{k - 1} on src = node group by dst) c on c.dst = w.node)")
    return ", ".join(parts) + " " + " union all ".join(f"select node, cast(value as bigint) as value from l{k}" for k in range(levels))


@query(_carried(32, 6))
def w8_graph_pipeline(spark, d):
    return workloads.graph_carry(datasets.level_graph(spark, 32, 6), 32, 6)


@query("select cast(2550 as double) as area")
def w10_integrate(spark, d):
    """The exact integral is 2,550; its error of some 1e-5 is rounded away."""
    return workloads.integrate(spark, 0.0, 10.0, 1e-9).select(F.round("area", 4).alias("area"))


@query("select 500 as n")
def w11_linear_chain(spark, d):
    seen = []
    Executor(2).run(workloads.linear_chain(500, lambda: seen.append(1))).wait()
    return spark.createDataFrame([(len(seen),)], "n int")


_COLOURS = "[" + ", ".join("{'r': %d, 'g': %d, 'b': %d}" % c for c in kernels.PALETTE) + "]"
_MANDELBROT = f"""
with recursive c as (select i % 300 as x, i // 300 as y, -2.5::double + 3.5::double / 300 * (i % 300) as re, -1.0::double + 2.0::double / 300 * (i // 300) as im from range(0, 90000) t(i)),
z(x, y, re, im, a, b, n) as (select x, y, re, im, re, im, 0 from c union all select x, y, re, im, a * a - b * b + re, a * b + b * a + im, n + 1 from z where n < {kernels.MOST_ITERATIONS} and sqrt(a * a + b * b) <= 2),
e as (select x, y, max(n) as n from z group by x, y),
f as (select x, y, n, case when n < {kernels.MOST_ITERATIONS} and n <> 0 then ({_COLOURS})[n % 16 + 1] else {{'r': 0, 'g': 0, 'b': 0}} end as colour from e)
select x, y, n, colour.r as r, colour.g as g, colour.b as b from f"""


@query(_MANDELBROT)
def w13_mandelbrot(spark, d):
    return workloads.mandelbrot(spark, 300, 300).select("x", "y", "n", "colour.r", "colour.g", "colour.b")


@query("select a.i as i, b.j as j, cast(sum((a.i + a.k) * (b.k - b.j)) as bigint) as v from (select i, k from range(0, 256) x(i), range(0, 256) y(k)) a join (select k, j from range(0, 256) x(k), range(0, 256) y(j)) b on a.k = b.k group by a.i, b.j")
def w14_matrix_product(spark, d):
    cells = spark.range(256 * 256).select(F.floor(F.col("id") / 256).alias("p"), (F.col("id") % 256).alias("q"))
    return workloads.matrix_product(cells.select(F.col("p").alias("i"), F.col("q").alias("k"), (F.col("p") + F.col("q")).alias("v")), cells.select(F.col("p").alias("k"), F.col("q").alias("j"), (F.col("p") - F.col("q")).alias("v")))


@query("select cast(724 as bigint) as n_solutions")
def w16_nqueens(spark, d):
    return workloads.nqueens(spark, 10)


@query("select cast(49995000 as bigint) as total")
def w20_skynet(spark, d):
    return workloads.skynet(spark, 4)


@query("select 1000 as n")
def w22_thread_pool(spark, d):
    executor, seen = Executor(4), []
    for _ in range(10):
        flow = Flow()
        for _ in range(100):
            flow.spawn(lambda: seen.append(1))
        executor.run(flow).wait()
    return spark.createDataFrame([(len(seen),)], "n int")


@query("select cast(sum(i + j) as bigint) as total, count(*) as n_tasks from range(0, 32) a(i), range(0, 32) b(j)")
def w23_wavefront(spark, d):
    with Executor(4, spark) as executor:
        return workloads.wavefront(spark, executor, 256)


@query("select t % 8 as place, count(*) as n from range(0, 4096) r(t) group by 1")
def src2_range(spark, d):
    return datasets.index_range(spark, 0, 4096).groupBy((F.col("idx") % 8).alias("place")).agg(F.count("*").alias("n"))


@query("select cast(3072 as bigint) as idx")
def src4_lcg_needle(spark, d):
    return ordered.find(datasets.lcg(spark, 4096, 42), "idx", F.col("v") == datasets.NEEDLE - (1 << 64))


@query("select t as token, t * 7 % 11 as v from range(0, 64) r(t)")
def src3_generated(spark, d):
    return datasets.generated(spark, lambda t: int(str(t * 7)) % 11, 64)


@query("select i as idx, round(tan(i / 1000.0), 6) as v from range(0, 2000) t(i)")
def w7_for_each(spark, d):
    return ordered.for_each(spark.range(2000).select(F.col("id").alias("idx"), (F.col("id") / 1000.0).alias("v")), v=F.round(F.tan("v"), 6))


@query("select t as token, cast(t % 8 as int) as line, t + 36 as value from range(0, 256) r(t)")
def w12_linear_pipeline(spark, d):
    """Eight serial stages, each of which adds its place."""
    first = pipeline.Pipe.serial(pipeline.project(value=F.col("token") + 1))
    return pipeline.Pipeline(spark, 8, [first, *(pipeline.Pipe.serial(pipeline.project(value=F.col("value") + k)) for k in range(2, 9))]).frame(256)


_SHUFFLED = "(select i, (i * 48271 + 1234567) % 100003 as v from range(0, 5000) t(i))"


def _shuffled(spark) -> DataFrame:
    return spark.range(5000).select(F.col("id").alias("i"), ((F.col("id") * 48271 + 1234567) % 100003).alias("v"))


@query(f"select i, v / 7.0::double as v, row_number() over (order by v, i) - 1 as idx from {_SHUFFLED}")
def w15_merge_sort(spark, d):
    return _ranked(_shuffled(spark).select("i", (F.col("v") / 7.0).alias("v")), "v", "i")


@query("select cast(0 as double) as value")
def w18_reduce_sum(spark, d):
    return ordered.reduce(spark.range(100_000).select(F.lit(0.0).alias("v")), "v", ordered.SUM, 0.0)


@query(_products(f"(select i as idx, v * 2 + 1 as v from {_SHUFFLED})", 13))
def w19_scan(spark, d):
    odd = _shuffled(spark).select(F.col("i").alias("idx"), (F.col("v") * 2 + 1).cast("int").alias("v"))
    return ordered.scan_opaque(odd, "idx", "v", lambda a: np.multiply.accumulate(a.astype(np.int32), dtype=np.int32), lambda c, a: (a * c).astype(np.int32), block=512)


@query(f"select i, v, row_number() over (order by v, i) - 1 as idx from {_SHUFFLED}")
def w21_sort(spark, d):
    return _ranked(_shuffled(spark), "v", "i")


@query(f"with {_drawn(16, 5)} select src, cast(dst as bigint) as dst from edges")
def src5_level_graph(spark, d):
    return datasets.level_graph(spark, 16, 5)


_NODES = "(select 0 as k, 'root' as name union all select cast(i + 1 as int), 'r' || i from range(0, 5) t(i) union all select cast(i + 6 as int), 'n' || i from range(0, 25) t(i))"
_EDGES = "(select 0 as a, cast(i + 1 as int) as b from range(0, 5) t(i) union all select cast(i % 5 + 1 as int), cast(i + 6 as int) from range(0, 25) t(i))"


@query(f"""select line from (values ('digraph flow {{'), ('  label="nations";'), ('}}')) t(line) union all select '  ' || k || ' [label="' || name || '"];' from {_NODES} union all select '  ' || a || ' -> ' || b || ';' from {_EDGES}""")
def snk3_dot(spark, d):
    return spark.createDataFrame([(x,) for x in nation_flow().dump_dot().splitlines()], "line string")


@query("select 'X' as ph, 'TraceObserver' as cat, 'task-' || k as name, cast(k as int) as task_id from range(0, 3) t(k)")
def snk4_trace_json(spark, d):
    """A Chrome trace, parsed again."""
    with Executor(2) as executor:
        flow, trace = Flow(), TraceObserver()
        executor.add_observer(trace)
        flow.spawn(lambda: None).precede(flow.spawn(lambda: None), flow.spawn(lambda: None))
        executor.run(flow).wait()
    parsed = spark.createDataFrame([(trace.dump(),)], "j string").select(F.explode(F.from_json("j", "array<struct<name:string,cat:string,ph:string,tid:int,ts:bigint,dur:bigint,args:struct<task_id:int>>>")).alias("s"))
    return parsed.where("s.ts >= 0 and s.dur >= 0").select("s.ph", "s.cat", "s.name", "s.args.task_id")


def _harness_report(spark):
    from lodestone import harness

    return harness.run_benchmarks(spark, harness.BenchmarkConfig.for_test())


_DATASET = """with recursive g(k, s) as (select 0, cast(43 as hugeint) union all select k + 1, (s * 6364136223846793005 + 1442695040888963407) % 18446744073709551616 from g where k < 256),
d as (select k - 1 as idx, case when k - 1 = 192 then 11400714819323198485 else xor(s, s // 8589934592) end as v from g where k > 0),"""


def _fold(rows: str) -> str:
    return f"f(k, acc) as (select 0, cast(1469598103934665603 as hugeint) union all select k + 1, xor(acc * 1099511628211 % 18446744073709551616, o.v) from f join {rows} o on o.i = f.k)"


@query(f"""{_DATASET} t as (select idx as i, ((v * 128) % 18446744073709551616 + v // 144115188075855872 + 2654435769) % 18446744073709551616 as v from d), {_fold("t")}
select cast(case when acc >= 9223372036854775808 then acc - 18446744073709551616 else acc end as bigint) as checksum from f where k = 256""")
def agg4_sequence_checksum(spark, d):
    """The order-sensitive digest of a transformed seeded sequence."""
    from lodestone import harness

    return harness.scenario(datasets.lcg(spark, 256, 42), "transform", "expression")


@query("select b as backend, s as scenario, case when b = 'native' then 'unavailable' else 'ok' end as status, case when b = 'native' then 0 else 1 end as n_samples from (values ('expression'), ('arrow'), ('native')) x(b), (values ('transform'), ('reduce'), ('find'), ('inclusive-scan'), ('sort')) y(s)")
def snk5_benchmark_report(spark, d):
    return _harness_report(spark).to_df(spark).groupBy("backend", "scenario", "status").agg(F.count("ms").cast("int").alias("n_samples"))


@query("select b as backend, s as scenario, true as agrees from (values ('expression'), ('arrow')) x(b), (values ('transform'), ('reduce'), ('find'), ('inclusive-scan'), ('sort')) y(s)")
def snk6_comparison_report(spark, d):
    return _harness_report(spark).compared(spark, "expression").select("backend", "scenario", "agrees")


@query("select 'arrow' as backend, 'find' as scenario, cast(48 as bigint) as checksum")
def h4_run_from_args(spark, d):
    from lodestone import harness

    said = harness.run_from_args(spark, ["--backends", "arrow", "--scenarios", "find", "--length", "64", "--iterations", "1", "--warm-ups", "0", "--format", "json"])
    return spark.createDataFrame([(said,)], "j string").select(F.explode(F.from_json("j", "array<struct<backend:string,scenario:string,checksum:bigint>>")).alias("e")).select("e.*")


@query("select l_orderkey as k, 'line' as kind from lineitem union all select o_orderkey, 'order' from orders")
def srt5_merge_sorted(spark, d):
    """Two sorted frames as one."""
    left = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.lit("line").alias("kind")).orderBy("k")
    right = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.lit("order").alias("kind")).orderBy("k")
    return ordered.merge_sorted([left, right], F.col("k"), F.col("kind"))


@query(f"select {_TOTAL} from events where event_type = 'view'")
def g2_flow_builder(spark, d):
    flow = Flow()

    def built(builder):
        first = builder.placeholder()
        builder.spawn(lambda: _totals(spark, d, "event_type = 'view'"), "out").succeed(first)

    built(flow.builder())
    with Executor(2, spark) as executor:
        return executor.run(flow).wait().results["out"]


@query(f"select k as task_id, name, 'static' as kind, cast((select count(*) from {_EDGES} where a = k) as int) as n_next from {_NODES} where k > 0 union all select 0, 'root', 'placeholder', 5")
def g6_task_metadata(spark, d):
    rows = [(t.id, t.name, t.kind, len(t.successors)) for t in nation_flow().inspect().tasks]
    return spark.createDataFrame(rows, "task_id int, name string, kind string, n_next int")


@query("select * from (values ('whole', 0, ''), ('cycle', 2, '0,1'), ('after', 1, '1,2,3')) t(flow, n_issues, tasks)")
def g8_validation(spark, d):
    """Flows that are valid, without a root, and with a cycle behind a root."""
    from lodestone.plans.graph import FlowValidationError

    whole, cycle, after = nation_flow(), Flow(), Flow()
    a, b = cycle.spawn(lambda: None), cycle.spawn(lambda: None)
    a.precede(b)
    b.precede(a)
    a, b, c, e = (after.spawn(lambda: None) for _ in range(4))
    a.precede(b)
    b.precede(c)
    c.precede(b, e)
    rows = []
    for name, flow in (("whole", whole), ("cycle", cycle), ("after", after)):
        try:
            flow.validate()
            rows.append((name, 0, ""))
        except FlowValidationError as error:
            rows.append((name, len(error.issues), ",".join(map(str, error.issues[-1].task_ids))))
    return spark.createDataFrame(rows, "flow string, n_issues int, tasks string")


@query("select * from (values (0, 0, 1, 31), (1, 1, 0, 31), (2, 0, 1, 32)) t(run, hits, misses, nodes)")
def g11_snapshot_cache(spark, d):
    """A second run finds the first one's snapshot; after a change it is built anew."""
    flow, rows = nation_flow(), []
    flow.set_profile_enabled(True)
    with Executor(2) as executor:
        for k in range(3):
            if k == 2:
                flow.placeholder()
            executor.run(flow).wait()
            p = flow.last_profile
            rows.append((k, p.snapshot_cache_hits, p.snapshot_cache_misses, p.snapshot_nodes))
    return spark.createDataFrame(rows, "run int, hits int, misses int, nodes int")


def _kinds(spark, d) -> list[str]:
    return sorted(r[0] for r in table(spark, d, "events").select("event_type").distinct().collect())


def _count_of(spark, d, kind: str) -> int:
    return table(spark, d, "events").where(F.col("event_type") == kind).count()


_COUNTS = "select event_type, count(*) as n from events group by event_type"


def _pairs(spark, found: dict) -> DataFrame:
    return spark.createDataFrame(sorted(found.items()), "event_type string, n long")


@query(_COUNTS)
def a1_runtime_children(spark, d):
    """A runtime task starts a child for each kind of event, and joins them (A1, A4)."""
    found, flow = {}, Flow()

    def body(context):
        for kind in _kinds(spark, d):
            context.silent_async(lambda kind=kind: found.__setitem__(kind, _count_of(spark, d, kind)))
        context.corun_children()

    flow.spawn_runtime(body)
    with Executor(3, spark) as executor:
        executor.run(flow).wait()
    return _pairs(spark, found)


@query(_COUNTS)
def a2_schedule(spark, d):
    """A runtime task activates the tasks whose condition would never choose them."""
    found, flow, kinds = {}, Flow(), _kinds(spark, d)
    never = flow.spawn_condition(lambda: len(kinds))
    tasks = [flow.spawn(lambda kind=kind: found.__setitem__(kind, _count_of(spark, d, kind))) for kind in kinds]
    never.precede(*tasks)
    flow.spawn_runtime(lambda context: [context.schedule(t) for t in tasks] and None).precede(never)
    with Executor(2, spark) as executor:
        executor.run(flow).wait()
    return _pairs(spark, found)


@query(_COUNTS)
def a3_corun(spark, d):
    """A runtime task runs other flows and waits for them, on the only worker."""
    found, flow = {}, Flow()

    def body(context):
        for kind in _kinds(spark, d):
            inner = Flow()
            inner.spawn(lambda kind=kind: found.__setitem__(kind, _count_of(spark, d, kind)))
            context.corun(inner)

    flow.spawn_runtime(body)
    with Executor(1, spark) as executor:
        executor.run(flow).wait()
    return _pairs(spark, found)


@query(_COUNTS)
def a5_wait_async(spark, d):
    found, flow = {}, Flow()
    with Executor(1, spark) as executor:
        flow.spawn_runtime(lambda context: found.update({k: context.wait_async(executor.async_task(lambda k=k: _count_of(spark, d, k))) for k in _kinds(spark, d)}))
        executor.run(flow).wait()
    return _pairs(spark, found)


@query("select count(*) as n from lineitem")
def a7_runtime_async(spark, d):
    def body(context):
        parts: list = []
        for flag in ("A", "N", "R"):
            context.silent_async(lambda flag=flag: parts.append(table(spark, d, "lineitem").where(F.col("l_returnflag") == flag).count()))
        context.corun_children()
        return sum(parts)

    with Executor(2, spark) as executor:
        return spark.createDataFrame([(executor.runtime_async(body).wait(),)], "n long")


@query("select 12 as n_tasks, 2 as most_at_once, 2 as left_over")
def a10_semaphore(spark, d):
    """Tasks that hold a semaphore of two are never more than two at once."""
    import threading
    import time

    from lodestone.plans.graph import Semaphore

    semaphore, flow, lock, now, seen = Semaphore(2), Flow(), threading.Lock(), [0], []

    def body():
        with lock:
            now[0] += 1
            seen.append(now[0])
        time.sleep(0.02)
        with lock:
            now[0] -= 1

    for _ in range(12):
        flow.spawn(body).acquire(semaphore).release(semaphore)
    with Executor(4) as executor:
        executor.run(flow).wait()
    return spark.createDataFrame([(len(seen), max(seen), semaphore.value)], "n_tasks int, most_at_once int, left_over int")


@query(f"select {_TOTAL} from events")
def a11_compat(spark, d):
    """A flow and executor under their older names."""
    from lodestone.plans import compat

    flow = compat.Flow("older")
    last = flow.emplace(lambda: _totals(spark, d, "true")).name("out")
    flow.placeholder().precede(last)
    with compat.Executor(2, spark) as executor:
        return executor.run(flow).wait().results["out"]


@query("select 20 as n_done, true as all_finished")
def r5_wait_for_all(spark, d):
    done: list = []
    with Executor(3) as executor:
        handles = [executor.async_task(lambda: done.append(1)) for _ in range(20)]
        executor.wait_for_all()
        return spark.createDataFrame([(len(done), all(h.is_finished for h in handles))], "n_done int, all_finished boolean")


@query(f"select true as finished, false as cancelled, false as cancels_late, n, total from (select {_TOTAL} from events)")
def r6_run_handle(spark, d):
    flow = Flow()
    flow.spawn(lambda: _totals(spark, d, "true"), "out")
    with Executor(1, spark) as executor:
        handle = executor.run(flow).wait()
        late = handle.cancel()
    return handle.results["out"].select(F.lit(handle.is_finished).alias("finished"), F.lit(handle.is_cancelled).alias("cancelled"), F.lit(late).alias("cancels_late"), "n", "total")


@query("select 'no such table' as message, 1 as task_id, 'reader' as task, 1 as n_before, 0 as n_after")
def r7_error_model(spark, d):
    """A task's error is the run's and names the task; what depends on that task does not run."""
    from lodestone.plans.graph import FlowError

    before, after, flow = [], [], Flow()

    def fails():
        raise ValueError("no such table")

    flow.spawn(lambda: before.append(1)).precede(flow.spawn(fails, "reader").precede(flow.spawn(lambda: after.append(1))))
    with Executor(1) as executor:
        try:
            executor.run(flow).wait()
            rows = []
        except FlowError as e:
            rows = [(str(e.message), e.task_id, e.task_name, len(before), len(after))]
    return spark.createDataFrame(rows, "message string, task_id int, task string, n_before int, n_after int")


@query("select true as cancelled, 1 as n_begun, 0 as n_after")
def r8_cancellation(spark, d):
    """A cancelled run ends the task that has begun and skips what comes after it."""
    import threading

    begun, go, after, flow = threading.Event(), threading.Event(), [], Flow()

    def body():
        begun.set()
        go.wait(30)

    flow.spawn(body).precede(flow.spawn(lambda: after.append(1)))
    with Executor(1) as executor:
        handle = executor.run(flow)
        begun.wait(30)
        cancelled = handle.cancel()
        go.set()
        handle.wait()
    return spark.createDataFrame([(cancelled, int(begun.is_set()), len(after))], "cancelled boolean, n_begun int, n_after int")


@query("select * from (values (0, 50, 50, 49), (1, 20, 20, 19), (2, 0, 0, -1)) t(run, n_tokens, n_rows, last)")
def p2_pipeline_runs(spark, d):
    """A pipeline runs afresh each time; reset forgets its tokens."""
    pipe = pipeline.Pipeline(spark, 4, [pipeline.Pipe.serial(pipeline.project(value=F.col("token")))])
    rows = []
    with Executor(2, spark) as executor:
        for k, tokens in enumerate((50, 20)):
            n, last = pipe.run(executor, tokens, lambda df: df.agg(F.count("*"), F.max("value")).first()).wait()
            rows.append((k, pipe.num_tokens, n, last))
    pipe.reset()
    rows.append((2, pipe.num_tokens, 0, -1))
    return spark.createDataFrame(rows, "run int, n_tokens int, n_rows int, last int")


@query("select 100 as stage0, 100 + 50 as downstream, true as waited, true as empty_again")
def p8_pipeline_profile(spark, d):
    """Tokens that passed the first pipe, and those that passed two serial ones behind a pipe that halves them."""
    one = pipeline.Pipe.serial(pipeline.project(value=F.col("token")))
    pipe = pipeline.Pipeline(spark, 4, [one, one, pipeline.Pipe.parallel(lambda df: df.where("value % 2 = 0")), one])
    pipe.set_profile_enabled(True)
    with Executor(1, spark) as executor:
        pipe.run(executor, 100).wait()
        p = pipe.last_profile
        pipe.set_profile_enabled(False)
        pipe.run(executor, 100).wait()
    return spark.createDataFrame([(p.stage0_total_acquires, p.downstream_total_acquires, p.corun_total_wait_ns > 0, pipe.last_profile.is_empty)], "stage0 int, downstream int, waited boolean, empty_again boolean")


@query(f"select count(*) as n_tokens, cast(sum(v) as bigint) as total from {EVENTS}")
def snk2_pipeline_sink(spark, d):
    """The sink's own run counts the tokens."""
    rows = events(spark, d).select(F.col("idx").alias("token"), F.col("v").alias("value"))
    flow = pipeline.DataPipeline(spark).source_frame(rows).sink(lambda df: df.agg(F.sum("value")).first()[0]).build()
    with Executor(1, spark) as executor:
        total = flow.run(executor).wait()
    return spark.createDataFrame([(flow.num_tokens, total)], "n_tokens long, total long")
