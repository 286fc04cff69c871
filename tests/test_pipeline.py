import pytest
from pyspark.sql import functions as F

from lodestone import harness
from lodestone.operators import ordered
from lodestone.plans.graph import FlowError
from lodestone.plans.runner import Executor
from lodestone.streaming.pipeline import SERIAL, DataPipeline, Pipe, PipeContext, Pipeline, ScalablePipeline, in_order, project, running


def test_pipeline_runs_and_resets(spark):
    pipe = Pipeline(spark, 3, [Pipe.serial(project(value=F.col("token") * 2)), Pipe.parallel(project(value=F.col("value") + 1))])
    got = pipe.run(Executor(2), 10, lambda df: [r.value for r in df.orderBy("token").collect()]).wait(60)
    assert got == [2 * k + 1 for k in range(10)] and (pipe.num_tokens, pipe.num_pipes, pipe.num_lines) == (10, 2, 3)
    pipe.reset()
    assert pipe.num_tokens == 0
    pipe.set_profile_enabled(True)
    pipe.run(Executor(1), 4).wait(60)
    assert not pipe.last_profile.is_empty


def test_pipelines_are_checked(spark):
    for lines, pipes in ((0, [Pipe.serial(project())]), (1, []), (1, [Pipe.parallel(project())])):
        with pytest.raises(ValueError):
            Pipeline(spark, lines, pipes)
    empty = ScalablePipeline(spark, 2)
    with pytest.raises(FlowError, match="pipeline has no pipes configured"):
        empty.run(Executor(1), 3).wait(10)
    empty.reset_with_lines_and_pipes(4, [Pipe.serial(project(value=F.col("token")))])
    assert empty.frame(5).count() == 5


def test_typed_stages_and_stop(spark):
    source = lambda c: c.stop() if c.token == 25 else c.token
    pipe = DataPipeline(spark, 4).source(source, "long").stage(project(value=F.concat(F.lit("t"), F.col("value").cast("string")))).stage(project(value=F.length("value"))).sink(lambda df: sorted(r.value for r in df.collect())).build()
    for _ in range(2):
        assert pipe.run(Executor(1)).wait(60) == [2] * 10 + [3] * 15 and pipe.num_tokens == 25
    with pytest.raises(RuntimeError):
        PipeContext(0, 0, 1).stop()
    with pytest.raises(ValueError):
        DataPipeline(spark).build()


def test_serial_stages_see_tokens_in_order(spark):
    rows = spark.range(200).select(F.col("id").alias("token"), (F.col("id") % 7).alias("v")).repartition(5)
    carried = DataPipeline(spark).source_frame(rows).stage(running("v", ordered.SUM, "sum"), SERIAL).build().frame()
    total = 0
    for r in carried.orderBy("token").collect():
        total += r.v
        assert r["sum"] == total

    def remember(batches):
        last = -1
        for b in batches:
            assert b["token"].is_monotonic_increasing and b["token"].iloc[0] > last
            last = b["token"].iloc[-1]
            yield b

    assert in_order(remember, "token long, v long")(rows).count() == 200


def test_stream_equals_batch(spark, tmp_path):
    spark.range(50).select(F.col("id").alias("token"), (F.col("id") * 3).alias("v")).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("token long, v long").parquet(str(tmp_path / "in"))
    out = []
    DataPipeline(spark).source_frame(rows).stage(project(v=F.col("v") + 1)).build().stream(str(tmp_path / "state"), lambda df, k: out.extend(r.v for r in df.collect())).awaitTermination()
    assert sorted(out) == [3 * k + 1 for k in range(50)]


def test_harness(spark):
    report = harness.run_benchmarks(spark, harness.BenchmarkConfig.for_test())
    assert len(report.entries) == 15 and [e.status for e in report.entries].count("unavailable") == 5
    by = {(e.backend, e.scenario): e.checksum for e in report.entries}
    for s in harness.SCENARIOS:
        assert by["expression", s] == by["arrow", s]
    assert by["expression", "find"] == 192
    assert "median" in report.to_json() and report.to_df(spark).where("ms is not null").count() == 10 and "unavailable" in report.to_markdown()
    with pytest.raises(ValueError):
        harness.parse_list("nothing", harness.BACKENDS)
    assert harness.run_from_args(spark, ["--scenarios", "find", "--length", "64", "--iterations", "1"]).startswith("backend")
