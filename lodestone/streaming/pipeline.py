"""Token pipelines: stages are projections of a DataFrame with a `token` column, in batch or on a stream.

A parallel stage is a stateless projection. A serial stage sees tokens in order; a running fold keeps that order by a
block scan without putting all rows in one task, and an opaque serial stage takes one ordered partition.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import ordered
from lodestone.plans.graph import FlowError
from lodestone.plans.runner import Executor, RunHandle

SERIAL, PARALLEL = "serial", "parallel"


def counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """df, and what counts its rows while some action runs it."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("n")), seen


def finish(df: DataFrame, seen: list[Observation], sink: Callable[[DataFrame], object] | None) -> tuple[object, list[int]]:
    """The sink's value, and the counts, from the sink's own action; a plan that the sink hasn't run is run without one."""
    value = sink(df) if sink else None
    df.sparkSession.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()  # counts come behind the action
    if not all(x._jo.future().isCompleted() for x in seen):
        df.write.format("noop").mode("overwrite").save()
    return value, [x.get["n"] for x in seen]


Stage = Callable[[DataFrame], DataFrame]


@dataclass
class PipelineProfile:
    """Counters of the last profiled run, as measured by its own plan.

    Acquires are tokens that passed the first pipe, and those that passed later serial pipes. A plan takes no locks, spins
    on nothing and runs nothing inline, so those counters stay zero; corun_total_wait_ns is the time its caller waited.
    """

    stage0_total_acquires: int = 0
    stage0_contended_acquires: int = 0
    stage0_wait_ns: int = 0
    stage0_spins: int = 0
    stage0_yields: int = 0
    downstream_total_acquires: int = 0
    downstream_contended_acquires: int = 0
    downstream_wait_ns: int = 0
    downstream_spins: int = 0
    downstream_yields: int = 0
    corun_total_wait_ns: int = 0
    corun_idle_wait_ns: int = 0
    corun_idle_spins: int = 0
    corun_idle_yields: int = 0
    corun_inline_executions: int = 0

    @property
    def is_empty(self) -> bool:
        return self == type(self)()


@dataclass(frozen=True)
class Pipe:
    kind: str
    body: Stage

    @classmethod
    def serial(cls, body: Stage) -> Pipe:
        return cls(SERIAL, body)

    @classmethod
    def parallel(cls, body: Stage) -> Pipe:
        return cls(PARALLEL, body)


def project(**exprs: Column) -> Stage:
    """A stage that replaces the columns besides token and line."""
    return lambda df: df.select(*[c for c in ("token", "line") if c in df.columns], *[e.alias(k) for k, e in exprs.items()])


def running(value: str, monoid: ordered.Monoid, out: str) -> Stage:
    """A serial stage that carries a fold from token to token."""

    def run(df: DataFrame) -> DataFrame:
        return df.join(ordered.inclusive_scan(df, "token", value, monoid, out), "token")

    return run


def in_order(fn: Callable[[Iterator], Iterator], schema: str) -> Stage:
    """A serial stage for an opaque function over all rows in token order: one partition."""
    return lambda df: df.coalesce(1).sortWithinPartitions("token").mapInPandas(fn, schema)


class Pipeline:
    """Pipes over num_lines lines; the first is serial and makes the tokens."""

    def __init__(self, spark: SparkSession, num_lines: int, pipes: list[Pipe] = ()):
        self.spark, self._lock, self._profiled = spark, threading.Lock(), False
        self.last_profile, self.num_tokens = PipelineProfile(), 0
        self.num_lines, self.pipes = num_lines, list(pipes)
        self._check()

    def _check(self) -> None:
        if self.num_lines < 1:
            raise ValueError("a pipeline needs a line")
        if not self.pipes:
            raise ValueError("a pipeline needs a pipe")
        if self.pipes[0].kind != SERIAL:
            raise ValueError("the first pipe must be serial")

    @property
    def num_pipes(self) -> int:
        return len(self.pipes)

    def set_profile_enabled(self, enabled: bool) -> None:
        self._profiled = enabled
        if not enabled:
            self.last_profile = PipelineProfile()

    def reset(self) -> None:
        self.num_tokens = 0

    def frame(self, tokens: int) -> DataFrame:
        """The last pipe's rows for tokens 0 to tokens - 1, lazily; line is token modulo num_lines."""
        df = self.spark.range(tokens).select(F.col("id").alias("token"), (F.col("id") % self.num_lines).cast("int").alias("line"))
        for pipe in self.pipes:
            df = pipe.body(df)
        return df

    def _profiling(self, tokens: int) -> tuple[DataFrame, list[Observation]]:
        """frame(), with a count behind each serial pipe."""
        df, seen = Pipeline(self.spark, self.num_lines, [Pipe.serial(lambda x: x)]).frame(tokens), []
        for pipe in self.pipes:
            df = pipe.body(df)
            if pipe.kind == SERIAL:
                df, count = counted(df)
                seen.append(count)
        return df, seen

    def run(self, executor: Executor, tokens: int, sink: Callable[[DataFrame], object] | None = None) -> RunHandle:
        """Runs all tokens from 0; runs of one pipeline come one after another. A stage's error is the run's."""
        if not self.pipes:
            failed = RunHandle()
            failed.fail(FlowError("pipeline has no pipes configured"))
            failed._done.set()
            return failed

        def body():
            with self._lock:
                began = time.perf_counter_ns()
                df, seen = self.frame(tokens), []
                if self._profiled:
                    df, seen = self._profiling(tokens)
                value, passed = finish(df, seen, sink or (lambda x: x.write.format("noop").mode("overwrite").save()))
                self.num_tokens = tokens
                if self._profiled:
                    self.last_profile = PipelineProfile(stage0_total_acquires=passed[0], downstream_total_acquires=sum(passed[1:]), corun_total_wait_ns=time.perf_counter_ns() - began)
                return value

        return executor.async_task(body)


class ScalablePipeline(Pipeline):
    """A pipeline whose pipes and lines can be replaced; without pipes, a run fails."""

    def _check(self) -> None:
        if self.pipes:
            super()._check()

    def reset_with_pipes(self, pipes: list[Pipe]) -> None:
        self.pipes = list(pipes)
        self._check()
        self.reset()

    def reset_with_lines_and_pipes(self, num_lines: int, pipes: list[Pipe]) -> None:
        self.num_lines = num_lines
        self.reset_with_pipes(pipes)


class StopPipeline(Exception):
    """Raised through context.stop() by a generator."""


@dataclass
class PipeContext:
    """What a generator knows: its token; stop() ends the tokens, and that token is not counted."""

    token: int
    line: int = 0
    pipe: int = 0

    def stop(self) -> None:
        if self.pipe:
            raise RuntimeError("only the first pipe can stop the pipeline")
        raise StopPipeline


@dataclass
class DataPipeline:
    """Typed stages: source, then stages that may change the type, then perhaps a sink."""

    spark: SparkSession
    num_lines: int = 1
    _source: Callable[[int | None], DataFrame] | None = None
    _stages: list[Pipe] = field(default_factory=list)
    _sink: Callable[[DataFrame], object] | None = None
    num_tokens: int = 0

    def source(self, produce: Callable[[PipeContext], object], kind: str, out: str = "value") -> DataPipeline:
        """A generator that ends with context.stop(); it is asked in token order, one at a time."""

        lines = self.num_lines

        def rows() -> Iterator[tuple]:
            token = 0
            while True:
                try:
                    value = produce(PipeContext(token, token % lines))
                except StopPipeline:
                    return
                yield token, token % lines, value
                token += 1

        def run(batches):
            import pandas as pd

            for _ in batches:
                held = []
                for r in rows():
                    held.append(r)
                    if len(held) == 10_000:
                        yield pd.DataFrame(held, columns=["token", "line", out])
                        held = []
                yield pd.DataFrame(held, columns=["token", "line", out])

        self._source = lambda: self.spark.range(1).mapInPandas(run, f"token long, line int, {out} {kind}")
        return self

    def source_range(self, tokens: int, **exprs: Column) -> DataPipeline:
        """A source of known length, made by expressions over `token` in parallel."""
        self._source = lambda: self.spark.range(tokens).select(F.col("id").alias("token"), (F.col("id") % self.num_lines).cast("int").alias("line")).select("token", "line", *[e.alias(k) for k, e in exprs.items()])
        return self

    def source_frame(self, df: DataFrame) -> DataPipeline:
        """Rows that have a token column, batch or stream."""
        self._source = lambda: df
        return self

    def stage(self, body: Stage, kind: str = PARALLEL) -> DataPipeline:
        self._stages.append(Pipe(kind, body))
        return self

    def sink(self, body: Callable[[DataFrame], object]) -> DataPipeline:
        self._sink = body
        return self

    def build(self) -> DataPipeline:
        if self._source is None:
            raise ValueError("a data pipeline needs a source")
        if self.num_lines < 1:
            raise ValueError("a pipeline needs a line")
        return self

    def frame(self) -> DataFrame:
        df = self._source()
        for s in self._stages:
            df = s.body(df)
        return df

    def run(self, executor: Executor) -> RunHandle:
        """Runs afresh, however often; num_tokens is what reached the end, counted by the sink's own run."""

        def body():
            df, seen = counted(self.frame())
            value, (self.num_tokens,) = finish(df, [seen], self._sink)
            return value

        return executor.async_task(body)

    def stream(self, checkpoint: str, each: Callable[[DataFrame, int], None], available_now: bool = True):
        """The same stages on a streaming source; each(rows, batch) is the sink. Serial folds are per micro-batch."""
        query = self.frame().writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        return (query.trigger(availableNow=True) if available_now else query).start()
