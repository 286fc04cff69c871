"""A benchmark harness: scenarios by backend, with samples, statistics and checksums, as a report DataFrame, JSON or table."""

from __future__ import annotations

import argparse
import json
import statistics
import time
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.intmath import unsigned_key
from lodestone.functions.kernels import scramble
from lodestone.operators import ordered
from lodestone.sources import datasets

BACKENDS = ("expression", "arrow", "native")
#: Backends that this engine has no means to run, with the reason that reports give.
UNAVAILABLE = {"native": "no compiled backend is part of this engine"}
SCENARIOS = ("transform", "reduce", "find", "inclusive-scan", "sort")


def parse_list(text: str, known: tuple[str, ...]) -> tuple[str, ...]:
    asked = tuple(x.strip() for x in text.split(",") if x.strip())
    if bad := [x for x in asked if x not in known]:
        raise ValueError(f"unknown: {', '.join(bad)}; known: {', '.join(known)}")
    return asked


@dataclass(frozen=True)
class BenchmarkConfig:
    backends: tuple[str, ...] = BACKENDS
    scenarios: tuple[str, ...] = SCENARIOS
    length: int = 65_536
    chunk: int = 1_024
    warm_ups: int = 1
    iterations: int = 5
    seed: int = 42

    @classmethod
    def for_test(cls) -> BenchmarkConfig:
        return cls(length=256, warm_ups=0, iterations=1)

    def having(self, **changes) -> BenchmarkConfig:
        return replace(self, **changes)


@dataclass(frozen=True)
class BenchmarkEntry:
    backend: str
    scenario: str
    status: str
    samples: tuple[float, ...] = ()
    checksum: int | None = None
    reason: str | None = None

    @property
    def summary(self) -> dict:
        s = self.samples
        return {"min": min(s), "max": max(s), "median": statistics.median(s), "mean": statistics.fmean(s)} if s else {}


@dataclass(frozen=True)
class BenchmarkReport:
    entries: tuple[BenchmarkEntry, ...]

    def to_json(self) -> str:
        return json.dumps([{"backend": e.backend, "scenario": e.scenario, "status": e.status, "samples_ms": e.samples, "checksum": e.checksum, "reason": e.reason, **e.summary} for e in self.entries])

    def to_table(self) -> str:
        return "\n".join(["backend scenario status median_ms", *(f"{e.backend} {e.scenario} {e.status} {e.summary.get('median', float('nan')):.3f}" for e in self.entries)])

    def to_markdown(self) -> str:
        shown = lambda e: f"{e.summary['median']:.3f} | {e.checksum}" if e.samples else f"{e.status}: {e.reason} | -"
        return "\n".join(["| backend | scenario | median ms | checksum |", "| --- | --- | --- | --- |", *(f"| {e.backend} | {e.scenario} | {shown(e)} |" for e in self.entries)])

    def to_df(self, spark: SparkSession) -> DataFrame:
        """A row for each sample, and one without a time for each entry that could not run."""
        rows = [(e.backend, e.scenario, e.status, k, x, e.checksum) for e in self.entries for k, x in enumerate(e.samples or (None,))]
        return spark.createDataFrame(rows, "backend string, scenario string, status string, iteration int, ms double, checksum long")

    def compared(self, spark: SparkSession, base: str) -> DataFrame:
        """For each scenario and backend that ran: its median time, its ratio to the base's, and whether the checksums agree."""
        ran = spark.createDataFrame([(e.backend, e.scenario, e.summary["median"], e.checksum) for e in self.entries if e.samples], "backend string, scenario string, median_ms double, checksum long")
        known = ran.where(F.col("backend") == base).select("scenario", F.col("median_ms").alias("base_ms"), F.col("checksum").alias("base_checksum"))
        return ran.join(F.broadcast(known), "scenario").select("backend", "scenario", "median_ms", (F.col("median_ms") / F.col("base_ms")).alias("ratio"), F.col("checksum").eqNullSafe(F.col("base_checksum")).alias("agrees"))  # a row for each scenario


def scenario(data: DataFrame, name: str, backend: str) -> DataFrame:
    """One row with the scenario's checksum over (idx, v)."""
    if name == "transform":
        if backend == "arrow":
            kernel = lambda v: pd.Series(((v.to_numpy().view(np.uint64) << np.uint64(7) | v.to_numpy().view(np.uint64) >> np.uint64(57)) + np.uint64(0x9E3779B9)).view(np.int64))
            return ordered.checksum(ordered.transform_batches(data, "idx", "v", kernel, "long"), "idx", "value")
        return ordered.checksum(ordered.transform(data, "idx", value=scramble(F.col("v"))), "idx", "value")
    if name == "reduce":
        return ordered.reduce(data, "v", ordered.WRAPPING_SUM, 0, "checksum")
    if name == "find":
        found = ordered.find(data, "idx", F.col("v") == (datasets.NEEDLE - (1 << 64)), "checksum")
        return found.select(F.coalesce("checksum", F.lit(-1).cast("long")).alias("checksum"))  # as an unsigned number, the largest
    if name == "inclusive-scan":
        if backend == "arrow":
            return ordered.checksum(ordered.scan_opaque(data, "idx", "v", lambda v: np.cumsum(v), lambda a, v: a + v), "idx", "value")
        return ordered.checksum(ordered.inclusive_scan(data, "idx", "v", ordered.WRAPPING_SUM), "idx", "value")
    return ordered.checksum(data.select(unsigned_key(F.col("v")).alias("key"), "v"), "key", "v")


def run_benchmarks(spark: SparkSession, config: BenchmarkConfig = BenchmarkConfig()) -> BenchmarkReport:
    data = datasets.lcg(spark, config.length, config.seed).persist()
    data.count()
    entries = []
    for backend in config.backends:
        for name in config.scenarios:
            if backend in UNAVAILABLE:
                entries.append(BenchmarkEntry(backend, name, "unavailable", reason=UNAVAILABLE[backend]))
                continue
            samples, value = [], None
            for k in range(config.warm_ups + config.iterations):
                began = time.perf_counter()
                value = scenario(data, name, backend).first()["checksum"]
                if k >= config.warm_ups:
                    samples.append((time.perf_counter() - began) * 1000)
            entries.append(BenchmarkEntry(backend, name, "ok", tuple(samples), value))
    data.unpersist()
    return BenchmarkReport(tuple(entries))


def run_from_args(spark: SparkSession, args: list[str]) -> str:
    p = argparse.ArgumentParser()
    p.add_argument("--backends", default=",".join(BACKENDS))
    p.add_argument("--scenarios", default=",".join(SCENARIOS))
    for name in ("length", "chunk", "iterations", "seed"):
        p.add_argument(f"--{name}", type=int, default=getattr(BenchmarkConfig, name))
    p.add_argument("--warm-ups", type=int, default=BenchmarkConfig.warm_ups)
    p.add_argument("--format", choices=("json", "table"), default="table")
    a = p.parse_args(args)
    config = BenchmarkConfig(parse_list(a.backends, BACKENDS), parse_list(a.scenarios, SCENARIOS), a.length, a.chunk, a.warm_ups, a.iterations, a.seed)
    report = run_benchmarks(spark, config)
    return report.to_json() if a.format == "json" else report.to_table()
