"""Scalar kernels of the workloads, as column expressions where these can say it and vectorised UDFs elsewhere."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.intmath import rotate_left, unsigned, wrap64, wrapping_add

# Coefficients of the polynomial approximation of the normal distribution, and the palette.
_NORMAL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
_NORMAL_K, _ROOT = 0.2316419, 0.39894228040143270286
PALETTE = ((66, 30, 15), (25, 7, 26), (9, 1, 47), (4, 4, 73), (0, 7, 100), (12, 44, 138), (24, 82, 177), (57, 125, 209), (134, 181, 229), (211, 236, 248), (241, 233, 191), (248, 201, 95), (255, 170, 0), (204, 128, 0), (153, 87, 0), (106, 52, 3))
MOST_ITERATIONS = 200


def scramble(x: Column) -> Column:
    """Rotation by 7 and a wrapping sum with a constant."""
    return wrapping_add(rotate_left(x, 7), F.lit(0x9E3779B9))


def normal_cdf(x: Column) -> Column:
    k = 1 / (1 + _NORMAL_K * F.abs(x))
    poly = F.lit(0.0)
    for c in reversed(_NORMAL):
        poly = (poly + c) * k
    upper = 1 - poly * _ROOT * F.exp(-0.5 * x * x)
    return F.when(x < 0, 1 - upper).otherwise(upper)


def black_scholes(spot: Column, strike: Column, rate: Column, volatility: Column, time: Column, put: Column) -> Column:
    """The price of a European option."""
    spread = volatility * F.sqrt(time)
    d1 = ((rate + volatility * volatility / 2) * time + F.log(spot / strike)) / spread
    d2 = d1 - spread
    later = strike * F.exp(-rate * time)
    return F.when(put, later * (1 - normal_cdf(d2)) - spot * (1 - normal_cdf(d1))).otherwise(spot * normal_cdf(d1) - later * normal_cdf(d2))


def escape_time(degree: int = 2):
    """A vectorised UDF of (x, y): iterations of z ** degree + c before |z| exceeds 2, MOST_ITERATIONS at most."""

    @F.pandas_udf("int")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        c = x.to_numpy() + 1j * y.to_numpy()
        z, n = c.copy(), np.zeros(len(c), np.int32)
        live = np.abs(z) <= 2
        for _ in range(MOST_ITERATIONS):
            if not live.any():
                break
            n[live] += 1
            z[live] = z[live] ** degree + c[live]
            live[live] = np.abs(z[live]) <= 2
        return pd.Series(n)

    return run


def palette(n: Column) -> Column:
    """The colour of an escape time, as (r, g, b)."""
    colours = F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(rgb, "rgb", strict=True)]) for rgb in PALETTE])
    black = F.struct(*[F.lit(0).alias(c) for c in "rgb"])
    return F.when((n < MOST_ITERATIONS) & (n != 0), F.get(colours, F.pmod(n, F.lit(len(PALETTE))))).otherwise(black)


def sine_rounds(index: Column, rounds: int = 32) -> Column:
    """The sum of x over rounds of x = sin(x) * 1.0000001 + cos(x), which begin at a hash of the index plus one."""
    wide = wrap64(index.cast("decimal(20,0)") * F.lit(1315423911).cast("decimal(10,0)"))
    start = unsigned(wide.bitwiseXOR(F.shiftrightunsigned(index, 3))).cast("double") + 1.0
    step = lambda a, _: F.struct((F.sin(a["x"]) * 1.0000001 + F.cos(a["x"])).alias("x"), (a["sum"] + (F.sin(a["x"]) * 1.0000001 + F.cos(a["x"]))).alias("sum"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(start.alias("x"), F.lit(0.0).alias("sum")), step, lambda a: a["sum"])


def clamp_int(x: Column) -> Column:
    """A float as a 32-bit integer: saturating, and zero for what is no number."""
    return F.when(F.isnan(x), 0).otherwise(F.least(F.greatest(x, F.lit(-(2.0**31))), F.lit(2.0**31 - 1))).cast("int")


def lenient_int(s: Column) -> Column:
    """The integer that a text spells, else zero."""
    return F.coalesce(s.try_cast("int"), F.lit(0))


def is_prime(n: Column) -> Column:
    """Trial division by 2, 3 and numbers next to multiples of 6."""
    steps = F.when(n >= 25, F.sequence(F.lit(5).cast("long"), F.floor(F.sqrt(n.cast("double"))).cast("long"), F.lit(6).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return (n == 2) | (n == 3) | ((n > 3) & (n % 2 != 0) & (n % 3 != 0) & F.forall(steps, lambda d: (n % d != 0) & (n % (d + 2) != 0)))


def matrix_work(seed: Column, size: int = 16) -> Column:
    """The sum of all entries of the product of (i + k - s) and (k - j + s) matrices, s = seed mod 10, modulo 999."""
    s = seed % 10
    # over all i and j, the sums factor: one value for each k
    of = lambda k: (F.lit(size * (size - 1) // 2) + size * (k - s)) * (size * (k + s) - F.lit(size * (size - 1) // 2))
    return F.pmod(F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), F.lit(0).cast("long"), lambda a, k: a + of(k).cast("long")), F.lit(999)).cast("int")
