"""Taper windows, as driver arrays and as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The five terms of the flat-top window.
FLATTOP = (0.21557895, 0.41663158, 0.277263158, 0.083578947, 0.006947368)


def bessel0(x: float, terms: int = 24) -> float:
    """I0 by its Taylor series."""
    return math.fsum((x * x / 4) ** i / math.factorial(i) ** 2 for i in range(terms + 1))


def cosines(a: tuple[float, ...]) -> Callable[[np.ndarray, int], np.ndarray]:
    return lambda i, n: sum((-1) ** j * c * np.cos(2 * np.pi * j * i / (n - 1)) for j, c in enumerate(a))


def tukey(i: np.ndarray, n: int, alpha: float = 0.5) -> np.ndarray:
    if alpha <= 0:
        return np.ones(n)
    if alpha >= 1:
        return cosines((0.5, 0.5))(i, n)
    width = int(alpha * (n - 1) / 2)
    edge = np.minimum(i, n - 1 - i)
    return np.where(edge <= width, 0.5 * (1 + np.cos(np.pi * (2 * edge / (alpha * (n - 1)) - 1))), 1.0)


TAPERS: dict[str, Callable[..., np.ndarray]] = {
    "gaussian": lambda i, n, sigma=8.0: np.exp(-((i - (n - 1) / 2) ** 2) / (2 * (sigma or n / 6) ** 2)),
    "hamming": cosines((0.54, 0.46)),
    "hann": cosines((0.5, 0.5)),
    "hann_periodic": lambda i, n: 0.5 - 0.5 * np.cos(2 * np.pi * i / n),
    "blackman": cosines((0.42, 0.5, 0.08)),
    "kaiser": lambda i, n, beta=8.6: np.array([bessel0(beta * math.sqrt(max(0.0, 1 - (2 * j / (n - 1) - 1) ** 2))) for j in i]) / bessel0(beta),
    "tukey": tukey,
    "tukey_periodic": lambda i, n, alpha=0.25: tukey(np.arange(n + 1), n + 1, alpha)[:n],
    "bartlett": lambda i, n: 1 - np.abs(2 * i / (n - 1) - 1),
    "flattop": cosines(FLATTOP),
}


def taper(name: str, n: int, **how: float) -> np.ndarray:
    """The named window of n points; an unknown name is a ValueError."""
    if name not in TAPERS:
        raise ValueError(f"unknown taper {name!r}; known: {', '.join(TAPERS)}")
    return np.ones(1) if n == 1 else TAPERS[name](np.arange(n), n, **how)


def _cos(a: tuple[float, ...], i: Column, n: int) -> Column:
    out = F.lit(a[0])
    for j, c in enumerate(a[1:], 1):
        out = out + (-1) ** j * c * F.cos(F.lit(2 * math.pi * j / (n - 1)) * i)
    return out


def taper_column(name: str, i: Column, n: int, sigma: float = 8.0, beta: float = 8.6, alpha: float = 0.5) -> Column:
    """The named window at place i, for plans that stay in the JVM."""
    edge = F.least(i, n - 1 - i)
    x = F.lit(beta) * F.sqrt(F.greatest(F.lit(0.0), 1 - F.pow(2 * i / (n - 1) - 1, F.lit(2.0))))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(24)), F.struct(F.lit(1.0).alias("s"), F.lit(1.0).alias("t")), lambda s, j: F.struct((s["s"] + s["t"] * x * x / 4 / (j * j)).alias("s"), (s["t"] * x * x / 4 / (j * j)).alias("t")))["s"]
    known = {
        "gaussian": lambda: F.exp(-F.pow(i - (n - 1) / 2, F.lit(2.0)) / (2 * sigma**2)),
        "hamming": lambda: _cos((0.54, 0.46), i, n),
        "hann": lambda: _cos((0.5, 0.5), i, n),
        "blackman": lambda: _cos((0.42, 0.5, 0.08), i, n),
        "flattop": lambda: _cos(FLATTOP, i, n),
        "bartlett": lambda: 1 - F.abs(2 * i / (n - 1) - 1),
        "kaiser": lambda: series / bessel0(beta),
        "tukey": lambda: F.when(edge <= int(alpha * (n - 1) / 2), 0.5 * (1 + F.cos(math.pi * (2 * edge / (alpha * (n - 1)) - 1)))).otherwise(1.0),
    }
    if name not in known:
        raise ValueError(f"unknown taper {name!r}; known: {', '.join(known)}")
    return known[name]()


def taper_table(spark: SparkSession, name: str, n: int, **how: float) -> DataFrame:
    """(i, w) of a window."""
    return spark.range(n).select(F.col("id").cast("int").alias("i"), taper_column(name, F.col("id"), n, **how).alias("w"))


def overlap_adds_up(w: np.ndarray, hop: int) -> bool:
    """Whether copies of w at stride hop sum to a constant (COLA)."""
    sums = np.bincount(np.arange(len(w)) % hop, w, minlength=hop)
    return bool(np.abs(sums - np.median(sums)).max() < 1e-10)
