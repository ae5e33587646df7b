"""Functions for SQL: registered by name on a session."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .tapers import taper


def hurst_of(x: np.ndarray, max_lag: int = 20) -> float:
    if len(x) < 2 * max_lag:
        return 0.5
    rs = []
    for lag in range(2, min(max_lag, len(x) // 4)):
        c = x[: len(x) // lag * lag].reshape(-1, lag)
        y, s = np.cumsum(c - c.mean(1, keepdims=True), axis=1), c.std(1)
        if (s > 1e-10).any():
            rs.append(((y.max(1) - y.min(1))[s > 1e-10] / s[s > 1e-10]).mean())
    return float(np.clip(np.polyfit(np.log(np.arange(2, 2 + len(rs))), np.log(rs), 1)[0], 0, 1)) if len(rs) >= 3 else 0.5


def higuchi_of(x: np.ndarray, k_max: int = 10) -> float:
    n, lengths = len(x), []
    if n < 2 * k_max:
        return 1.5
    for k in range(1, k_max + 1):
        parts = [x[m::k] for m in range(k) if len(x[m::k]) >= 2]
        total = sum(np.abs(np.diff(p)).sum() * (n - 1) / (k * len(p) * k) for p in parts) / k
        if total > 0:
            lengths.append(total)
    return float(np.clip(-np.polyfit(np.log(np.arange(1, len(lengths) + 1)), np.log(lengths), 1)[0], 1, 2)) if len(lengths) >= 3 else 1.5


def register(spark: SparkSession) -> None:
    """doppler_velocity(hz), power_db(p), rqf(clean, rebuilt), hurst(array), higuchi(array), stft(array, length, hop)."""

    @F.pandas_udf("double")
    def hurst(x: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else hurst_of(np.asarray(a, float)) for a in x])

    @F.pandas_udf("double")
    def higuchi(x: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else higuchi_of(np.asarray(a, float)) for a in x])

    @F.pandas_udf("double")
    def rqf(clean: pd.Series, rebuilt: pd.Series) -> float:
        e = float(((clean - rebuilt) ** 2).sum())
        return 100.0 if e < 1e-15 else float(10 * np.log10((clean**2).sum() / e))

    class Stft:
        def eval(self, x: list, length: int, hop: int):
            w = taper("gaussian", length)
            z = np.concatenate([np.zeros(length // 2), np.asarray(x, float), np.zeros(length)])
            for m in range(-(-max(len(x), length) // hop) + 1):
                z_m = np.zeros(length)
                part = z[m * hop : m * hop + length]
                z_m[: len(part)] = part
                for k, v in enumerate(np.fft.rfft(z_m * w) / w.sum()):
                    yield k, m, float(v.real), float(v.imag)

    spark.udf.register("hurst", hurst)
    spark.udf.register("higuchi", higuchi)
    spark.udf.register("rqf", rqf)
    spark.udtf.register("stft", F.udtf(Stft, returnType="k int, m int, re double, im double"))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION doppler_velocity(hz DOUBLE) RETURNS DOUBLE RETURN hz * 3e8D / (2 * 9.39e9D)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION power_db(p DOUBLE) RETURNS DOUBLE RETURN 10 * log10(p + 1e-12D)")
