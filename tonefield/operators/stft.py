"""Short-time Fourier transform, its inverse, and spectra.

Frames follow one convention: half a window of zeros before and behind, stride `hop`, division by the sum of the
taper. A grid has a row per cell: keys, k, m, freq_hz, time_s, re, im, power.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import KEYS, Stft
from ..functions.tapers import taper
from .graph import bounds, whole_groups

#: Frames of one task's chunk; a long signal is many chunks, each with the samples that its frames touch.
CHUNK = 1024
#: The place of a row that holds no sample.
NOWHERE = -(1 << 62)


def window_of(c: Stft) -> np.ndarray:
    return taper(c.taper, c.length, sigma=c.sigma) if c.taper == "gaussian" else taper(c.taper, c.length)


def padded_length(signal: DataFrame, c: Stft) -> DataFrame:
    """Samples of each segment, short ones as padded to the window, and the frames of its grid."""
    n = signal.groupBy(*KEYS).agg((F.max("n") + 1).alias("original_length"))
    return n.withColumn("n_time", (F.ceil(F.greatest("original_length", F.lit(c.length)) / c.hop) + 1).cast("int"))


def frames(signal: DataFrame, c: Stft) -> DataFrame:
    """Keys, m, re[], im[] over all bins k: the spectrum of each frame, in numpy under Arrow.

    A segment has the chunks that its length tells, also where no sample lies; a row without a sample stands for
    each. Tasks take whole chunks, many short ones at a time.
    """
    w = window_of(c)
    half, span, keys = c.length // 2, CHUNK * c.hop, [*KEYS, "chunk"]
    n = F.col("n")
    sizes = padded_length(signal, c).select(*KEYS, "n_time")
    low, high = F.greatest(F.lit(0), F.floor((n - half + c.hop) / span)), F.floor((n + half) / span)
    touched = signal.select(*KEYS, F.explode(F.sequence(low, F.greatest(low, high))).alias("chunk"), n.cast("long").alias("n"), "re", "im")
    empty = sizes.select(*KEYS, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_time") - 1) / CHUNK))).alias("chunk"), F.lit(NOWHERE).alias("n"), F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
    pieces = touched.unionByName(empty).join(sizes, list(KEYS)).where(F.col("chunk") * CHUNK < F.col("n_time"))

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in whole_groups(parts, keys):
            at = bounds(p, keys)
            n, z = p["n"].to_numpy(), p["re"].to_numpy() + 1j * p["im"].to_numpy()
            chunk, n_time = p["chunk"].to_numpy()[at[:-1]], p["n_time"].to_numpy()[at[:-1]]
            count = np.minimum(CHUNK, n_time - chunk * CHUNK)
            views = []
            for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                x = np.zeros((count[i] - 1) * c.hop + c.length, complex)
                place = n[a:b] - (chunk[i] * span - half)
                ok = (place >= 0) & (place < len(x))
                x[place[ok]] = z[a:b][ok]
                views.append(np.lib.stride_tricks.sliding_window_view(x, c.length)[:: c.hop])
            f = np.fft.fft(np.concatenate(views) * w, axis=1) / w.sum()
            f = np.fft.fftshift(f, axes=1) if c.two_sided else f[:, : c.bins]
            first = np.repeat(at[:-1], count)
            m = np.arange(len(f)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(chunk * CHUNK, count)
            yield pd.DataFrame({"signal_id": p["signal_id"].to_numpy()[first], "seg_id": p["seg_id"].to_numpy()[first], "m": m, "zre": list(f.real), "zim": list(f.imag)})

    ordered = pieces.repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInPandas(of, f"signal_id {dict(signal.dtypes)['signal_id']}, seg_id int, m int, zre array<double>, zim array<double>")


def stft(signal: DataFrame, c: Stft) -> DataFrame:
    """The grid of every segment of signal (keys, n, re, im)."""
    z = frames(signal, c).select(*KEYS, "m", F.posexplode(F.arrays_zip("zre", "zim")).alias("k", "z"))
    return cells(z.select(*KEYS, "k", "m", F.col("z.zre").alias("re"), F.col("z.zim").alias("im")), c)


def cells(z: DataFrame, c: Stft) -> DataFrame:
    freq = (F.col("k") - (c.length // 2 if c.two_sided else 0)) * (c.rate / c.length)
    return z.select(*KEYS, "k", "m", freq.alias("freq_hz"), (F.col("m") * (c.hop / c.rate)).alias("time_s"), "re", "im", (F.col("re") ** 2 + F.col("im") ** 2).alias("power"))


def stft_relational(signal: DataFrame, c: Stft) -> DataFrame:
    """The same grid as a join of frames, taper and bins and one aggregation, without Python."""
    spark, half, w = signal.sparkSession, c.length // 2, window_of(c)
    taps = spark.createDataFrame([(i, float(w[i] / w.sum())) for i in range(c.length)], "i int, w double")
    sizes = padded_length(signal, c).select(*KEYS, "n_time")
    low = F.greatest(F.lit(0), F.ceil((F.col("n") + half - c.length + 1) / c.hop))
    at = signal.join(sizes, list(KEYS)).withColumn("m", F.explode(F.sequence(low, F.floor((F.col("n") + half) / c.hop)))).where("m < n_time")
    at = at.withColumn("i", (F.col("n") - F.col("m") * c.hop + half).cast("int")).join(F.broadcast(taps), "i")
    shift = half if c.two_sided else 0
    x = at.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(c.bins - 1)))).withColumn("a", F.lit(2 * math.pi / c.length) * F.pmod((F.col("k") - shift) * F.col("i"), F.lit(c.length)))
    re = F.sum(F.col("w") * (F.col("re") * F.cos("a") + F.col("im") * F.sin("a")))
    im = F.sum(F.col("w") * (F.col("im") * F.cos("a") - F.col("re") * F.sin("a")))
    return cells(x.groupBy(*KEYS, "k", F.col("m").cast("int").alias("m")).agg(re.alias("re"), im.alias("im")), c)


def istft(grid: DataFrame, c: Stft, lengths: DataFrame, real: bool = False) -> DataFrame:
    """(keys, n, re, im) from a grid whose missing cells are zero; lengths: (keys, original_length).

    Each frame is inverted where it is; overlap-add is one aggregation by sample.
    """
    w, half = window_of(c), c.length // 2
    packed = grid.groupBy(*KEYS, "m").agg(F.collect_list("k").alias("k"), F.collect_list("re").alias("re"), F.collect_list("im").alias("im"))

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for r in p.itertuples(index=False):
                z = np.zeros(c.bins, complex)
                z[r.k] = r.re + 1j * r.im
                x = np.fft.ifft(np.fft.ifftshift(z)) if c.two_sided else np.fft.irfft(z, c.length)
                out.append(x * w.sum() * w)
            yield pd.DataFrame({"signal_id": p["signal_id"], "seg_id": p["seg_id"], "m": p["m"], "x": [x.real for x in out], "y": [np.asarray(x.imag) for x in out]})

    kind = dict(grid.dtypes)["signal_id"]
    back = packed.mapInPandas(of, f"signal_id {kind}, seg_id int, m int, x array<double>, y array<double>")
    samples = back.select(*KEYS, "m", F.posexplode(F.arrays_zip("x", "y")).alias("i", "v")).select(*KEYS, (F.col("m").cast("long") * c.hop + F.col("i") - half).alias("n"), F.col("v.x").alias("x"), F.col("v.y").alias("y"))
    sums = samples.groupBy(*KEYS, "n").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    # the taper's squares over all frames of the grid, whether their cells are kept or not
    frames_ = lengths.withColumn("n_time", F.ceil(F.greatest("original_length", F.lit(c.length)) / c.hop) + 1)
    n = frames_.withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("original_length") - 1)))
    square = F.array(*[F.lit(float(v * v)) for v in w])
    low, high = F.greatest(F.lit(0), F.ceil((F.col("n") + half - c.length + 1) / c.hop)), F.least(F.col("n_time") - 1, F.floor((F.col("n") + half) / c.hop))
    norm = F.aggregate(F.sequence(low, high), F.lit(0.0), lambda s, m: s + F.coalesce(F.get(square, (F.col("n") + half - m * c.hop).cast("int")), F.lit(0.0)))
    full = n.withColumn("w2", norm).join(sums, [*KEYS, "n"], "left")
    at = lambda v: F.coalesce(F.col(v), F.lit(0.0)) / F.when(F.col("w2") > 1e-10, F.col("w2")).otherwise(1.0)
    return full.select(*KEYS, "n", at("x").alias("re"), (F.lit(0.0) if real else at("y")).alias("im"))


def welch(signal: DataFrame, rate: float, length: int = 256) -> DataFrame:
    """(keys, k, freq_hz, density): one-sided Welch density of the magnitude, half-overlapping periodic Hann frames."""
    return mean_frames(signal, rate, length, length // 2, "hann_periodic").groupBy(*KEYS, "k", "freq_hz").agg(F.avg("density").alias("density"))


def mean_frames(signal: DataFrame, rate: float, length: int, hop: int, taper_name: str = "tukey_periodic") -> DataFrame:
    """(keys, k, m, freq_hz, density): spectrogram of the magnitude without padding, each frame less its mean."""
    w = taper(taper_name, length)
    mag = signal.select(*KEYS, "n", F.sqrt(F.col("re") ** 2 + F.col("im") ** 2).alias("x"))
    last = mag.groupBy(*KEYS).agg(F.max("n").alias("last"))
    low = F.greatest(F.lit(0), F.ceil((F.col("n") - length + 1) / hop))
    at = mag.join(last, list(KEYS)).withColumn("m", F.explode(F.sequence(low, F.floor(F.col("n") / hop)))).where(F.col("m") * hop + length - 1 <= F.col("last"))
    packed = at.groupBy(*KEYS, "m").agg(F.sort_array(F.collect_list(F.struct("n", "x"))).alias("f")).select(*KEYS, F.col("m").cast("int").alias("m"), F.col("f.x").alias("x"))
    scale = 1 / (rate * float((w * w).sum()))
    twice = np.where((np.arange(length // 2 + 1) > 0) & (np.arange(length // 2 + 1) < length / 2), 2.0, 1.0)

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                x = np.stack(p["x"].to_numpy())
                z = np.fft.rfft((x - x.mean(1, keepdims=True)) * w, axis=1)
                yield pd.DataFrame({"signal_id": p["signal_id"], "seg_id": p["seg_id"], "m": p["m"], "d": list(np.abs(z) ** 2 * scale * twice)})

    kind = dict(signal.dtypes)["signal_id"]
    d = packed.mapInPandas(of, f"signal_id {kind}, seg_id int, m int, d array<double>").select(*KEYS, "m", F.posexplode("d").alias("k", "density"))
    return d.select(*KEYS, "k", "m", (F.col("k") * (rate / length)).alias("freq_hz"), "density")


def spectrum(signal: DataFrame, rate: float, length: int) -> DataFrame:
    """(keys, k, freq_hz, magnitude): two-sided magnitude spectrum of the first `length` samples."""
    packed = signal.where(F.col("n") < length).groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("n", "re", "im"))).alias("f"))

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for f in p["f"]:
                x = np.zeros(length, complex)
                for s in f:
                    x[s["n"]] = complex(s["re"], s["im"])
                out.append(np.abs(np.fft.fftshift(np.fft.fft(x))))
            yield pd.DataFrame({"signal_id": p["signal_id"], "seg_id": p["seg_id"], "x": out})

    kind = dict(signal.dtypes)["signal_id"]
    x = packed.mapInPandas(of, f"signal_id {kind}, seg_id int, x array<double>").select(*KEYS, F.posexplode("x").alias("k", "magnitude"))
    return x.select(*KEYS, "k", ((F.col("k") - length // 2) * (rate / length)).alias("freq_hz"), "magnitude")
