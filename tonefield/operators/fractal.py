"""Hurst exponents, Higuchi dimensions, and detection boosted by their anomalies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import KEYS, Fractal, Stft
from .morphology import CROSS, dilated, union
from .quantiles import percentiles


#: Samples of a block, the part of a series that a task holds as one array.
BLOCK = 1024


def blocks(series: DataFrame, keys: tuple[str, ...], halo: int = 0) -> DataFrame:
    """(keys, __block, __i, __x): a series in arrays of BLOCK places i, each with the first `halo` places of the next block."""
    block = F.floor(F.col("i") / BLOCK)
    of = F.when((F.col("i") % BLOCK < halo) & (block > 0), F.array(block - 1, block)).otherwise(F.array(block)) if halo else F.array(block)
    parts = series.select(*keys, F.explode(of).alias("__block"), F.struct(F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x")).alias("__s"))
    parts = parts.groupBy(*keys, "__block").agg(F.array_sort(F.collect_list("__s")).alias("__s"))
    return parts.select(*keys, "__block", F.col("__s.i").alias("__i"), F.col("__s.x").alias("__x"))


def flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, i, x, whether x is null) of every sample in a batch of blocks."""
    i, x = b.column("__i"), b.column("__x")
    values = x.flatten()
    row = np.repeat(np.arange(b.num_rows), i.value_lengths().to_numpy(zero_copy_only=False))
    return row, i.flatten().to_numpy(zero_copy_only=False), values.to_numpy(zero_copy_only=False).astype(float), values.is_null().to_numpy(zero_copy_only=False)


def each_batch(parts: DataFrame, keep: list[str], of: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, dict]]], more: str) -> DataFrame:
    """The columns `keep` of the rows that `of` names, beside the columns `more` that it makes of a batch."""
    schema = ", ".join(f"`{c}` {t}" for c, t in parts.dtypes if c in keep) + ", " + more

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, made in of(b) if b.num_rows else ():
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(row)) for c in keep), *made.values()], [*keep, *made])

    return parts.select(*keep, *[c for c in parts.columns if c not in keep]).mapInArrow(mapped, schema)


def hurst(series: DataFrame, max_lag: int = 20, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, hurst) of series (keys, i, x), i from 0: rescaled range over chunks of each lag, slope in logs.

    0.5 for series shorter than 2 max_lag or with fewer than three lags; else within [0, 1]. Lags without a
    chunk that varies are passed over, and the ranges keep to the first lags, as the definition has it. A chunk is
    measured in the block in which it begins, so no row is repeated for each lag.
    """
    n = series.groupBy(*keys).agg(F.count("*").alias("__n"))

    def of(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, dict]]:
        row, i, x, null = flat(b)
        row, i, x = row[~null], i[~null], x[~null]
        n, block = b.column("__n").to_numpy()[row], b.column("__block").to_numpy()[row]
        for lag in range(2, max_lag):
            chunk = i // lag
            own = (lag < n // 4) & (chunk < n // lag) & (chunk * lag // BLOCK == block)
            if not own.any():
                continue
            r, c, v = row[own], chunk[own], x[own]
            first = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (c[1:] != c[:-1])])
            size = np.diff(np.r_[first, len(v)])
            # a line a chunk; what a chunk lacks is left at its end, where the running sum does not change any more
            line = np.repeat(np.arange(len(first)), size)
            d = np.zeros((len(first), size.max()))
            with np.errstate(invalid="ignore", over="ignore"):
                d[line, np.arange(len(v)) - first[line]] = v - (np.add.reduceat(v, first) / size)[line]
                y, s = np.cumsum(d, axis=1), np.sqrt((d * d).sum(axis=1) / size)
                y[np.arange(d.shape[1]) >= size[:, None]] = np.nan
                at = np.flatnonzero(~(s <= 1e-10))
                ratio = (np.fmax.reduce(y[at], axis=1) - np.fmin.reduce(y[at], axis=1)) / s[at]
            if len(at):
                of_row, start = np.unique(r[first[at]], return_index=True)
                yield of_row, {"lag": pa.array(np.full(len(of_row), lag, np.int32)), "rs": pa.array(np.add.reduceat(ratio, start)), "c": pa.array(np.diff(np.r_[start, len(at)]))}

    parts = blocks(series, keys, max_lag).join(n.where(F.col("__n") >= 2 * max_lag), list(keys))
    rs = each_batch(parts, list(keys), of, "lag int, rs double, c long").groupBy(*keys, "lag").agg((F.sum("rs") / F.sum("c")).alias("rs"))
    rs = rs.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy("lag")) + 1)
    h = rs.groupBy(*keys).agg(F.count("*").alias("c"), F.regr_slope(F.log("rs"), F.log("at")).alias("h"))
    return n.join(h, list(keys), "left").select(*keys, F.when(F.col("c") >= 3, F.greatest(F.lit(0.0), F.least(F.lit(1.0), "h"))).otherwise(0.5).alias("hurst"))


def higuchi(series: DataFrame, k_max: int = 10, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, dimension) of series (keys, i, x): curve lengths at strides 1..k_max, slope in logs, within [1, 2].

    1.5 for series shorter than 2 k_max or with fewer than three lengths. The steps of a curve are added up within each
    block; those from a block to the next come from the curve's last value before it.
    """
    n = series.groupBy(*keys).agg(F.count("*").alias("__n"))

    def of(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, dict]]:
        row, i, x, null = flat(b)
        for k in range(1, k_max + 1):
            m = i % k
            order = np.lexsort((i, m, row))
            r, c, v, no = row[order], m[order], x[order], null[order]
            first = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (c[1:] != c[:-1])])
            last = np.r_[first[1:], len(v)] - 1
            with np.errstate(invalid="ignore", over="ignore"):
                d = np.r_[0.0, np.abs(v[1:] - v[:-1])]
            none = no | np.r_[True, no[:-1]]
            none[first] = True
            total = np.add.reduceat(np.where(none, 0.0, d), first)
            empty = np.add.reduceat((~none).astype(np.int64), first) == 0
            yield r[first], {"k": pa.array(np.full(len(first), k, np.int32)), "m": pa.array(c[first]), "d": pa.array(total, mask=empty), "c": pa.array(last - first + 1), "first": pa.array(v[first], mask=no[first]), "last": pa.array(v[last], mask=no[last])}

    parts = blocks(series, keys).join(n.where(F.col("__n") >= 2 * k_max), list(keys))
    x = each_batch(parts, [*keys, "__block", "__n"], of, "k int, m long, d double, c long, first double, last double")
    step = F.abs(F.col("first") - F.lag("last").over(Window.partitionBy(*keys, "k", "m").orderBy("__block")))
    x = x.withColumn("step", step).withColumn("d", F.coalesce(F.col("d") + F.col("step"), "d", "step"))
    length = x.groupBy(*keys, "k", "m", "__n").agg(F.sum("d").alias("d"), F.sum("c").alias("c")).where("c >= 2")
    length = length.withColumn("l", F.col("d") * (F.col("__n") - 1) / (F.col("k") * F.col("c") * F.col("k")))
    by_k = length.groupBy(*keys, "k").agg((F.sum("l") / F.first("k")).alias("lk")).where("lk > 0")
    by_k = by_k.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy("k")))
    d = by_k.groupBy(*keys).agg(F.count("*").alias("c"), F.regr_slope(F.log("lk"), F.log("at")).alias("d"))
    return n.join(d, list(keys), "left").select(*keys, F.when(F.col("c") >= 3, F.greatest(F.lit(1.0), F.least(F.lit(2.0), -F.col("d")))).otherwise(1.5).alias("dimension"))


def anomalies(h: DataFrame, threshold: float, by: tuple[str, ...] = KEYS, baseline: float | None = None) -> DataFrame:
    """h with base (the median, or a fixed one) and anomaly: further from it than the threshold."""
    base = h.groupBy(*by).agg(F.median("hurst").alias("base")) if baseline is None else h.select(*by).distinct().withColumn("base", F.lit(baseline))
    return h.join(base, list(by)).withColumn("anomaly", F.abs(F.col("hurst") - F.col("base")) > threshold)


def time_windows(signal: DataFrame, f: Fractal) -> DataFrame:
    """(keys, window, hurst) over tumbling windows of the magnitude; a last window of less than half counts not."""
    x = signal.select(*KEYS, F.floor(F.col("n") / f.window).alias("window"), (F.col("n") % f.window).alias("i"), F.sqrt(F.col("re") ** 2 + F.col("im") ** 2).alias("x"))
    size = signal.groupBy(*KEYS).agg(F.greatest(F.lit(1), F.floor(F.count("*") / f.window)).alias("__w"))
    x = x.join(size, list(KEYS)).where(F.col("window") < F.col("__w"))
    full = x.groupBy(*KEYS, "window").agg(F.count("*").alias("c")).where(F.col("c") >= max(16, f.window // 2)).drop("c")
    return hurst(x.join(full, [*KEYS, "window"]).select(*KEYS, "window", "i", "x"), max(8, f.window // 4), (*KEYS, "window"))


def boost_time(signal: DataFrame, grid: DataFrame, c: Stft, f: Fractal) -> DataFrame:
    """Cells of the frames that fall in an anomalous window: windows meet frames by their number."""
    bad = anomalies(time_windows(signal, f), f.threshold).where("anomaly").select(*KEYS, F.col("window").cast("long").alias("window"))
    width = f.window / c.rate
    # the frame's window, corrected where the quotient rounds across a border
    guess = F.floor(F.col("time_s") / width)
    window = guess + F.when(F.col("time_s") >= (guess + 1) * width, 1).when(F.col("time_s") < guess * width, -1).otherwise(0)
    return grid.withColumn("window", window.cast("long")).join(bad, [*KEYS, "window"], "left_semi").select(*KEYS, "k", "m")


def boost_grid(grid: DataFrame, f: Fractal) -> DataFrame:
    """Cells of the patches, a band of bins by a window of frames, whose log power has an anomalous exponent."""
    tw, step, half = max(8, f.frames), max(1, f.step), max(1, f.band // 2)
    size = grid.groupBy(*KEYS).agg(F.max("k").alias("__k"), (F.max("m") + 1).alias("__m"))
    # of the bands at multiples of the stride those within half of the bin, of the windows those that hold the frame
    steps = lambda low, high, by: F.transform(F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>")), lambda i: i * by)
    by = max(1, f.stride)
    near = steps(F.ceil(F.greatest(F.lit(0), F.col("k") - half) / by).cast("int"), F.floor(F.least(F.col("__k"), F.col("k") + half) / by).cast("int"), by)
    cells = grid.join(size, list(KEYS)).where(F.col("__m") >= tw)
    series = cells.select(*KEYS, "m", "__m", F.explode(near).alias("band"), F.log(F.col("power") + 1e-12).alias("v")).groupBy(*KEYS, "band", "m", "__m").agg(F.avg("v").alias("x"))
    t0 = steps(F.ceil(F.greatest(F.lit(0), F.col("m") - tw + 1) / step).cast("int"), F.floor(F.least(F.col("m"), F.col("__m") - tw) / step).cast("int"), step)
    windows = series.withColumn("t0", F.explode(t0)).select(*KEYS, "band", "t0", (F.col("m") - F.col("t0")).alias("i"), "x")
    h = hurst(windows, max(8, tw // 4), (*KEYS, "band", "t0"))
    enough = h.groupBy(*KEYS, "band").agg(F.count("*").alias("c")).where("c >= 5").drop("c")
    bad = anomalies(h.join(enough, [*KEYS, "band"]), f.threshold, (*KEYS, "band")).where("anomaly")
    frames = bad.select(*KEYS, "band", F.explode(F.sequence(F.col("t0"), F.col("t0") + tw - 1)).alias("m")).distinct()
    rows = frames.select(*KEYS, "m", F.explode(F.sequence(F.col("band") - half, F.col("band") + half)).alias("k")).distinct()
    return rows.join(grid.select(*KEYS, "k", "m"), [*KEYS, "k", "m"], "left_semi").select(*KEYS, "k", "m")


def combined(detections: DataFrame, boosted: DataFrame, grid: DataFrame, f: Fractal, near: bool) -> DataFrame:
    """Detected cells and the loud boosted ones; `near`: only those within a step of a detected cell."""
    bar = percentiles(grid, "power", {"__bar": f.power_percentile})
    loud = boosted.join(grid.select(*KEYS, "k", "m", "power"), [*KEYS, "k", "m"]).join(bar, list(KEYS)).where(F.col("power") > F.col("__bar"))
    if near:
        loud = loud.join(dilated(detections.select(*KEYS, "k", "m"), grid, CROSS), [*KEYS, "k", "m"], "left_semi")
    return union(detections, loud)


def boosted_detections(signal: DataFrame, grid: DataFrame, detections: DataFrame, c: Stft, f: Fractal, mode: str = "tf") -> DataFrame:
    """Detections with their boost. A mode that is not known is `time`, and so is `tf` for grids with too few frames."""
    if mode != "tf":
        return combined(detections, boost_time(signal, grid, c, f), grid, f, False)
    size = grid.groupBy(*KEYS).agg((F.max("m") + 1).alias("n")).select(*KEYS, (F.col("n") >= max(8, f.frames)).alias("__long"))
    part = lambda df, long: df.join(size.where("__long" if long else "NOT __long").select(*KEYS), list(KEYS), "left_semi")
    tf = combined(part(detections, True), boost_grid(grid, f), part(grid, True), f, True)
    short = part(grid, False)
    return tf.union(combined(part(detections, False), boost_time(part(signal, False), short, c, f), short, f, False))


def boost_statistics(detections: DataFrame, boosted: DataFrame, final: DataFrame) -> DataFrame:
    """(keys, n_cfar, n_fractal, n_combined, n_added, boost_percent)."""
    tag = lambda df, name: df.select(*KEYS, F.lit(name).alias("what"))
    n = lambda name: F.count_if(F.col("what") == name)
    x = tag(detections, "cfar").union(tag(boosted, "fractal")).union(tag(final, "all")).groupBy(*KEYS).agg(n("cfar").alias("n_cfar"), n("fractal").alias("n_fractal"), n("all").alias("n_combined"))
    return x.withColumn("n_added", F.col("n_combined") - F.col("n_cfar")).withColumn("boost_percent", 100 * F.col("n_added") / F.greatest(F.lit(1), F.col("n_cfar")))
