"""Components: clusters of cells with their energy, centroid, Doppler figures, masks and signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import KEYS, Stft
from .morphology import CROSS, dilated, eroded
from .stft import istft

#: Speed of light as the velocity formula has it; 299792458 may be passed instead.
LIGHT = 3e8
COMPONENT = (*KEYS, "cluster_id")


def velocity(freq_hz: Column, rf_hz: float = 9.39e9, c: float = LIGHT) -> Column:
    return freq_hz * c / (2 * rf_hz)


def members(labels: DataFrame, grid: DataFrame) -> DataFrame:
    """The cells of all clusters with what their grid knows of them."""
    return labels.where("cluster_id >= 0").join(grid, [*KEYS, "k", "m"])


def components(labels: DataFrame, grid: DataFrame) -> DataFrame:
    """A row per cluster: n_points, energy, and the mean frequency and time of its cells."""
    return members(labels, grid).groupBy(*COMPONENT).agg(F.count("*").alias("n_points"), F.sum("power").alias("energy"), F.avg("time_s").alias("centroid_time"), F.avg("freq_hz").alias("centroid_freq"))


def grown_components(masks: DataFrame, grid: DataFrame) -> DataFrame:
    """A row per grown mask (component keys, k, m): energy over the mask, centroid over its distinct rows and columns."""
    cells = masks.join(grid, [*KEYS, "k", "m"])
    energy = cells.groupBy(*COMPONENT).agg(F.count("*").alias("n_cells"), F.sum("power").alias("energy"))
    freq = cells.select(*COMPONENT, "freq_hz").distinct().groupBy(*COMPONENT).agg(F.avg("freq_hz").alias("centroid_freq"))
    time = cells.select(*COMPONENT, "time_s").distinct().groupBy(*COMPONENT).agg(F.avg("time_s").alias("centroid_time"))
    return energy.join(freq, list(COMPONENT)).join(time, list(COMPONENT))


def strongest(parts: DataFrame, n: int | None, by: tuple[str, ...] = KEYS) -> DataFrame:
    """The n components of most energy in each segment, ranked from 1; of equal ones the lower cluster_id."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("energy"), "cluster_id"))
    out = parts.withColumn("rank", rank)
    return out if n is None else out.where(F.col("rank") <= n)


def doppler(labels: DataFrame, grid: DataFrame, rf_hz: float = 9.39e9, c: float = LIGHT) -> DataFrame:
    """A row per cluster: mean frequency, bandwidth, population spread, velocity."""
    x = members(labels, grid).groupBy(*COMPONENT).agg(
        F.avg("freq_hz").alias("doppler_freq_hz"), (F.max("freq_hz") - F.min("freq_hz")).alias("doppler_bandwidth_hz"), F.stddev_pop("freq_hz").alias("doppler_std_hz"), F.avg("time_s").alias("centroid_time_s"), F.sum("power").alias("energy")
    )
    return x.withColumn("velocity_estimate_mps", velocity(F.col("doppler_freq_hz"), rf_hz, c))


def moving(dop: DataFrame, least_bandwidth_hz: float = 3.0) -> DataFrame:
    return dop.where(F.col("doppler_bandwidth_hz") >= least_bandwidth_hz)


def cluster_info(labels: DataFrame, grid: DataFrame, rf_hz: float = 9.39e9, c: float = 299792458.0, pad_t: float = 0.02, pad_f: float = 10.0) -> DataFrame:
    """A row per cluster: points, spreads, velocity, its padded box, and whether it approaches."""
    x = members(labels, grid).groupBy(*COMPONENT).agg(
        F.count("*").alias("n_points"), F.sum("power").alias("energy"), F.avg("freq_hz").alias("freq_mean"), F.stddev_pop("freq_hz").alias("freq_std"), F.avg("time_s").alias("time_mean"), F.stddev_pop("time_s").alias("time_std"),
        (F.min("time_s") - pad_t).alias("t_low"), (F.max("time_s") + pad_t).alias("t_high"), (F.min("freq_hz") - pad_f).alias("f_low"), (F.max("freq_hz") + pad_f).alias("f_high"),
    )
    x = x.withColumn("velocity", velocity(F.col("freq_mean"), rf_hz, c))
    return x.withColumn("approaching", F.col("velocity") > 0)


def relative_db(grid: DataFrame) -> DataFrame:
    """grid with `db`: the level under the segment's peak."""
    peak = grid.groupBy(*KEYS).agg(F.max("power").alias("__peak"))
    return grid.join(peak, list(KEYS)).withColumn("db", 10 * F.log10(F.col("power") / (F.col("__peak") + 1e-10) + 1e-10)).drop("__peak")


def region_db(grid: DataFrame, t0: float | None = None, t1: float | None = None, f0: float | None = None, f1: float | None = None) -> DataFrame:
    """The cells of a region, times and frequencies between bounds, with `db`: the level under the region's own peak."""
    inside = F.lit(True)
    for c, low, high in (("time_s", t0, t1), ("freq_hz", f0, f1)):
        inside = inside & (F.col(c) >= low if low is not None else F.lit(True)) & (F.col(c) <= high if high is not None else F.lit(True))
    return relative_db(grid.where(inside))


def final_masks(masks: DataFrame, grid: DataFrame, threshold_db: float | None = -20.0) -> DataFrame:
    """The masks (component keys, k, m) from which signals are rebuilt.

    With a threshold: the loud cells of the segment within five steps of the mask, or all loud cells where that is
    less than the mask. Without: the mask closed and opened.
    """
    if threshold_db is None:
        return opened_by_component(closed_by_component(masks, grid), grid)
    loud = relative_db(grid).where(F.col("db") > threshold_db).select(*KEYS, "k", "m")
    near = dilated(masks, grid, CROSS, 5, COMPONENT).join(loud, [*KEYS, "k", "m"], "left_semi").select(*COMPONENT, "k", "m")
    count = masks.groupBy(*COMPONENT).agg(F.count("*").alias("c")).join(near.groupBy(*COMPONENT).agg(F.count("*").alias("d")), list(COMPONENT), "left")
    poor = count.where(F.coalesce("d", F.lit(0)) < F.col("c")).select(*COMPONENT)
    return near.join(poor, list(COMPONENT), "left_anti").union(poor.join(loud, list(KEYS)).select(*COMPONENT, "k", "m"))


def local_masks(masks: DataFrame, grid: DataFrame, steps: int = 5, threshold_db: float = -20.0) -> DataFrame:
    """The masks (component keys, k, m) of the plain detector: the cells within `steps` of a mask that are loud beside the loudest of them.

    Where that leaves less than the mask has, all cells within `steps`.
    """
    near = dilated(masks, grid, CROSS, steps, COMPONENT).join(grid.select(*KEYS, "k", "m", "power"), [*KEYS, "k", "m"])
    peak = near.groupBy(*COMPONENT).agg(F.max("power").alias("__peak"))
    db = 10 * F.log10(F.col("power") / (F.col("__peak") + 1e-12) + 1e-12)
    near = near.join(peak, list(COMPONENT)).withColumn("__loud", db > threshold_db)
    kept = near.groupBy(*COMPONENT).agg(F.count_if("__loud").alias("__d")).join(masks.groupBy(*COMPONENT).agg(F.count("*").alias("__c")), list(COMPONENT))
    return near.join(kept, list(COMPONENT)).where(F.col("__loud") | (F.col("__d") < F.col("__c"))).select(*COMPONENT, "k", "m")


def closed_by_component(masks: DataFrame, grid: DataFrame) -> DataFrame:
    return eroded(dilated(masks, grid, CROSS, 1, COMPONENT), CROSS, COMPONENT)


def opened_by_component(masks: DataFrame, grid: DataFrame) -> DataFrame:
    return dilated(eroded(masks, CROSS, COMPONENT), grid, CROSS, 1, COMPONENT).select(*COMPONENT, "k", "m")


def reconstructed(masks: DataFrame, grid: DataFrame, c: Stft, lengths: DataFrame, real: bool = False) -> DataFrame:
    """(component keys, n, re, im): the inverse transform of each mask's cells; lengths: (keys, original_length)."""
    cells = masks.join(grid.select(*KEYS, "k", "m", "re", "im"), [*KEYS, "k", "m"])
    name = F.concat_ws("\x00", F.col("signal_id"), F.col("cluster_id"))
    ids = masks.select(*COMPONENT).distinct().join(lengths.select(*KEYS, "original_length"), list(KEYS))
    x = istft(cells.withColumn("signal_id", name), c, ids.select(name.alias("signal_id"), "seg_id", "original_length"), real)
    parts = F.split("signal_id", "\x00")
    return x.select(parts[0].alias("signal_id"), "seg_id", parts[1].cast("int").alias("cluster_id"), "n", "re", "im")


def summed(signals: DataFrame) -> DataFrame:
    """The sum of all components' signals, sample by sample."""
    return signals.groupBy(*KEYS, "n").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


