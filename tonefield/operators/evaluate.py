"""Evaluation: reconstruction quality, roll-ups of trials and segments, distributions, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import KEYS
from ..session import cut
from .quantiles import alike, marked, percentiles

#: What stands for the quality of a trial in which nothing was found.
FAILED = -10.0


def rqf(clean: DataFrame, rebuilt: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, rqf): 10 log10 of signal over error energy on the common samples; 100 where there is no error."""
    x = clean.select(*keys, "n", F.col("re").alias("a"), F.col("im").alias("b")).join(rebuilt.select(*keys, "n", F.col("re").alias("c"), F.col("im").alias("d")), [*keys, "n"])
    s = x.groupBy(*keys).agg(F.sum(F.col("a") ** 2 + F.col("b") ** 2).alias("s"), F.sum((F.col("a") - F.col("c")) ** 2 + (F.col("b") - F.col("d")) ** 2).alias("e"))
    return s.select(*keys, F.when(F.col("e") < 1e-15, 100.0).otherwise(10 * F.log10(F.col("s") / F.col("e"))).alias("rqf"))


def central(centroid_time: Column, duration: Column | float) -> Column:
    """Whether a centroid lies less than half the duration from the middle."""
    return F.abs(centroid_time - duration / 2) < 0.5 * duration


def trials_rollup(trials: DataFrame) -> DataFrame:
    """Per snr_db: mean and spread of rqf, share detected, count; a missing rqf counts as failed."""
    r = F.coalesce("rqf", F.lit(FAILED))
    return trials.groupBy("snr_db").agg(F.avg(r).alias("rqf_mean"), F.stddev_pop(r).alias("rqf_std"), F.avg(F.coalesce("detected", F.lit(0.0))).alias("detection_rate"), F.count("*").alias("n_simulations"))


def segment_results(segments: DataFrame, parts: DataFrame, dop: DataFrame) -> DataFrame:
    """A row per segment: component count, energy, and the Doppler figures of the strongest; zero where none."""
    n = parts.groupBy(*KEYS).agg(F.count("*").alias("n_components"), F.sum("energy").alias("energy"))
    w = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("energy"), "cluster_id"))
    top = dop.withColumn("__r", w).where("__r = 1").select(*KEYS, "doppler_freq_hz", "velocity_estimate_mps")
    out = segments.select(*KEYS).distinct().join(n, list(KEYS), "left").join(top, list(KEYS), "left")
    return out.withColumn("n_components", F.coalesce("n_components", F.lit(0))).withColumn("energy", F.coalesce("energy", F.lit(0.0)))


def segment_rollup(results: DataFrame) -> DataFrame:
    """Per signal: the statistics of its segments; Doppler means over the segments that have one."""
    return results.groupBy("signal_id").agg(
        F.count("*").alias("n_segments"), F.avg("n_components").alias("mean_components"), F.stddev_pop("n_components").alias("std_components"), F.sum("energy").alias("total_energy"), F.count_if(F.col("n_components") > 0).alias("detection_segments"),
        F.count("doppler_freq_hz").alias("n_detections_with_doppler"), F.avg("doppler_freq_hz").alias("mean_doppler_freq_hz"), F.avg("velocity_estimate_mps").alias("mean_velocity_mps"), (100.0 * F.count_if(F.col("n_components") > 0) / F.count("*")).alias("detection_percent"),
    )


def placed(values: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """values (keys, value) with __i, the place from 0 in the order of the key's values, and __c, their count.

    Ranges of values are dealt to tasks, which number their own; what lies before a range is added from the counts.
    """
    dealt = cut(values.repartitionByRange(*keys, "value").withColumn("__p", F.spark_partition_id()))
    sizes = dealt.groupBy(*keys, "__p").agg(F.count("*").alias("__own"))
    w = Window.partitionBy(*keys)
    sizes = sizes.select(*keys, "__p", (F.sum("__own").over(w.orderBy("__p")) - F.col("__own")).alias("__before"), F.sum("__own").over(w).alias("__c"))
    own = F.row_number().over(Window.partitionBy(*keys, "__p").orderBy("value")) - 1
    out = dealt.withColumn("__i", own).join(sizes.withColumnsRenamed({k: f"__k_{k}" for k in keys}), [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys] + [dealt["__p"] == sizes["__p"]])
    return out.select(*values.columns, (F.col("__i") + F.col("__before")).alias("__i"), "__c")


def ecdf(values: DataFrame, keys: tuple[str, ...] = ("metric",)) -> DataFrame:
    """values (keys, value) with cum_prob: rank over count; equal values get steps of their own."""
    return placed(values, keys).withColumn("cum_prob", (F.col("__i") + 1) / F.col("__c")).drop("__i", "__c")


def ecdf_summary(values: DataFrame, keys: tuple[str, ...] = ("metric",)) -> DataFrame:
    rest = values.groupBy(*keys).agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    q = marked(percentiles(values, "value", {"median": 0.5, "q25": 0.25, "q75": 0.75}, keys), keys)
    return rest.join(q, alike(rest, q, keys), "left").select(*keys, "min", "max", "median", "q25", "q75", "mean", "std")


def quantile_marker(values: DataFrame, q: float, keys: tuple[str, ...] = ("metric",)) -> DataFrame:
    """(keys, marker): the sorted value at place int(q x count)."""
    return placed(values, keys).where(F.col("__i") == F.floor(q * F.col("__c"))).select(*keys, F.col("value").alias("marker"))


def histogram(values: DataFrame, bins: int, keys: tuple[str, ...] = ("metric",)) -> DataFrame:
    """(keys, bin, low, high, n, density) over equal bins from least to greatest value, the last closed above."""
    span = values.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("total"))
    span = span.withColumn("w", F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0 / bins))
    x = values.join(span, list(keys)).withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("lo")) / F.col("w"))).cast("int"))
    n = x.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    out = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(n, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select(*keys, "bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("high"), "n", (F.col("n") / (F.col("total") * F.col("w"))).alias("density"))


def histogram_2d(points: DataFrame, bins: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, bx, by, n) of points (keys, x, y) over equal bins of both ranges; empty bins are left out."""
    span = points.groupBy(*keys).agg(*[f(c).alias(f"{n}_{c}") for c in "xy" for f, n in ((F.min, "lo"), (F.max, "hi"))])
    x = points.join(span, list(keys)) if keys else points.crossJoin(F.broadcast(span))
    at = lambda c: F.least(F.lit(bins - 1), F.floor((F.col(c) - F.col(f"lo_{c}")) * bins / (F.col(f"hi_{c}") - F.col(f"lo_{c}")))).cast("int")
    return x.groupBy(*keys, at("x").alias("bx"), at("y").alias("by")).agg(F.count("*").alias("n"))


def signal_summary(signal: DataFrame) -> DataFrame:
    """Per segment: extent, mean and spread of both parts and the magnitude, phase range, power, dynamic range."""
    p = F.col("re") ** 2 + F.col("im") ** 2
    x = signal.withColumns({"mag": F.sqrt(p), "pow": p, "phase": F.atan2("im", "re")})
    four = [f(c).alias(f"{c}_{n}") for c in ("re", "im", "mag") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_pop))]
    out = x.groupBy(*KEYS).agg(F.count("*").alias("n_samples"), *four, F.min("phase").alias("phase_min"), F.max("phase").alias("phase_max"), F.avg("pow").alias("power_mean"), F.max("pow").alias("power_max"))
    return out.withColumn("dynamic_range_db", 10 * F.log10((F.col("power_max") + 1e-12) / (F.col("power_mean") + 1e-12)))


def running(signal: DataFrame, width: int) -> DataFrame:
    """(keys, n, mean, std) of the magnitude over n .. n + width - 1, whole windows only."""
    w = Window.partitionBy(*KEYS).orderBy("n").rowsBetween(0, width - 1)
    x = signal.withColumn("mag", F.sqrt(F.col("re") ** 2 + F.col("im") ** 2))
    return x.select(*KEYS, "n", F.avg("mag").over(w).alias("mean"), F.stddev_pop("mag").over(w).alias("std"), F.count("mag").over(w).alias("c")).where(F.col("c") == width).drop("c")


def autocorrelation(signal: DataFrame, first: int = 2000, lags: int = 500) -> DataFrame:
    """(keys, lag, acf) of the magnitude's first samples, in standard units, over its value at lag 0."""
    x = signal.where(F.col("n") < first).select(*KEYS, "n", F.sqrt(F.col("re") ** 2 + F.col("im") ** 2).alias("x"))
    s = x.groupBy(*KEYS).agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd"))
    z = x.join(s, list(KEYS)).select(*KEYS, "n", ((F.col("x") - F.col("mu")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)).alias("z"))
    left = z.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(lags - 1)))).withColumn("at", F.col("n") + F.col("lag"))
    acf = left.join(z.select(*KEYS, F.col("n").alias("at"), F.col("z").alias("y")), [*KEYS, "at"]).groupBy(*KEYS, "lag").agg(F.sum(F.col("z") * F.col("y")).alias("s"))
    return acf.withColumn("acf", F.col("s") / F.max(F.when(F.col("lag") == 0, F.col("s"))).over(Window.partitionBy(*KEYS))).drop("s")


def marginals(grid: DataFrame) -> DataFrame:
    """Mean level by bin and by frame in one pass: (keys, k, m, mean_db), one of k and m null."""
    db = grid.withColumn("db", 10 * F.log10(F.col("power") + 1e-12))
    sets = [[*KEYS, "k"], [*KEYS, "m"]]
    return db.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in (*KEYS, "k", "m")]).agg(F.avg("db").alias("mean_db"))


def coverage(cells: DataFrame, grid: DataFrame) -> DataFrame:
    """(keys, percent): the share of a segment's grid that a set of cells covers."""
    hit = grid.select(*KEYS, "k", "m").join(cells.select(*KEYS, "k", "m").distinct().withColumn("hit", F.lit(1)), [*KEYS, "k", "m"], "left")
    return hit.groupBy(*KEYS).agg((100 * F.avg(F.coalesce("hit", F.lit(0)))).alias("percent"))


def nearest_bin(ranges: DataFrame, targets: DataFrame) -> DataFrame:
    """(file_id, range_bin, clutter_bin): the bin nearest to the target, the lower of two, and one far from it."""
    x = ranges.join(targets, "file_id").withColumn("d", F.abs(F.col("range_m") - F.col("target_m")))
    best = x.groupBy("file_id").agg(F.min(F.struct("d", "range_bin")).alias("b"), F.count("*").alias("bins")).select("file_id", F.col("b.range_bin").alias("range_bin"), "bins")
    return best.select("file_id", "range_bin", F.when(F.col("range_bin") > F.col("bins") / 2, 0).otherwise(F.col("bins") - 1).cast("int").alias("clutter_bin"))


def frame_summary(frames: DataFrame, by: tuple[str, ...] = ("signal_id",)) -> DataFrame:
    """Totals, means and maxima of frame_stats (n_pixels, n_clusters), and the share of frames with any cluster."""
    return frames.groupBy(*by).agg(F.count("*").alias("n_frames"), F.sum("n_pixels").alias("total_pixels"), F.avg("n_pixels").alias("mean_pixels"), F.max("n_pixels").alias("max_pixels"), F.sum("n_clusters").alias("total_clusters"), F.avg("n_clusters").alias("mean_clusters"), (100 * F.avg((F.col("n_clusters") > 0).cast("int"))).alias("active_percent"))
