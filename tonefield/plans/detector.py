"""Whole chains: from a signal to components, their Doppler figures and signals; trials; sliding frames."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import KEYS, PRESETS, Fractal, Preset
from ..operators import cfar, cluster, components, evaluate, fractal, morphology, stft
from ..session import cut
from ..sources import signals


@dataclass
class Found:
    """The tables of one run; each is lazy but for the grid, which is a checkpoint as every stage reads it.

    Masks need the zero cells of each grid, which are looked for when masks are first asked for.
    """

    grid: DataFrame
    detections: DataFrame
    labels: DataFrame
    components: DataFrame
    lengths: DataFrame
    full: bool

    @cached_property
    def masks(self) -> DataFrame:
        seeds = self.labels.where("cluster_id >= 0").join(self.components.select(*components.COMPONENT), list(components.COMPONENT), "left_semi")
        free = cfar.zero_map(self.grid, how="power" if self.full else "db")
        return morphology.grown(seeds, free, components.COMPONENT, None if self.full else 10, morphology.SQUARE if self.full else morphology.CROSS)


def detected(signal: DataFrame, p: Preset, n_samples: int, top: int | None = None, k_fit: str = "per_segment", grid: DataFrame | None = None) -> Found:
    """Components of every segment of signal (keys, n, re, im), each of n_samples, with the strongest first.

    The CFAR window is shrunk to the grid, whose size the segments' length tells; where none fits, nothing is
    detected.
    """
    lengths = stft.padded_length(signal, p.stft)
    grid = cut(stft.stft(signal, p.stft) if grid is None else grid)
    c = p.cfar.fitted(p.stft.bins, p.stft.frames(n_samples))
    cells = cfar.detect(grid, c, k_fit).where("detected") if c else grid.limit(0)
    detections = cut(cells.select(*KEYS, "k", "m", "freq_hz", "time_s", "power"))
    labels = cut(cluster.cluster(detections, p.cluster))
    parts = components.strongest(components.components(labels, grid), top)
    return Found(grid, detections, labels, parts, lengths, p.growth == "full")


def rebuilt(f: Found, p: Preset, real: bool = False, threshold_db: float | None = -20.0) -> DataFrame:
    return components.reconstructed(components.final_masks(f.masks, f.grid, threshold_db), f.grid, p.stft, f.lengths, real)


def trial_signals(spark: SparkSession, clean: DataFrame, snr_db: list[int], runs: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Noisy and clean copies of a signal for every SNR and run: signal_id holds the SNR, seg_id the run."""
    grid = spark.createDataFrame([(s,) for s in snr_db], "snr_db int").crossJoin(spark.range(runs).select(F.col("id").cast("int").alias("seg_id")))
    copies = clean.select("n", "re", "im").crossJoin(F.broadcast(grid)).select(F.col("snr_db").cast("string").alias("signal_id"), "seg_id", "n", "re", "im", "snr_db")
    noisy = signals.with_noise(copies, F.col("snr_db").cast("double"), seed)
    return noisy.drop("snr_db"), copies.drop("snr_db")


def monte_carlo(spark: SparkSession, snr_db: list[int], runs: int, p: Preset | None = None, n: int = 375) -> DataFrame:
    """(snr_db, sim, rqf, detected): all trials as segments of one job."""
    p = p or PRESETS["chirp"]
    noisy, clean = trial_signals(spark, signals.chirp(spark, n, p.stft.rate), snr_db, runs)
    noisy = cut(noisy)
    f = detected(noisy, p, n, top=1)
    good = f.components.where(evaluate.central(F.col("centroid_time"), n / p.stft.rate)).select(*components.COMPONENT)
    x = rebuilt(f, p).join(good, list(components.COMPONENT), "left_semi")
    r = evaluate.rqf(clean, x)
    all_ = clean.select(*KEYS).distinct().join(r, list(KEYS), "left")
    return all_.select(F.col("signal_id").cast("int").alias("snr_db"), F.col("seg_id").alias("sim"), F.coalesce("rqf", F.lit(evaluate.FAILED)).alias("rqf"), F.col("rqf").isNotNull().cast("double").alias("detected"))


def segment_statistics(signal: DataFrame, p: Preset, length: int, most: int | None = None, step: int | None = None) -> DataFrame:
    """Per signal: the roll-up over tumbling segments, or sliding ones with a step."""
    s = signals.segments(signal, length, step, most)
    f = detected(s, p, length)
    dop = components.doppler(f.labels, f.grid)
    return evaluate.segment_rollup(evaluate.segment_results(s, f.components, dop))


def frame_statistics(signal: DataFrame, p: Preset, length: int, step: int, boost: Fractal | None = None, bandwidth_hz: float | None = None, mask: str = "edge_rows", rectangle: tuple[int, int] = (5, 1)) -> DataFrame:
    """frame_stats of sliding frames: boosted or plain detections, masked, dilated by a rectangle, clustered again."""
    s = cut(signals.segments(signal, length, step))
    f = detected(s, p, length)
    cells = f.detections.select(*KEYS, "k", "m")
    if boost:
        cells = fractal.boosted_detections(s, f.grid, f.detections, p.stft, boost)
    elif bandwidth_hz is not None:
        kept = components.moving(components.doppler(f.labels, f.grid), bandwidth_hz).select(*components.COMPONENT)
        cells = f.labels.join(kept, list(components.COMPONENT), "left_semi").select(*KEYS, "k", "m")
    known = cells.join(f.grid.select(*KEYS, "k", "m", "freq_hz", "time_s"), [*KEYS, "k", "m"])
    known = morphology.edge_rows(known, p.stft.bins) if mask == "edge_rows" else morphology.off_centre(known, 8 * p.stft.rate / p.stft.length)
    wide = cut(morphology.dilated(known, f.grid, morphology.rectangle(*rectangle)).join(f.grid.select(*KEYS, "k", "m", "freq_hz", "time_s"), [*KEYS, "k", "m"]))
    added = morphology.difference(wide, f.detections).groupBy(*KEYS).agg(F.count("*").alias("n_added"))
    labels = cluster.cluster(wide, p.cluster)
    n = labels.groupBy(*KEYS).agg(F.count("*").alias("n_pixels"), F.count_distinct(F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))).alias("n_clusters"))
    out = s.select(*KEYS).distinct().join(n, list(KEYS), "left").join(added, list(KEYS), "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_pixels", "n_clusters", "n_added")}
    t0 = F.col("seg_id") * (step / p.stft.rate)
    return out.withColumns(zero).select("signal_id", F.col("seg_id").alias("frame_idx"), t0.alias("t_start"), (t0 + length / p.stft.rate).alias("t_end"), "n_pixels", "n_clusters", "n_added")


def round_trip(signal: DataFrame, p: Preset, real: bool = False) -> DataFrame:
    """(keys, rqf) of the transform and its inverse over the whole grid."""
    return evaluate.rqf(signal, stft.istft(stft.stft(signal, p.stft), p.stft, stft.padded_length(signal, p.stft), real))
