"""Adaptive detection on grids: neighbourhood means by two passes of window sums, thresholds, order statistics."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import KEYS, Cfar
from ..functions.special import factor, k_multiplier, k_shape, order_rank, ring_cells
from .quantiles import percentiles


#: Frames of a tile, bins whose rings are followed at a time, cells of a ring that is rather put in order.
TILE, BAND, SORTED = 4096, 64, 800


def bands(c: Cfar) -> dict[str, tuple[int, int]]:
    """Offsets along one axis: before and behind the guard, within it, and all of them."""
    g, t = c.guard, c.reach
    return {"before": (-t, -g - 1), "behind": (g + 1, t), "inner": (-g, g), "all": (-t, t)}


def tiled(grid: DataFrame, halo: int) -> DataFrame:
    """grid with __tile: each cell in its tile of TILE frames and in those whose halo it belongs to, so that a long signal is many tasks."""
    tile = lambda m: F.floor(m / TILE)
    return grid.withColumn("__tile", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), tile(F.col("m") - halo)), tile(F.col("m") + halo))))


def region_sums(grid: DataFrame, c: Cfar, regions: dict[str, tuple[str, str]], value: str = "power") -> DataFrame:
    """grid with the sum of `value` over each region, a pair of bands in k and m. Two sorts, however many regions."""
    span = bands(c)
    along_m, along_k = Window.partitionBy(*KEYS, "k", "__tile").orderBy("m"), Window.partitionBy(*KEYS, "m").orderBy("k")
    rows = {b: F.coalesce(F.sum(value).over(along_m.rowsBetween(*span[b])), F.lit(0.0)).alias(f"__{b}") for _, b in regions.values()}
    first = tiled(grid, c.reach).select("*", *rows.values()).where(F.floor(F.col("m") / TILE) == F.col("__tile"))
    sums = [F.coalesce(F.sum(f"__{b}").over(along_k.rowsBetween(*span[a])), F.lit(0.0)).alias(name) for name, (a, b) in regions.items()]
    return first.select(*grid.columns, *sums)


CORNERS = {"c1": ("before", "before"), "c2": ("before", "behind"), "c3": ("behind", "before"), "c4": ("behind", "behind")}
SIDES = {"up": ("before", "all"), "down": ("behind", "all"), "left": ("all", "before"), "right": ("all", "behind")}
SHORT_SIDES = SIDES | {"left": ("inner", "before"), "right": ("inner", "behind")}
RING = {"outer": ("all", "all"), "core": ("inner", "inner")}


def _of(regions: dict, pick: Callable[..., Column]) -> Callable[[DataFrame, Cfar, str], DataFrame]:
    def noise(grid: DataFrame, c: Cfar, value: str) -> DataFrame:
        span = {k: b - a + 1 for k, (a, b) in bands(c).items()}
        means = [F.col(n) / float(span[a] * span[b]) for n, (a, b) in regions.items()]
        return region_sums(grid, c, regions, value).withColumn("noise", pick(*means)).drop(*regions)

    return noise


def _ring(grid: DataFrame, c: Cfar, value: str) -> DataFrame:
    return region_sums(grid, c, RING, value).withColumn("noise", (F.col("outer") - F.col("core")) / float(ring_cells(c))).drop("outer", "core")


def ring_order(x: np.ndarray, guard: int, reach: int, rank: int) -> np.ndarray:
    """The rank-th least value of the ring about each cell that has a whole one, nan elsewhere; large rings by histograms."""
    cells = (2 * reach + 1) ** 2 - (2 * guard + 1) ** 2
    return (sorted_order if cells <= SORTED else sliding_order)(x, guard, reach, rank)


def sorted_order(x: np.ndarray, guard: int, reach: int, rank: int) -> np.ndarray:
    """Each ring is put in order by itself: its cost follows the ring's area."""
    t, g, out = reach, guard, np.full(x.shape, np.nan)
    ring = np.ones((2 * t + 1, 2 * t + 1), bool)
    ring[t - g : t + g + 1, t - g : t + g + 1] = False
    if min(x.shape) > 2 * t:
        view = np.lib.stride_tricks.sliding_window_view(x, ring.shape)
        for i in range(view.shape[0]):
            out[i + t, t : t + view.shape[1]] = np.partition(view[i][:, ring], rank - 1, axis=1)[:, rank - 1]
    return out


def sliding_order(x: np.ndarray, guard: int, reach: int, rank: int) -> np.ndarray:
    """Values become their place in the order of all values of a band of rows. Along the frames each row keeps a histogram
    of its ring in two levels; a step puts the columns that enter into it and takes those out that leave, so its cost
    follows the ring's sides and not its area, and the value is found by two sums over bins.
    """
    out = np.full(x.shape, np.nan)
    t, g = reach, guard
    for top in range(t, x.shape[0] - t, BAND):
        rows = np.arange(min(BAND, x.shape[0] - t - top))
        part = x[top - t : top + len(rows) + t]
        if part.shape[1] <= 2 * t:
            break
        values, place = np.unique(part, return_inverse=True)
        place = place.reshape(part.shape)
        base = int(np.ceil(np.sqrt(len(values))))
        # of each row, the bins of the column's cells within the reach, and within the guard, in two levels
        bins = [np.lib.stride_tricks.sliding_window_view(y, 2 * t + 1, axis=0) for y in (place, place // base)]
        fine, coarse = np.zeros((len(rows), base * base), np.int64), np.zeros((len(rows), base), np.int64)
        row = rows[:, None]
        levels = [(h.ravel(), y, row * h.shape[1]) for h, y in zip((fine, coarse), bins, strict=True)]

        def change(columns: list[int], guards: list[int], by: int, levels=levels) -> None:
            """Counts the ring's cells in some columns, those of the guard being taken back."""
            for h, y, shift in levels:
                for j in columns:
                    np.add.at(h, (y[:, j] + shift).ravel(), by)
                for j in guards:
                    np.add.at(h, (y[:, j, t - g : t + g + 1] + shift).ravel(), -by)

        change(list(range(2 * t + 1)), list(range(t - g, t + g + 1)), 1)
        for m in range(t, part.shape[1] - t):
            if m > t:
                change([m + t], [m + g], 1)
                change([m - t - 1], [m - g - 1], -1)
            sums = np.cumsum(coarse, axis=1)
            c = (sums >= rank).argmax(1)
            left = rank - (sums[rows, c] - coarse[rows, c])
            f = (np.cumsum(fine[row, c[:, None] * base + np.arange(base)], axis=1) >= left[:, None]).argmax(1)
            out[top + rows, m] = values[c * base + f]
    return out


def _order(grid: DataFrame, c: Cfar, value: str) -> DataFrame:
    """The order statistic of the ring, not separable: numpy over tiles of frames, each with its halo."""
    g, t, tile = c.guard, c.reach, 512
    rank = order_rank((2 * t + 1) ** 2 - (2 * g + 1) ** 2)
    tiles = grid.withColumn("__tile", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("m") - t) / tile)), F.floor((F.col("m") + t) / tile))))

    def of(p: pd.DataFrame) -> pd.DataFrame:
        k, m, first = p["k"].to_numpy(), p["m"].to_numpy(), int(p["__tile"].iloc[0]) * tile
        m0 = m.min()
        x = np.zeros((k.max() + 1, m.max() - m0 + 1))
        x[k, m - m0] = p[value].to_numpy()
        noise = ring_order(x, g, t, rank)
        own = (m >= first) & (m < first + tile)
        return p[own].drop(columns="__tile").assign(noise=noise[k[own], m[own] - m0])

    fields = ", ".join(f"{n} {d}" for n, d in grid.dtypes)
    return tiles.groupBy(*KEYS, "__tile").applyInPandas(of, f"{fields}, noise double")


#: Noise estimators by name; others may be added.
METHODS: dict[str, Callable[[DataFrame, Cfar, str], DataFrame]] = {
    "ca": _ring,
    "goca": _of(CORNERS, F.greatest),
    "soca": _of(CORNERS, F.least),
    "goca_sides": _of(SIDES, F.greatest),
    "soca_bands": _of(SHORT_SIDES, F.least),
    "os": _order,
}


def k_parameters(grid: DataFrame, value: str = "power", per: tuple[str, ...] = KEYS, least: int = 1000, most: int = 20_000) -> DataFrame:
    """(keys, n, mean, var): moments of the background from which K clutter is fitted, a row per segment.

    Cells over 1e-12, of which there must be `least`; not over their 95th percentile; every s-th in row-major
    order where they are more than `most`; then those over 1e-10.
    """
    x = grid.where(F.col(value) > 1e-12)
    enough = x.groupBy(*per).agg(F.count("*").alias("__n")).where(F.col("__n") >= least)
    x = x.join(enough, list(per))
    x = x.join(percentiles(x, value, {"__p": 0.95}, per), list(per)).where(F.col(value) <= F.col("__p"))
    # the place in row-major order: that within the row of bins, and the cells of the rows before
    rows = x.groupBy(*per, "k").agg(F.count("*").alias("__r"))
    by_row = Window.partitionBy(*per).orderBy("k")
    rows = rows.withColumn("__before", F.sum("__r").over(by_row) - F.col("__r")).withColumn("__c", F.sum("__r").over(Window.partitionBy(*per)))
    x = x.withColumn("__i", F.row_number().over(Window.partitionBy(*per, "k").orderBy("m")) - 1).join(rows, [*per, "k"]).withColumn("__i", F.col("__i") + F.col("__before"))
    stride = F.when(F.col("__c") > most, F.floor(F.col("__c") / most)).otherwise(1)
    x = x.where((F.col("__i") % stride == 0) & (F.col(value) > 1e-10))
    return x.groupBy(*per).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("var"))


def k_factors(grid: DataFrame, c: Cfar, value: str = "power", k_fit: str = "per_segment") -> DataFrame:
    """(keys, shape, factor, fitted): multipliers by segment; segments without a fit get shape 2, and say so.

    k_fit "first" takes the fit of each signal's first segment for all. The inverse gamma function runs once a
    segment, in batches.
    """

    def of(parts):
        for p in parts:
            shape = [k_shape(m, v)[0] if m == m and m is not None else 2.0 for m, v in zip(p["mean"], p["var"], strict=True)]
            yield pd.DataFrame({"signal_id": p["signal_id"], "seg_id": p["seg_id"], "shape": shape, "factor": [k_multiplier(c.pfa, s) for s in shape], "fitted": p["mean"].notna()})

    fits = grid.select(*KEYS).distinct().join(k_parameters(grid, value), list(KEYS), "left")
    if k_fit == "first":
        w = Window.partitionBy("signal_id").orderBy("seg_id")
        fits = fits.select(*KEYS, *[F.first(n).over(w).alias(n) for n in ("mean", "var")])
    kind = dict(grid.dtypes)["signal_id"]
    return fits.select(*KEYS, "mean", "var").mapInPandas(of, f"signal_id {kind}, seg_id int, shape double, factor double, fitted boolean")


def detect(grid: DataFrame, c: Cfar, k_fit: str = "per_segment") -> DataFrame:
    """grid with noise, threshold and detected, its interior only; a cell whose window leaves the grid never counts."""
    if c.method not in METHODS:
        raise ValueError(f"unknown method {c.method!r}; known: {', '.join(METHODS)}")
    if c.train < 1:
        return grid.withColumns({"noise": F.lit(None).cast("double"), "threshold": F.lit(None).cast("double"), "detected": F.lit(False)}).limit(0)
    value = "power"
    if c.value == "magnitude":
        grid, value = grid.withColumn("magnitude", F.sqrt("power")), "magnitude"
    size = grid.groupBy(*KEYS).agg(F.max("k").alias("__k"), F.max("m").alias("__m"))
    t = c.reach
    out = METHODS[c.method](grid, c, value).join(size, list(KEYS)).where(F.col("k").between(t, F.col("__k") - t) & F.col("m").between(t, F.col("__m") - t)).drop("__k", "__m")
    if c.threshold == "k":
        out = out.join(k_factors(grid, c, value, k_fit).select(*KEYS, "factor"), list(KEYS)).withColumn("threshold", F.col("noise") * F.col("factor")).drop("factor")
    else:
        out = out.withColumn("threshold", F.col("noise") * factor(c))
    return out.withColumn("detected", F.col(value) > F.col("threshold") if c.strict else F.col(value) >= F.col("threshold"))


def zero_map(grid: DataFrame, percent: float = 0.05, how: str = "db") -> DataFrame:
    """grid with `zero`: the weakest cells. db: below the percentile of the levels; power: not above that of the power."""
    level = 10 * F.log10(F.col("power") + 1e-12) if how == "db" else F.col("power") if how == "power" else F.sqrt("power")
    x = grid.withColumn("__v", level)
    bar = percentiles(x, "__v", {"__bar": percent})
    low = F.col("__v") <= F.col("__bar") if how == "power" else F.col("__v") < F.col("__bar")
    return x.join(bar, list(KEYS)).withColumn("zero", low).drop("__v", "__bar")
