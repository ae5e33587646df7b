"""Sets of cells: union, difference, dilation, erosion, geodesic growth, local maxima. A set is (keys, ..., k, m)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import KEYS
from ..session import cut
from .cfar import TILE, tiled
from .graph import components_by_segment, roots
from .quantiles import percentiles

CROSS = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]
SQUARE = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
CELL = (*KEYS, "k", "m")
#: Frames of a tile that growth goes through at a time, and of a grid at most, to number a cell by row and column.
FRAMES, WIDE = 1024, 1 << 31


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*CELL).union(b.select(*CELL)).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*CELL).join(b.select(*CELL).distinct(), list(CELL), "left_semi").distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*CELL).join(b.select(*CELL), list(CELL), "left_anti").distinct()


def same(a: DataFrame, b: DataFrame) -> bool:
    return difference(a, b).limit(1).count() == 0 and difference(b, a).limit(1).count() == 0


def shifted(cells: DataFrame, steps: list[tuple[int, int]], keys: tuple[str, ...] = KEYS) -> DataFrame:
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps]))
    return cells.select(*keys, "k", "m", step.alias("s")).select(*keys, (F.col("k") + F.col("s.a")).alias("k"), (F.col("m") + F.col("s.b")).alias("m"))


def dilated(cells: DataFrame, grid: DataFrame, steps: list[tuple[int, int]] = CROSS, times: int = 1, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Cells of grid within a step of the set; outside the grid there is nothing."""
    size = grid.groupBy(*KEYS).agg(F.max("k").alias("__k"), F.max("m").alias("__m"))
    for _ in range(times):
        cells = shifted(cells, steps, keys).distinct()
    return cells.join(size, list(KEYS)).where("k >= 0 AND m >= 0 AND k <= __k AND m <= __m").drop("__k", "__m")


def eroded(cells: DataFrame, steps: list[tuple[int, int]] = CROSS, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Cells all of whose steps lie in the set."""
    hits = shifted(cells.distinct(), [(-a, -b) for a, b in steps], keys)
    return hits.groupBy(*keys, "k", "m").agg(F.count("*").alias("__c")).where(F.col("__c") == len(steps)).drop("__c")


def closed(cells: DataFrame, grid: DataFrame, steps: list[tuple[int, int]] = CROSS) -> DataFrame:
    return eroded(dilated(cells, grid, steps), steps)


def opened(cells: DataFrame, grid: DataFrame, steps: list[tuple[int, int]] = CROSS) -> DataFrame:
    return dilated(eroded(cells, steps), grid, steps)


def rectangle(height: int, width: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(-(height // 2), height - height // 2) for b in range(-(width // 2), width - width // 2)]


def grown(seeds: DataFrame, grid: DataFrame, keys: tuple[str, ...] = KEYS, rounds: int | None = 10, steps: list[tuple[int, int]] = CROSS, frames: int = FRAMES) -> DataFrame:
    """Geodesic growth of seeds (keys, k, m) through the cells of grid that are not `zero`.

    With a number of rounds, seeds in zero cells spread once and are dropped; without (rounds None), growth goes on
    until nothing changes and seeds stay. Keys may hold a cluster, which then grows on its own. A task holds `frames`
    frames of one segment and what lies within reach of them, so a long signal is many tasks.
    """
    return flooded(seeds, grid, keys, steps, frames) if rounds is None else spread(seeds, grid, keys, rounds, steps, frames)


def by_tile(cells: DataFrame, halo: int, frames: int) -> DataFrame:
    """cells with tile: that of the cell's frame, and those within whose halo it lies."""
    tile = lambda m: F.floor(m / frames)
    return cells.withColumn("tile", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), tile(F.col("m") - halo)), tile(F.col("m") + halo))))


def spread(seeds: DataFrame, grid: DataFrame, keys: tuple[str, ...], rounds: int, steps: list[tuple[int, int]], frames: int) -> DataFrame:
    """Growth by a number of rounds: what a tile holds after them depends on its halo of so many steps only."""
    halo = rounds * max(abs(b) for _, b in steps)

    def of(cells: pd.DataFrame, free: pd.DataFrame) -> pd.DataFrame:
        if not len(cells) or not len(free):
            return cells.iloc[:0][[*keys, "k", "m"]]
        first = int(free["free_m"].min())
        allowed = np.zeros((int(free["free_k"].max()) + 1, int(free["free_m"].max()) - first + 1), bool)
        allowed[free["free_k"], free["free_m"] - first] = ~free["free_zero"].to_numpy(bool)
        start = int(cells["tile"].iloc[0]) * frames
        out = []
        for name, part in cells.groupby(list(keys), sort=False):
            k, m = part["k"].to_numpy(), part["m"].to_numpy() - first
            reach = [rounds * max(abs(s[i]) for s in steps) for i in (0, 1)]
            # a box that growth cannot leave, with a rim that is never free
            k0, m0 = max(0, k.min() - reach[0]), max(0, m.min() - reach[1])
            inner = allowed[k0 : k.max() + reach[0] + 1, m0 : m.max() + reach[1] + 1]
            rim = max(abs(x) for s in steps for x in s)
            box = np.pad(inner, rim)
            now = np.zeros_like(box)
            now[k - k0 + rim, m - m0 + rim] = True
            for _ in range(rounds):
                new = np.zeros_like(now)
                for a, b in steps:
                    new |= np.roll(now, (a, b), (0, 1))
                new &= box
                if np.array_equal(new, now):
                    break
                now = new
            k, m = np.nonzero(now)
            k, m = k + k0 - rim, m + m0 - rim + first
            own = (m >= start) & (m < start + frames)
            out.append(pd.DataFrame({**dict(zip(keys, name, strict=True)), "k": k[own], "m": m[own]}))
        return pd.concat(out)

    kinds = dict(seeds.dtypes)
    schema = ", ".join(f"{n} {kinds[n]}" for n in (*keys, "k", "m"))
    some = by_tile(seeds.select(*keys, "k", "m"), halo, frames)
    free = by_tile(grid.select(*KEYS, "k", "m", "zero"), halo, frames).select(*[F.col(c).alias(f"free_{c}") for c in (*KEYS, "tile", "k", "m", "zero")])
    return some.groupBy(*KEYS, "tile").cogroup(free.groupBy("free_signal_id", "free_seg_id", "free_tile")).applyInPandas(of, schema)


def free_regions(grid: DataFrame, steps: list[tuple[int, int]] = CROSS, frames: int = FRAMES) -> tuple[DataFrame, DataFrame]:
    """The cells that are not zero with their region within their tile, and which of those regions are one.

    (keys, k, m, region) and (keys, region, root): a region is named by its first cell, a root is the least region
    that others reach across the borders of tiles; regions that touch no border have no row there.
    """
    up = [s for s in steps if s > (0, 0)]  # the steps back are the same pairs

    def of(p: pd.DataFrame) -> pd.DataFrame:
        first = int(p["m"].min())
        free = np.zeros((int(p["k"].max()) + 2, int(p["m"].max()) - first + 3), bool)
        k, m = p["k"].to_numpy() + 0, p["m"].to_numpy() - first + 1
        free[k, m] = True
        number = np.cumsum(free.ravel()).reshape(free.shape) - 1
        pairs = [np.zeros((0, 2), np.int64)]
        for a, b in up:
            other = np.roll(free, (-a, -b), (0, 1))
            other[free.shape[0] - a :] = False
            hit = free & other
            pairs.append(np.column_stack([number[hit], np.roll(number, (-a, -b), (0, 1))[hit]]))
        edges = np.concatenate(pairs)
        k, m = np.nonzero(free)
        name = k.astype(np.int64) * WIDE + (m - 1 + first)
        return pd.DataFrame({"signal_id": p["signal_id"].iloc[0], "seg_id": p["seg_id"].iloc[0], "k": k, "m": m - 1 + first, "region": name[roots(edges[:, 0], edges[:, 1], len(name))]})

    kinds = dict(grid.dtypes)
    schema = f"signal_id {kinds['signal_id']}, seg_id int, k {kinds['k']}, m {kinds['m']}, region long"
    free = grid.where("NOT zero").select(*KEYS, "k", "m", F.floor(F.col("m") / frames).alias("tile"))
    cells = cut(free.groupBy(*KEYS, "tile").applyInPandas(of, schema))
    wide = max(abs(b) for _, b in steps)
    behind = cells.where(F.col("m") % frames >= frames - wide).select(*KEYS, "k", "m", F.col("region").alias("a"))
    ahead = cells.where((F.col("m") >= frames) & (F.col("m") % frames < wide)).select(*KEYS, "k", "m", F.col("region").alias("b"))
    none = cells.limit(0).select(*KEYS, "region", F.col("region").alias("root"))
    if not ahead.limit(1).count():
        return cells, none
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps if b > 0])).alias("s")
    over = behind.select(*KEYS, "a", "k", "m", step).select(*KEYS, F.col("a"), (F.col("k") + F.col("s.a")).alias("k"), (F.col("m") + F.col("s.b")).alias("m"))
    edges = over.join(ahead, [*KEYS, "k", "m"]).where("a <> b").select(*KEYS, "a", "b").distinct()
    return cells, cut(components_by_segment(edges).select(*KEYS, F.col("node").alias("region"), "root"))


def flooded(seeds: DataFrame, grid: DataFrame, keys: tuple[str, ...], steps: list[tuple[int, int]], frames: int) -> DataFrame:
    """Growth without end: the seeds and all cells of the free regions that touch them, tiles joined by union-find."""
    cells, joined = free_regions(grid, steps, frames)
    seeds = seeds.select(*keys, "k", "m")
    touched = shifted(seeds, steps, keys).join(cells, [*KEYS, "k", "m"]).select(*keys, "region").distinct()
    touched = touched.join(joined, [*KEYS, "region"], "left").select(*keys, F.coalesce("root", "region").alias("root")).distinct()
    regions = touched.join(joined, [*KEYS, "root"]).select(*keys, "region").union(touched.select(*keys, F.col("root").alias("region"))).distinct()
    # regions end at their tile, so none is large beside a task
    return regions.join(cells, [*KEYS, "region"]).select(*keys, "k", "m").union(seeds).distinct()


def local_maxima(grid: DataFrame, value: str = "magnitude", size: int = 3) -> DataFrame:
    """grid with `is_max`: cells that equal the greatest within size // 2 cells each way; plateaus count."""
    h = size // 2
    along_m, along_k = Window.partitionBy(*KEYS, "k", "__tile").orderBy("m").rowsBetween(-h, h), Window.partitionBy(*KEYS, "m").orderBy("k").rowsBetween(-h, h)
    x = tiled(grid, h).withColumn("__r", F.max(value).over(along_m)).where(F.floor(F.col("m") / TILE) == F.col("__tile"))
    return x.withColumn("__q", F.max("__r").over(along_k)).withColumn("is_max", F.col(value) == F.col("__q")).drop("__r", "__q", "__tile")


def peaks(grid: DataFrame, value: str = "magnitude", percent: float = 0.9, size: int = 3) -> DataFrame:
    """The local maxima over a percentile of their grid."""
    bar = percentiles(grid, value, {"__bar": percent})
    return local_maxima(grid, value, size).where("is_max").join(bar, list(KEYS)).where(F.col(value) > F.col("__bar")).drop("__bar", "is_max")


def edge_rows(cells: DataFrame, n_freq: int, rows: int = 8) -> DataFrame:
    """Cells that are not in the first or last rows."""
    return cells.where((F.col("k") >= rows) & (F.col("k") < n_freq - rows))


def off_centre(cells: DataFrame, hz: float) -> DataFrame:
    """Cells whose frequency is hz or more from zero."""
    return cells.where(F.abs("freq_hz") >= hz)
