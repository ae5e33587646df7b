"""Separation by triangles over spectral peaks. Peaks are (keys, pid, k, m, freq_hz, time_s, magnitude)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import KEYS
from ..session import cut
from .evaluate import placed
from .graph import components_by_segment
from .morphology import peaks

#: How far points are moved at most, and twice the area, in units of the scales, under which a triangle is flat.
NUDGE, FLAT = 1e-6, 1e-9
#: Points of a strip, and of a segment that one task triangulates.
MANY = 2000


def numbered_peaks(grid: DataFrame, percent: float = 0.9, distance: int = 3) -> DataFrame:
    x = peaks(grid.withColumn("magnitude", F.sqrt("power")), "magnitude", percent, distance)
    pid = F.row_number().over(Window.partitionBy(*KEYS).orderBy("k", "m")) - 1
    return x.select(*KEYS, pid.alias("pid"), "k", "m", "freq_hz", "time_s", "magnitude")


def moved(pid, which: int):
    """What is added to a coordinate of a point, so that no four lie on a circle and no three on a line: a fixed share of NUDGE by its number."""
    by, modulus = ((7919, 10007), (104729, 10009))[which]
    return NUDGE * (pid * by % modulus) / modulus


def sides(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Twice the area of the triangles a, b, c, positive counter-clockwise."""
    return (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])


def delaunay(points: np.ndarray) -> np.ndarray:
    """Triangles (rows of three indices) of points in general position; fewer than three points have none.

    Points are put in one by one. A point removes the triangles whose circumcircle holds it and joins the rim of the
    hole. Beyond each edge of the hull there is a triangle to a point at infinity, number n, whose circle is the half
    plane behind the edge, so that the hull is exact. All triangles are tested at once.
    """
    n = len(points)
    if n < 3:
        return np.zeros((0, 3), int)
    xy = np.vstack([points, [[0.0, 0.0]]])
    tri = np.array([[0, 1, 2] if sides(xy[0], xy[1], xy[2]) > 0 else [0, 2, 1]])
    tri = np.concatenate([tri, [[b, a, n] for a, b in zip(tri[0], np.roll(tri[0], -1), strict=True)]])
    for i in range(3, n):
        d = xy[tri] - xy[i]
        last = tri[:, 2] == n
        z = (d**2).sum(2)
        cross = lambda p, q: d[:, p, 0] * d[:, q, 1] - d[:, p, 1] * d[:, q, 0]  # noqa: E731,B023
        inside = z[:, 0] * cross(1, 2) + z[:, 1] * cross(2, 0) + z[:, 2] * cross(0, 1) > 0
        inside[last] = cross(0, 1)[last] > 0
        bad = tri[inside]
        edges = np.concatenate([bad[:, [0, 1]], bad[:, [1, 2]], bad[:, [2, 0]]])
        # an edge of the rim is not there the other way round
        code = edges[:, 0] * (n + 1) + edges[:, 1]
        rim = edges[~np.isin(code, edges[:, 1] * (n + 1) + edges[:, 0])]
        new = np.column_stack([rim, np.full(len(rim), i)])
        # infinity comes last
        new[rim[:, 0] == n] = new[rim[:, 0] == n][:, [1, 2, 0]]
        new[rim[:, 1] == n] = new[rim[:, 1] == n][:, [2, 0, 1]]
        tri = np.concatenate([tri[~inside], new])
    return tri[(tri < n).all(1)]


def circles(xy: np.ndarray, tri: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and radii of the circumcircles."""
    a, b, c = (xy[tri[:, i]] for i in range(3))
    b, c = b - a, c - a
    d = 2 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0])
    p, q = (b**2).sum(1), (c**2).sum(1)
    centre = np.column_stack([c[:, 1] * p - b[:, 1] * q, b[:, 0] * q - c[:, 0] * p]) / d[:, None]
    return a + centre, np.hypot(centre[:, 0], centre[:, 1])


TRIANGLE = "v0 long, v1 long, v2 long"


def triangles(peaks_: DataFrame, f_scale: float = 100.0, t_scale: float = 0.05, many: int = MANY) -> DataFrame:
    """(keys, tid, v0, v1, v2), vertices ascending: the Delaunay triangles of each segment's peaks.

    Peaks are moved by a hair, told by their numbers, so that the triangles are one set; triangles without area are
    left out. A segment of at most `many` peaks is one task, larger ones are triangulated by parts.
    """
    p = peaks_.select(*KEYS, F.col("pid").cast("long").alias("pid"), (F.col("freq_hz") / f_scale).alias("x0"), (F.col("time_s") / t_scale).alias("y0"))
    p = cut(p.withColumns({"x": F.col("x0") + moved(F.col("pid"), 0), "y": F.col("y0") + moved(F.col("pid"), 1)}))
    found = parts(p.select(*KEYS, "pid", "x", "y"), many)
    corner = lambda v: p.select(*KEYS, F.col("pid").alias(v), F.struct("x0", "y0").alias(f"p_{v}"))
    for v in ("v0", "v1", "v2"):
        found = found.join(corner(v), [*KEYS, v])
    of = lambda i, j, c: F.col(f"p_v{i}.{c}0") - F.col(f"p_v{j}.{c}0")
    area = of(1, 0, "x") * of(2, 0, "y") - of(1, 0, "y") * of(2, 0, "x")
    found = found.where(F.abs(area) > FLAT).select(*KEYS, F.struct("v0", "v1", "v2").alias("value"))
    return placed(found, KEYS).select(*KEYS, F.col("__i").cast("long").alias("tid"), *[F.col(f"value.{v}").cast("int").alias(v) for v in ("v0", "v1", "v2")])


def parts(points: DataFrame, many: int) -> DataFrame:
    """(keys, v0, v1, v2) of points (keys, pid, x, y) in general position.

    A large segment is cut along y into strips of about `many` points. A strip is triangulated with the strips beside
    it; a triangle whose circle ends within those three is certain, as no other point can lie in it. Points all of
    whose triangles are certain are done. The others, few, are triangulated by themselves, in the same way if they
    are many, and of their triangles those are right in whose circle no point lies that was done.
    """
    sizes = cut(points.groupBy(*KEYS).agg(F.count("*").alias("n"), F.min("y").alias("y0"), F.max("y").alias("y1")))
    kind = dict(points.dtypes)["signal_id"]

    def whole(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("pid")
        t = np.sort(p["pid"].to_numpy()[delaunay(p[["x", "y"]].to_numpy())].reshape(-1, 3), axis=1)
        return pd.DataFrame({"signal_id": p["signal_id"].iloc[0], "seg_id": p["seg_id"].iloc[0], "v0": t[:, 0], "v1": t[:, 1], "v2": t[:, 2]})

    schema = f"signal_id {kind}, seg_id int, {TRIANGLE}"
    large = sizes.where(F.col("n") > many)
    if not large.limit(1).count():
        return points.groupBy(*KEYS).applyInPandas(whole, schema)
    rest = points.join(large.select(*KEYS), list(KEYS), "left_anti").groupBy(*KEYS).applyInPandas(whole, schema)

    # strips of like many points: thin slices in order, told by how many points come before
    sliced = points.join(large, list(KEYS)).withColumn("slice", F.floor((F.col("y") - F.col("y0")) / (F.col("y1") - F.col("y0")) * 64 * F.ceil(F.col("n") / many)))
    slices = sliced.groupBy(*KEYS, "slice").agg(F.count("*").alias("c"), F.min("y").alias("from"), F.max("y").alias("to"))
    slices = slices.withColumn("s", F.floor((F.sum("c").over(Window.partitionBy(*KEYS).orderBy("slice")) - F.col("c")) / many))
    strips = slices.groupBy(*KEYS, "s").agg(F.min("from").alias("low"), F.max("to").alias("high"))
    order = Window.partitionBy(*KEYS).orderBy("s")
    strips = strips.withColumns({"s": F.row_number().over(order) - 1, "raw": F.col("s"), "below": F.lag("low").over(order), "above": F.lead("high").over(order), "before": F.lag("s", 2).over(order), "after": F.lead("s", 2).over(order)})
    # beyond the first and the last strip there is nothing; the strip after the next begins what is not seen
    strips = cut(strips.select(*KEYS, "raw", F.col("s").cast("long").alias("s"), "low", "high", F.when(F.col("before").isNull(), F.lit(float("-inf"))).otherwise(F.col("below")).alias("from"), F.when(F.col("after").isNull(), F.lit(float("inf"))).otherwise(F.col("above")).alias("to")))
    placed_ = cut(sliced.join(slices.select(*KEYS, "slice", F.col("s").alias("raw")), [*KEYS, "slice"]).join(strips.select(*KEYS, "raw", "s"), [*KEYS, "raw"]).select(*KEYS, "pid", "x", "y", "s"))
    around = placed_.withColumn("strip", F.explode(F.sequence(F.col("s") - 1, F.col("s") + 1))).join(strips.select(*KEYS, F.col("s").alias("strip"), "from", "to"), [*KEYS, "strip"])

    def strip(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("pid")
        xy, pid = p[["x", "y"]].to_numpy(), p["pid"].to_numpy()
        t = delaunay(xy)
        centre, radius = circles(xy, t)
        sure = (centre[:, 1] - radius > p["from"].iloc[0]) & (centre[:, 1] + radius < p["to"].iloc[0])
        # a point is done if its triangles are certain and close around it: each edge from it is met from both sides
        open_ = np.zeros(len(p), bool)
        open_[t[~sure].ravel()] = True
        edges = np.concatenate([t[:, [0, 1]], t[:, [1, 2]], t[:, [2, 0]]])
        lone = edges[~np.isin(edges[:, 0] * len(p) + edges[:, 1], edges[:, 1] * len(p) + edges[:, 0])]
        open_[lone.ravel()] = True
        seen = np.zeros(len(p), bool)
        seen[t.ravel()] = True
        open_ = (open_ | ~seen) & (p["s"] == p["strip"]).to_numpy()
        v = np.sort(pid[t[sure]].reshape(-1, 3), axis=1)
        rows = pd.DataFrame({"v0": v[:, 0], "v1": v[:, 1], "v2": v[:, 2]})
        rows = pd.concat([rows, pd.DataFrame({"v0": pid[open_], "v1": -1, "v2": -1})], ignore_index=True)
        return rows.assign(signal_id=p["signal_id"].iloc[0], seg_id=p["seg_id"].iloc[0])[["signal_id", "seg_id", "v0", "v1", "v2"]]

    found = cut(around.groupBy(*KEYS, "strip").applyInPandas(strip, schema))
    sure = found.where("v1 >= 0").distinct()
    left = found.where("v1 < 0").select(*KEYS, F.col("v0").alias("pid"))
    some = cut(placed_.join(left, [*KEYS, "pid"], "left_semi").select(*KEYS, "pid", "x", "y"))
    # where cutting does not make less of a segment, it is one task
    most = some.groupBy(*KEYS).agg(F.count("*").alias("c")).join(large, list(KEYS)).where(F.col("c") > F.col("n") / 2).limit(1).count()
    seams = cut(parts(some, 1 << 62 if most else many))

    corners = seams
    for v in ("v0", "v1", "v2"):
        corners = corners.join(some.select(*KEYS, F.col("pid").alias(v), F.col("x").alias(f"x_{v}"), F.col("y").alias(f"y_{v}")), [*KEYS, v])
    x1, y1, x2, y2 = (F.col(f"{c}_{v}") - F.col(f"{c}_v0") for v in ("v1", "v2") for c in ("x", "y"))
    d, p1, p2 = 2 * (x1 * y2 - y1 * x2), x1 * x1 + y1 * y1, x2 * x2 + y2 * y2
    ux, uy = (y2 * p1 - y1 * p2) / d, (x1 * p2 - x2 * p1) / d
    corners = corners.select(*KEYS, "v0", "v1", "v2", (F.col("x_v0") + ux).alias("cx"), (F.col("y_v0") + uy).alias("cy"), F.sqrt(ux * ux + uy * uy).alias("radius"))
    spans = strips.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("s", "low", "high"))).alias("strips"))
    met = corners.join(spans, list(KEYS)).withColumn("strip", F.explode(F.filter("strips", lambda s: (s["high"] >= F.col("cy") - F.col("radius")) & (s["low"] <= F.col("cy") + F.col("radius"))))).select(*KEYS, F.col("strip.s").alias("strip"), "v0", "v1", "v2", "cx", "cy", "radius")

    def held(t: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        xy, bad = p[["x", "y"]].to_numpy(), np.zeros(len(t), bool)
        for i, (cx, cy, r) in enumerate(zip(t["cx"], t["cy"], t["radius"], strict=True)):
            bad[i] = (np.hypot(xy[:, 0] - cx, xy[:, 1] - cy) < r * (1 - 1e-9)).any()
        return t[bad][["signal_id", "seg_id", "v0", "v1", "v2"]]

    done = placed_.join(left, [*KEYS, "pid"], "left_anti").select(*[F.col(c).alias(f"of_{c}") for c in KEYS], F.col("s").alias("of_strip"), "x", "y")
    wrong = met.groupBy(*KEYS, "strip").cogroup(done.groupBy(*[f"of_{c}" for c in KEYS], "of_strip")).applyInPandas(held, schema).distinct()
    right = seams.join(wrong, [*KEYS, "v0", "v1", "v2"], "left_anti")
    return rest.unionByName(sure).unionByName(right.select(*sure.columns)).distinct()


def triangle_edges(tri: DataFrame) -> DataFrame:
    e = lambda a, b: F.struct(F.col(a).alias("u"), F.col(b).alias("v"))
    return tri.select(*KEYS, "tid", F.explode(F.array(e("v0", "v1"), e("v1", "v2"), e("v0", "v2"))).alias("e")).select(*KEYS, "tid", "e.u", "e.v")


def triangle_groups(tri: DataFrame, peaks_: DataFrame, connectivity: float = 0.1) -> DataFrame:
    """tri with `root`: triangles that share an edge, two and no more, and differ little in mean magnitude."""
    corner = tri.select(*KEYS, "tid", F.explode(F.array("v0", "v1", "v2")).alias("pid")).join(peaks_.select(*KEYS, "pid", "magnitude"), [*KEYS, "pid"])
    mean = corner.groupBy(*KEYS, "tid").agg(F.avg("magnitude").alias("mean"))
    pair = triangle_edges(tri).groupBy(*KEYS, "u", "v").agg(F.count("*").alias("c"), F.min("tid").alias("a"), F.max("tid").alias("b")).where("c = 2")
    of = lambda n: mean.select(*KEYS, F.col("tid").alias(n), F.col("mean").alias(f"m_{n}"))
    pair = pair.join(of("a"), [*KEYS, "a"]).join(of("b"), [*KEYS, "b"])
    close = F.abs(F.col("m_a") - F.col("m_b")) / F.greatest("m_a", "m_b") < connectivity
    own = tri.select(*KEYS, F.col("tid").alias("a"), F.col("tid").alias("b"))
    roots = components_by_segment(pair.where(close).select(*KEYS, "a", "b").union(own))
    return tri.join(roots.withColumnRenamed("node", "tid"), [*KEYS, "tid"])


def triangle_components(groups: DataFrame, peaks_: DataFrame) -> DataFrame:
    """(keys, component_id, n_triangles, n_points, energy, centroid_freq, centroid_time) by falling energy."""
    n = groups.groupBy(*KEYS, "root").agg(F.count("*").alias("n_triangles"))
    points = groups.select(*KEYS, "root", F.explode(F.array("v0", "v1", "v2")).alias("pid")).distinct().join(peaks_, [*KEYS, "pid"])
    x = points.groupBy(*KEYS, "root").agg(F.count("*").alias("n_points"), F.sum(F.col("magnitude") ** 2).alias("energy"), F.avg("freq_hz").alias("centroid_freq"), F.avg("time_s").alias("centroid_time"))
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("energy"), "root")) - 1
    return x.join(n, [*KEYS, "root"]).withColumn("component_id", rank).drop("root")


def separated(grid: DataFrame, percent: float = 0.9, distance: int = 3, connectivity: float = 0.1) -> DataFrame:
    found = numbered_peaks(grid, percent, distance)
    return triangle_components(triangle_groups(triangles(found), found, connectivity), found)


def has_vertex(v: str | int) -> Column:
    return F.array_contains(F.array("v0", "v1", "v2"), F.lit(v))


def edge_opposite(v: str | int) -> Column:
    """The two other vertices of a triangle."""
    return F.array_except(F.array("v0", "v1", "v2"), F.array(F.lit(v)))
