"""Clustering of detected cells. Points are (keys, k, m); labels add cluster_id, -1 for noise."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import KEYS, Cluster
from ..session import cut
from .graph import bounds, components_by_segment, roots, whole_groups
from .morphology import WIDE
from .spatial import Tree, agglomerated, dense, spanning, within

#: Points of a segment whose tree, or clusters, one task makes.
MOST = 200_000


def cell_id() -> Column:
    return F.col("k").cast("long") * WIDE + F.col("m")


def offsets(c: Cluster) -> list[tuple[int, int]]:
    """The steps within eps, none included; their number depends on eps and the weights only."""
    wk, wm = c.weights
    a, b = math.floor(c.eps / wk), math.floor(c.eps / wm)
    return [(dk, dm) for dk in range(-a, a + 1) for dm in range(-b, b + 1) if (wk * dk) ** 2 + (wm * dm) ** 2 <= c.eps**2 + 1e-12]


def neighbours(points: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    """(keys, a, b) of points a and b one step apart: steps are laid on each point and looked up by equality."""
    spark = points.sparkSession
    table = F.broadcast(spark.createDataFrame(steps, "dk int, dm int"))
    from_ = points.select(*KEYS, "k", "m", cell_id().alias("a")).crossJoin(table).select(*KEYS, "a", (F.col("k") + F.col("dk")).alias("k"), (F.col("m") + F.col("dm")).alias("m"))
    return from_.join(points.select(*KEYS, "k", "m", cell_id().alias("b")), [*KEYS, "k", "m"]).select(*KEYS, "a", "b")


def numbered(roots: DataFrame) -> DataFrame:
    """roots (keys, node, root) with cluster_id by the order of the roots in each segment."""
    return roots.withColumn("cluster_id", F.dense_rank().over(Window.partitionBy(*KEYS).orderBy("root")) - 1)


def dbscan(points: DataFrame, c: Cluster, most: int = MOST) -> DataFrame:
    """Core points: min_samples neighbours, themselves included. Clusters are the components of core points by
    their neighbourhood, numbered by their first core in row-major order; another point joins the lowest cluster
    among its core neighbours.

    Segments of at most `most` points are clustered where they lie, many to a task; larger ones by joins.
    """
    points = points.select(*KEYS, "k", "m")
    steps, keys = np.array([a * WIDE + b for a, b in offsets(c)]), list(KEYS)

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in whole_groups(parts, keys):
            ids, at = p["k"].to_numpy(np.int64) * WIDE + p["m"].to_numpy(np.int64), bounds(p, keys)
            labels = [clustered(ids[a:b], steps, c.min_samples) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield p.assign(cluster_id=np.concatenate(labels).astype(np.int32))

    kinds = dict(points.dtypes)
    schema = ", ".join(f"{n} {kinds[n]}" for n in (*KEYS, "k", "m")) + ", cluster_id int"
    large = cut(points.groupBy(*KEYS).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*KEYS))
    some = large.limit(1).count() > 0
    small = points.join(large, keys, "left_anti") if some else points
    out = small.repartition(*KEYS).sortWithinPartitions(*KEYS, "k", "m").mapInPandas(of, schema)
    return out.unionByName(dbscan_by_joins(points.join(large, keys, "left_semi"), c)) if some else out


def clustered(ids: np.ndarray, steps: np.ndarray, least: int) -> np.ndarray:
    """The cluster of each point of one segment: ids in order, steps as differences of ids."""
    n = len(ids)
    place = np.minimum(np.searchsorted(ids, ids + steps[:, None]), n - 1)
    near = ids[place] == ids + steps[:, None]
    core = near.sum(0) >= least
    link = near & core & core[place]
    a = np.broadcast_to(np.arange(n), place.shape)[link]
    root = roots(a, place[link], n)
    number = np.full(n, n)
    number[core] = np.unique(root[core], return_inverse=True)[1]
    lowest = np.where(near & core[place], number[place], n).min(0)
    out = np.where(core, number, lowest)
    return np.where(out == n, -1, out)


def dbscan_by_joins(points: DataFrame, c: Cluster) -> DataFrame:
    """The same for segments of any size."""
    near = cut(neighbours(points, offsets(c)))
    core = near.groupBy(*KEYS, "a").agg(F.count("*").alias("c")).where(F.col("c") >= c.min_samples).select(*KEYS, F.col("a").alias("b"))
    to_core = near.join(core, [*KEYS, "b"])
    links = to_core.join(core.withColumnRenamed("b", "a"), [*KEYS, "a"])
    clusters = numbered(components_by_segment(links)).select(*KEYS, F.col("node").alias("b"), "cluster_id")
    border = to_core.join(clusters, [*KEYS, "b"]).groupBy(*KEYS, "a").agg(F.min("cluster_id").alias("near"))
    out = points.withColumn("a", cell_id()).join(clusters.withColumnRenamed("b", "a"), [*KEYS, "a"], "left").join(border, [*KEYS, "a"], "left")
    return out.select(*KEYS, "k", "m", F.coalesce("cluster_id", "near", F.lit(-1)).cast("int").alias("cluster_id"))


def normalised(points: DataFrame, f_scale: float = 100.0, t_scale: float = 0.05) -> DataFrame:
    return points.select(*KEYS, "k", "m", cell_id().alias("id"), (F.col("freq_hz") / f_scale).alias("x"), (F.col("time_s") / t_scale).alias("y"))


def hdbscan(points: DataFrame, c: Cluster, most: int = MOST) -> DataFrame:
    """Components of core points within eps, of max(min_samples, 2) points or more; everything else is noise.

    Clusters are numbered by their first point in row-major order. Segments of at most `most` points are clustered
    where they lie, many to a task; larger ones by tiles of about so many. Neither lists the pairs within eps.
    """
    p, keys = cut(normalised(points)), list(KEYS)
    least = max(c.min_samples, 1)

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole_groups(parts, keys):
            at, labels = bounds(part, keys), np.full(len(part), -1, np.int32)
            for a, b in zip(at[:-1], at[1:], strict=True):
                root = within(part[["x", "y"]].to_numpy(float)[a:b], c.eps, least)
                large = (root >= 0) & (np.bincount(root + 1, minlength=1)[root + 1] >= max(least, 2))
                labels[a:b][large] = np.unique(root[large], return_inverse=True)[1]
            yield part[[*keys, "k", "m"]].assign(cluster_id=labels)

    kinds = dict(p.dtypes)
    schema = ", ".join(f"{n} {kinds[n]}" for n in (*KEYS, "k", "m")) + ", cluster_id int"
    large = cut(p.groupBy(*KEYS).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*KEYS))
    some = large.limit(1).count() > 0
    small = p.join(large, keys, "left_anti") if some else p
    out = small.repartition(*KEYS).sortWithinPartitions(*KEYS, "k", "m").mapInPandas(of, schema)
    return out.unionByName(hdbscan_by_tiles(p.join(large, keys, "left_semi"), c, most)) if some else out


def tiled(points: DataFrame, eps: float, most: int) -> DataFrame:
    """points (keys, id, x, y) with tile and own: each point in its own tile and in those that lie within eps of its cell.

    Cells have a side of eps. A tile is a run of cells, row by row, that ends with the cell in which it gets to `most`
    points: crowded cells are tiles of their own, empty stretches make none. One row a cell is counted up in order.
    """
    side = eps * (1 + 1e-9)
    p = points.withColumns({"p": F.floor(F.col("y") / side), "q": F.floor(F.col("x") / side)})
    before = F.sum("n").over(Window.partitionBy(*KEYS).orderBy("p", "q").rowsBetween(Window.unboundedPreceding, -1))
    cells = p.groupBy(*KEYS, "p", "q").agg(F.count("*").alias("n")).withColumn("tile", F.floor(F.coalesce(before, F.lit(0)) / most))
    cells = cut(cells.select(*KEYS, "p", "q", "tile"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("o")
    beside = cells.select(*KEYS, "p", "q", "tile", around).select(*KEYS, (F.col("p") + F.col("o.i")).alias("p"), (F.col("q") + F.col("o.j")).alias("q"), "tile").distinct()
    own = (F.col("tile") == F.col("home")).alias("own")
    places = beside.join(cells.withColumnRenamed("tile", "home"), [*KEYS, "p", "q"]).select(*KEYS, "p", "q", "tile", own)
    return p.join(places, [*KEYS, "p", "q"]).drop("p", "q")


def hdbscan_by_tiles(points: DataFrame, c: Cluster, most: int) -> DataFrame:
    """The same for segments of any size: a tile's dense points, then the trees of steps between them, then their components."""
    kind, least = dict(points.dtypes)["signal_id"], max(c.min_samples, 1)
    place = cut(tiled(points.select(*KEYS, "id", "x", "y"), c.eps, most))

    def core_of(p: pd.DataFrame) -> pd.DataFrame:
        return p.loc[dense(p[["x", "y"]].to_numpy(float), c.eps, least) & p["own"].to_numpy(), [*KEYS, "id"]]

    def steps_of(p: pd.DataFrame) -> pd.DataFrame:
        e, ids = spanning(p[["x", "y"]].to_numpy(float), reach=c.eps)[:, :2].astype(int), p["id"].to_numpy()
        return pd.DataFrame({"signal_id": p["signal_id"].iloc[0], "seg_id": p["seg_id"].iloc[0], "a": ids[e[:, 0]], "b": ids[e[:, 1]]})

    core = cut(place.groupBy(*KEYS, "tile").applyInPandas(core_of, f"signal_id {kind}, seg_id int, id long"))
    near = place.join(core, [*KEYS, "id"], "left_semi")
    links = near.groupBy(*KEYS, "tile").applyInPandas(steps_of, f"signal_id {kind}, seg_id int, a long, b long")
    parts = cut(components_by_segment(links))
    large = parts.groupBy(*KEYS, "root").agg(F.count("*").alias("c")).where(F.col("c") >= max(least, 2)).select(*KEYS, "root")
    clusters = numbered(parts.join(large, [*KEYS, "root"])).select(*KEYS, F.col("node").alias("id"), "cluster_id")
    return points.join(clusters, [*KEYS, "id"], "left").select(*KEYS, "k", "m", F.coalesce("cluster_id", F.lit(-1)).cast("int").alias("cluster_id"))


def spanning_tree(points: DataFrame, c: Cluster, most: int = MOST) -> DataFrame:
    """(keys, u, v, w): the minimum spanning tree by mutual reachability, ties by the points' numbers.

    A segment of at most `most` points is a task's work, by a k-d tree and rounds; larger ones are rounds of joins.
    """
    p = cut(normalised(points))
    sizes = p.groupBy(*KEYS).agg(F.count("*").alias("n"))
    large = cut(sizes.where(F.col("n") > most).select(*KEYS))

    def of(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("id")
        xy, ids = p[["x", "y"]].to_numpy(float), p["id"].to_numpy()
        e = spanning(xy, Tree(xy).kth(min(c.min_samples, len(p))))
        u, v = e[:, 0].astype(int), e[:, 1].astype(int)
        return pd.DataFrame({"signal_id": p["signal_id"].iloc[0], "seg_id": p["seg_id"].iloc[0], "u": ids[u], "v": ids[v], "w": e[:, 2]})

    kind, some = dict(points.dtypes)["signal_id"], large.limit(1).count() > 0
    small = p.join(large, list(KEYS), "left_anti") if some else p
    out = small.groupBy(*KEYS).applyInPandas(of, f"signal_id {kind}, seg_id int, u long, v long, w double")
    return out.union(spanning_rounds(p.join(large, list(KEYS), "left_semi"), c.min_samples)) if some else out


def close_pairs(left: DataFrame, right: DataFrame, more: list[str]) -> DataFrame:
    """(keys, a, b, d, columns `more` as *_a and *_b): points of left and right within their segment's radius r."""
    bucket = lambda v: F.floor(F.col(v) / F.col("r"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("o")
    of = lambda name: [F.col("id").alias(name), *[F.col(m).alias(f"{m}_{name}") for m in ("x", "y", *more)]]
    x = left.select(*KEYS, "r", *of("a"), bucket("x").alias("p"), bucket("y").alias("q"), around).withColumns({"p": F.col("p") + F.col("o.i"), "q": F.col("q") + F.col("o.j")}).drop("o")
    y = right.select(*KEYS, *of("b"), bucket("x").alias("p"), bucket("y").alias("q"))
    d = F.sqrt((F.col("x_a") - F.col("x_b")) ** 2 + (F.col("y_a") - F.col("y_b")) ** 2)
    return x.join(y, [*KEYS, "p", "q"]).withColumn("d", d).where("d <= r")


def core_distances(points: DataFrame, k: int) -> DataFrame:
    """points (keys, id, x, y, n, r) with core, the distance of the k-th nearest, itself the first.

    Points with fewer within the radius are asked again with twice as much.
    """
    left, done = points, []
    while True:
        near = close_pairs(left, points.join(left.select(*KEYS, "r").distinct().withColumnRenamed("r", "now"), list(KEYS)).withColumn("r", F.col("now")).drop("now"), [])
        place = F.row_number().over(Window.partitionBy(*KEYS, "a").orderBy("d"))
        hit = near.join(points.select(*KEYS, F.least(F.col("n"), F.lit(k)).alias("k")).distinct(), list(KEYS)).withColumn("i", place).where("i = k")
        found = cut(hit.select(*KEYS, F.col("a").alias("id"), F.col("d").alias("core")))
        done.append(found)
        left = cut(left.join(found, [*KEYS, "id"], "left_anti").withColumn("r", F.col("r") * 2))
        if not left.limit(1).count():
            break
    every = done[0]
    for f in done[1:]:
        every = every.union(f)
    return points.join(every, [*KEYS, "id"])


def mixed_buckets(points: DataFrame) -> DataFrame:
    """The points (keys, id, x, y, r, part) with another part in their bucket of side r or one beside it."""
    p = points.withColumns({"p": F.floor(F.col("x") / F.col("r")), "q": F.floor(F.col("y") / F.col("r"))})
    own = p.groupBy(*KEYS, "p", "q").agg(F.min("part").alias("lo"), F.max("part").alias("hi"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("o")
    near = own.select(*KEYS, "p", "q", "lo", "hi", around).groupBy(*KEYS, (F.col("p") + F.col("o.i")).alias("p"), (F.col("q") + F.col("o.j")).alias("q")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return p.join(near.where("lo < hi").select(*KEYS, "p", "q"), [*KEYS, "p", "q"], "left_semi").drop("p", "q")


def spanning_rounds(points: DataFrame, k: int) -> DataFrame:
    """The same tree by rounds of joins: every part takes its least edge to another, and parts that meet are one.

    Edges are those within a radius, each segment's own, between points of different parts; when they are used up the
    radius doubles. An edge within the radius is shorter than all beyond it, so no later one can take its place.
    Points around which a single part lies are not joined at all.
    """
    span = points.groupBy(*KEYS).agg(F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("dx"), (F.max("y") - F.min("y")).alias("dy"))
    side = F.greatest(F.sqrt(F.col("dx") * F.col("dy") / F.col("n")), F.greatest("dx", "dy") / F.col("n"))
    span = cut(span.select(*KEYS, "n", F.when(side > 0, side).otherwise(1.0).alias("r")))
    p = cut(core_distances(cut(points.select(*KEYS, "id", "x", "y").join(span, list(KEYS))), k).drop("r", "n"))
    part, radius, tree = cut(p.select(*KEYS, "id", F.col("id").alias("part"))), span.select(*KEYS, "r"), []
    while True:
        now = cut(mixed_buckets(p.join(radius, list(KEYS)).join(part, [*KEYS, "id"])))
        pairs = close_pairs(now, now, ["core", "part"]).withColumn("w", F.greatest("d", "core_a", "core_b")).where("a < b AND part_a <> part_b AND w <= r")
        edges = cut(pairs.select(*KEYS, F.col("a").alias("u"), F.col("b").alias("v"), "w", "part_a", "part_b"))
        while edges.limit(1).count():
            other = edges.select(*KEYS, "u", "v", "w", F.col("part_b").alias("part_a"), F.col("part_a").alias("part_b"))
            best = edges.union(other.select(*edges.columns)).groupBy(*KEYS, "part_a").agg(F.min(F.struct("w", "u", "v", "part_b")).alias("e"))
            picked = cut(best.select(*KEYS, "e.u", "e.v", "e.w", F.least("part_a", "e.part_b").alias("a"), F.greatest("part_a", "e.part_b").alias("b")).distinct())
            tree.append(picked.select(*KEYS, "u", "v", "w"))
            met = cut(components_by_segment(picked))
            to = lambda c, met=met: met.select(*KEYS, F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
            part = cut(part.join(to("part"), [*KEYS, "part"], "left").select(*KEYS, "id", F.coalesce("part_root", "part").alias("part")))
            edges = edges.join(to("part_a"), [*KEYS, "part_a"], "left").join(to("part_b"), [*KEYS, "part_b"], "left")
            edges = edges.withColumns({c: F.coalesce(f"{c}_root", c) for c in ("part_a", "part_b")})
            edges = cut(edges.where("part_a <> part_b").select(*KEYS, "u", "v", "w", "part_a", "part_b"))
        open_ = part.groupBy(*KEYS).agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select(*KEYS)
        radius = cut(radius.join(open_, list(KEYS), "left_semi").withColumn("r", F.col("r") * 2))
        if not radius.limit(1).count():
            break
    out = points.limit(0).select(*KEYS, F.col("id").alias("u"), F.col("id").alias("v"), F.col("x").alias("w"))
    for t in tree:
        out = out.union(t)
    return out


def agglomerative(points: DataFrame, n_clusters: int | None = 2, single_linkage: bool = False) -> DataFrame:
    """Merges clusters by near pairs until n_clusters are left, a segment at a time, as each merge rests on the last.

    A pair is a point and its nearest later point, and counts while the two have different labels; with
    single_linkage every pair of points counts. Neighbours come from a k-d tree, so a task's work grows with its points.
    """

    def of(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["k", "m"])
        label = agglomerated(p[["x", "y"]].to_numpy(float), n_clusters or 1, single_linkage)
        return p.assign(cluster_id=label.astype("int32"))[["signal_id", "seg_id", "k", "m", "cluster_id"]]

    kind = dict(points.dtypes)["signal_id"]
    return normalised(points).groupBy(*KEYS).applyInPandas(of, f"signal_id {kind}, seg_id int, k int, m int, cluster_id int")


#: By name; an unknown one is an error.
CLUSTERERS: dict[str, Callable[[DataFrame, Cluster], DataFrame]] = {
    "dbscan": dbscan,
    "dbscan_iso": dbscan,
    "hdbscan": hdbscan,
    "agglomerative": lambda points, c: agglomerative(points),
}


def cluster(points: DataFrame, c: Cluster) -> DataFrame:
    if c.method not in CLUSTERERS:
        raise ValueError(f"unknown method {c.method!r}; known: {', '.join(CLUSTERERS)}")
    return CLUSTERERS[c.method](points, c)
