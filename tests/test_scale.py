"""What keeps work in bounded tasks, against plain restatements: tiles, trees, percentiles."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonefield.config import Cluster
from tonefield.operators import cfar, cluster, components, morphology, quantiles, spatial, triangulate

CELL = "signal_id string, seg_id int, k int, m int"


def plain_growth(allowed, seeds, rounds, steps):
    """By sets of cells, round by round over the whole grid."""
    free = {(int(k), int(m)) for k, m in zip(*np.nonzero(allowed))}
    now, n = set(seeds), 0
    while rounds is None or n < rounds:
        new = {(k + a, m + b) for k, m in now for a, b in steps} & free
        new |= set(seeds) if rounds is None else set()
        if new == now:
            break
        now, n = new, n + 1
    return now


@pytest.mark.parametrize("steps", [morphology.CROSS, morphology.SQUARE])
@pytest.mark.parametrize("rounds", [None, 0, 1, 4])
def test_growth_over_tiles(spark, steps, rounds):
    rng = np.random.default_rng(4)
    rows, seeds, want = [], [], set()
    for s, (bins, frames, share) in enumerate([(9, 70, 0.6), (1, 40, 0.8), (12, 33, 0.45)]):
        allowed = rng.random((bins, frames)) < share
        rows += [(f"s{s}", 0, k, m, not bool(allowed[k, m])) for k in range(bins) for m in range(frames)]
        for c in (0, 1):
            own = [(int(k), int(m)) for k, m in zip(rng.integers(0, bins, 4), rng.integers(0, frames, 4))]
            seeds += [(f"s{s}", 0, k, m, c) for k, m in own]
            want |= {(f"s{s}", c, k, m) for k, m in plain_growth(allowed, own, rounds, steps)}
    grid = spark.createDataFrame(rows, CELL + ", zero boolean")
    df = spark.createDataFrame(seeds, CELL + ", cluster_id int").distinct()
    for frames in (8, 1024):  # many tiles, and one
        out = morphology.grown(df, grid, ("signal_id", "seg_id", "cluster_id"), rounds, steps, frames).collect()
        assert len(out) == len(want) and {(r["signal_id"], r["cluster_id"], r["k"], r["m"]) for r in out} == want


def test_a_spiral_is_one_region(spark):
    """A way that leaves and enters tiles many times."""
    n = 41
    way = np.zeros((n, n), bool)
    r, c, d, run = 0, 0, 0, n - 1
    way[0, 0] = True
    while run > 0:
        for _ in range(2 if run < n - 1 else 3):
            for _ in range(run):
                r, c = r + (0, 1, 0, -1)[d], c + (1, 0, -1, 0)[d]
                way[r, c] = True
            d = (d + 1) % 4
        run -= 2
    grid = spark.createDataFrame([("a", 0, k, m, not bool(way[k, m])) for k in range(n) for m in range(n)], CELL + ", zero boolean")
    out = morphology.grown(spark.createDataFrame([("a", 0, 0, 0)], CELL), grid, rounds=None, frames=4)
    assert out.count() == way.sum()


@pytest.mark.parametrize("few", [5, 1_000_000])
def test_percentiles(spark, few):
    rng = np.random.default_rng(1)
    groups = {"normal": rng.normal(size=700), "ties": rng.integers(0, 3, 400).astype(float), "wide": 10.0 ** rng.uniform(-300, 300, 300) * rng.choice([-1, 1], 300), "one": np.ones(50), "single": np.array([4.0]), None: rng.exponential(size=90), "ends": np.r_[-1.7e308, np.zeros(60), 1.7e308]}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("normal", None), ("nothing", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = {"low": 0.0, "q": 0.25, "mid": 0.5, "p": 0.9371, "top": 1.0}
    out = {r["g"]: r for r in quantiles.percentiles(df, "v", shares, ("g",), few).collect()}
    assert set(out) == set(groups)
    for g, x in groups.items():
        for name, p in shares.items():
            at, s = p * (len(x) - 1), np.sort(x)
            a, b = s[math.floor(at)], s[math.ceil(at)]
            assert out[g][name] == pytest.approx(a if a == b else (math.ceil(at) - at) * a + (at - math.floor(at)) * b, rel=1e-12)


def plain_tree(xy, core):
    """Prim's algorithm over all pairs: the weights of the tree."""
    best, todo, now, out = np.full(len(xy), np.inf), np.ones(len(xy), bool), 0, []
    for _ in range(len(xy) - 1):
        todo[now] = False
        d = np.maximum(np.maximum(np.hypot(*(xy - xy[now]).T), core), core[now])
        best = np.where(todo & (d < best), d, best)
        now = int(np.where(todo, best, np.inf).argmin())
        out.append(best[now])
    return np.sort(out)


def plain_merges(xy, goal, single):
    """Pairs sorted by distance, labels written over."""
    n, label = len(xy), np.arange(len(xy))
    if single:
        i, j = np.triu_indices(n, 1)
    else:
        i = np.arange(n - 1)
        j = np.array([r + 1 + int(((xy[r + 1 :] - xy[r]) ** 2).sum(1).argmin()) for r in i], int)
    d = np.sqrt(((xy[i] - xy[j]) ** 2).sum(1)) if n > 1 else np.zeros(0)
    for e in np.argsort(d, kind="stable"):
        if len(np.unique(label)) <= goal:
            break
        if label[i[e]] != label[j[e]]:
            label[label == label[j[e]]] = label[i[e]]
    return np.unique(label, return_inverse=True)[1]


@pytest.mark.parametrize("n", [1, 2, 3, 17, 60, 150])
def test_tree_against_all_pairs(n):
    rng = np.random.default_rng(n)
    for lattice in (False, True):
        xy = rng.integers(0, 12, (n, 2)).astype(float) if lattice else rng.normal(size=(n, 2))
        k = min(4, n)
        core = spatial.Tree(xy).kth(k)
        assert np.allclose(core, [np.sort(np.hypot(*(xy - x).T))[k - 1] for x in xy])
        e = spatial.spanning(xy, core)
        assert len(e) == n - 1 and np.allclose(np.sort(e[:, 2]), plain_tree(xy, core))
        for goal in (1, 3):
            for single in (False, True):
                assert (spatial.agglomerated(xy, goal, single) == plain_merges(xy, goal, single)).all()


def test_spanning_tree_by_rounds(spark):
    rng = np.random.default_rng(8)
    rows = []
    for name, cells in {"far": rng.integers(0, 30, (70, 2)), "line": np.column_stack([np.zeros(20, int), rng.permutation(60)[:20]]), "lone": np.array([[3, 3]]), "two": np.array([[0, 0], [40, 90]])}.items():
        rows += [(name, 0, int(k), int(m), k * 100.0, m * 0.05) for k, m in {tuple(x) for x in cells.tolist()}]
    df = spark.createDataFrame(rows, CELL + ", freq_hz double, time_s double")
    c = Cluster(min_samples=3)
    key = ["signal_id", "u", "v"]
    tasks = cluster.spanning_tree(df, c).toPandas().sort_values(key).reset_index(drop=True)
    rounds = cluster.spanning_tree(df, c, most=0).toPandas().sort_values(key).reset_index(drop=True)
    assert (tasks[key] == rounds[key]).all().all() and np.allclose(tasks["w"], rounds["w"])
    for name, part in df.toPandas().groupby("signal_id"):
        xy = np.column_stack([part["freq_hz"] / 100, part["time_s"] / 0.05])
        core = np.array([np.sort(np.hypot(*(xy - x).T))[min(3, len(xy)) - 1] for x in xy])
        assert np.allclose(np.sort(tasks[tasks["signal_id"] == name]["w"]), plain_tree(xy, core))


def test_many_points_in_one_task():
    xy = np.unique(np.random.default_rng(0).integers(0, 700, (21_000, 2)), axis=0)[:20_000].astype(float)
    assert len(np.unique(spatial.agglomerated(xy, 4, False))) == 4
    assert len(spatial.spanning(xy)) == len(xy) - 1


def plain_triangles(xy):
    """All triples in whose circumcircle no other point lies, by the determinant."""
    out, n = set(), len(xy)
    for i in range(n):
        for j in range(i + 1, n):
            for k in range(j + 1, n):
                a, b, c = xy[i], xy[j], xy[k]
                if triangulate.sides(a, b, c) < 0:
                    b, c = c, b
                rest = np.delete(np.arange(n), [i, j, k])
                d = np.stack([np.broadcast_to(p, (len(rest), 2)) - xy[rest] for p in (a, b, c)], 1)
                if not (np.linalg.det(np.concatenate([d, (d**2).sum(2, keepdims=True)], 2)) > 0).any():
                    out.add((i, j, k))
    return out


@pytest.mark.parametrize("lattice", [False, True])
def test_delaunay_is_exact(lattice):
    rng = np.random.default_rng(3)
    for n in (3, 4, 9, 24):
        xy = np.array(sorted({tuple(x) for x in rng.integers(0, 7, (n, 2)).tolist()}), float) if lattice else rng.random((n, 2))
        pid = np.arange(len(xy))
        xy = xy + np.column_stack([triangulate.moved(pid, 0), triangulate.moved(pid, 1)])
        if len(xy) >= 3:
            assert {tuple(sorted(t)) for t in triangulate.delaunay(xy).tolist()} == plain_triangles(xy)


def test_delaunay_by_parts(spark):
    rng = np.random.default_rng(6)
    rows = []
    for name, xy in {"wide": rng.integers(0, [40, 400], (420, 2)), "dense": rng.integers(0, [30, 30], (300, 2)), "curve": np.array([[int((t - 60) ** 2 / 40), t] for t in range(120)]), "few": np.array([[0, 0], [3, 1], [1, 4], [5, 5]]), "none": np.array([[1, 1], [2, 2]])}.items():
        for pid, (k, m) in enumerate(sorted({tuple(x) for x in xy.tolist()})):
            rows.append((name, 0, pid, k * 100.0, m * 0.05))
    df = spark.createDataFrame(rows, "signal_id string, seg_id int, pid int, freq_hz double, time_s double")
    key = ["signal_id", "tid", "v0", "v1", "v2"]
    one = triangulate.triangles(df, many=10_000).toPandas().sort_values(key)[key].reset_index(drop=True)
    many = triangulate.triangles(df, many=40).toPandas().sort_values(key)[key].reset_index(drop=True)
    assert len(one) > 1000 and one.equals(many)


@pytest.mark.parametrize(("bins", "frames", "guard", "reach"), [(12, 15, 1, 3), (70, 40, 0, 2), (140, 33, 2, 6), (5, 50, 1, 3), (7, 7, 1, 3), (50, 60, 3, 17)])
def test_sliding_order_equals_sorting(bins, frames, guard, reach):
    rng = np.random.default_rng(bins)
    cells = (2 * reach + 1) ** 2 - (2 * guard + 1) ** 2
    for x in (rng.exponential(size=(bins, frames)), rng.integers(0, 4, (bins, frames)).astype(float)):
        for rank in (1, int(0.75 * cells), cells):
            assert np.array_equal(cfar.sliding_order(x, guard, reach, rank), cfar.sorted_order(x, guard, reach, rank), equal_nan=True)


def test_background_of_large_grids_is_strided(spark):
    """Every s-th cell in row-major order where there are more than are fitted."""
    x = np.random.default_rng(5).exponential(size=(40, 60))
    x[:3] = 0
    grid = spark.createDataFrame([("a", 0, k, m, float(x[k, m])) for k in range(40) for m in range(60)], CELL + ", power double").repartition(6)
    for most in (100, 700, 20_000):
        out = cfar.k_parameters(grid, most=most).first()
        v = x.ravel()[x.ravel() > 1e-12]
        bar = np.sort(v)[[int(np.floor(0.95 * (len(v) - 1))), int(np.ceil(0.95 * (len(v) - 1)))]]
        at = 0.95 * (len(v) - 1)
        low = v[v <= bar[0] + (at - np.floor(at)) * (bar[1] - bar[0])]
        low = low[:: len(low) // most if len(low) > most else 1]
        assert out["n"] == len(low) and out["mean"] == pytest.approx(low.mean()) and out["var"] == pytest.approx(low.var())


def test_vertices_and_moving_components(spark):
    tri = spark.createDataFrame([(0, 1, 2), (1, 2, 3), (0, 2, 4)], "v0 int, v1 int, v2 int")
    assert tri.where(triangulate.has_vertex(2)).count() == 3 and tri.where(triangulate.has_vertex(4)).count() == 1
    rest = [r["e"] for r in tri.where(triangulate.has_vertex(1)).orderBy("v0").select(triangulate.edge_opposite(1).alias("e")).collect()]
    assert rest == [[0, 2], [2, 3]]
    dop = spark.createDataFrame([(0, 2.9), (1, 3.0), (2, 8.0)], "cluster_id int, doppler_bandwidth_hz double")
    assert sorted(r["cluster_id"] for r in components.moving(dop).collect()) == [1, 2]


def plain_dense(xy, eps, least):
    """Labels of components of dense points, of max(least, 2) points or more, numbered by their first."""
    near = np.hypot(xy[:, None, 0] - xy[None, :, 0], xy[:, None, 1] - xy[None, :, 1]) <= eps
    core, label, n = near.sum(1) >= least, np.full(len(xy), -1), 0
    seen = np.zeros(len(xy), bool)
    for i in np.flatnonzero(core):
        if not seen[i]:
            own, stack = [], [i]
            seen[i] = True
            while stack:
                own.append(stack.pop())
                new = np.flatnonzero(near[own[-1]] & core & ~seen)
                seen[new] = True
                stack += new.tolist()
            if len(own) >= max(least, 2):
                label[own] = n
                n += 1
    return label


def test_density_clusters_by_tiles_and_in_tasks(spark):
    rng = np.random.default_rng(21)
    crowd = [(a, b) for a in range(9) for b in range(9)] + [(30, int(b)) for b in rng.permutation(80)[:30]]
    rows, cells = [], {"crowd": crowd, "thin": {tuple(x) for x in rng.integers(0, 40, (160, 2)).tolist()}, "lone": [(3, 3)], "two": [(0, 0), (0, 1)]}
    for name, some in cells.items():
        rows += [(name, 0, int(k), int(m), k * 100.0, m * 0.05) for k, m in some]
    df = spark.createDataFrame(rows, CELL + ", freq_hz double, time_s double")
    for eps, least in ((1.0, 2), (2.5, 4), (3.0, 1), (4.0, 12)):
        c = Cluster("hdbscan", eps, least)
        for most in (cluster.MOST, 0, 25):
            if most == 0:  # every segment by tiles, of a cell each
                got = cluster.hdbscan_by_tiles(cluster.normalised(df), c, 1).toPandas()
            else:
                got = cluster.hdbscan(df, c, most=most).toPandas()
            assert len(got) == len(rows)
            for name, part in got.groupby("signal_id"):
                part = part.sort_values(["k", "m"])
                xy = np.column_stack([part["k"] * 100.0 / 100.0, part["m"] * 0.05 / 0.05])
                assert (part["cluster_id"].to_numpy() == plain_dense(xy, eps, least)).all(), (name, eps, least, most)
    empty = cluster.hdbscan(df.limit(0), Cluster("hdbscan", 2.0, 3))
    assert empty.count() == 0 and empty.columns[-1] == "cluster_id"


def test_a_crowd_gives_no_pairs():
    side = 300
    xy = np.column_stack([np.repeat(np.arange(side), side), np.tile(np.arange(side), side)]) / side
    began = time.perf_counter()
    root = spatial.within(xy, 2.0, 10)  # 90,000 points, all within eps of each other: 8.1 thousand million pairs
    assert (root == 0).all() and time.perf_counter() - began < 60
