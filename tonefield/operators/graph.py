"""Connected components of graphs: per segment where a segment bounds them, over the whole table otherwise."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import KEYS
from ..session import cut

#: Edges of a segment that one task takes.
MOST = 2_000_000


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of n nodes reaches by the edges a-b."""
    low = np.arange(n)
    while True:
        best = low.copy()
        np.minimum.at(best, a, low[b])
        np.minimum.at(best, b, low[a])
        best = np.minimum(best, best[best])
        if np.array_equal(best, low):
            return low
        low = best


def whole_groups(parts: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames in which each group, whose rows follow each other, is whole; many small groups share a frame."""
    rest: list[pd.DataFrame] = []
    for p in parts:
        if not len(p):
            continue
        last = (p[keys] == p[keys].iloc[-1]).all(axis=1).to_numpy()
        goes_on = bool(rest) and (rest[-1][keys].iloc[-1] == p[keys].iloc[-1]).all()
        if last.all() and (goes_on or not rest):
            rest.append(p)
            continue
        at = 0 if last.all() else int(np.flatnonzero(~last)[-1]) + 1
        yield pd.concat([*rest, p.iloc[:at]], ignore_index=True)
        rest = [p.iloc[at:]]
    if rest:
        yield pd.concat(rest, ignore_index=True)


def bounds(p: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where the groups of a frame begin, and its end."""
    new = (p[keys] != p[keys].shift()).any(axis=1).to_numpy()
    return np.r_[np.flatnonzero(new), len(p)]


def components_by_segment(edges: DataFrame, most: int = MOST) -> DataFrame:
    """(keys, node, root) of edges (keys, a, b): segments of `most` edges at most in tasks of many segments, larger ones by `components`."""
    edges = cut(edges.select(*KEYS, "a", "b"))
    sizes = edges.groupBy(*KEYS).agg(F.count("*").alias("n"))
    large = cut(sizes.where(F.col("n") > most).select(*KEYS))
    keys = list(KEYS)

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in whole_groups(parts, keys):
            segment = np.repeat(np.arange(len(bounds(p, keys)) - 1), np.diff(bounds(p, keys)))
            node = np.concatenate([p["a"].to_numpy(), p["b"].to_numpy()])
            both = np.concatenate([segment, segment])
            order = np.lexsort((node, both))
            new = np.r_[True, (both[order][1:] != both[order][:-1]) | (node[order][1:] != node[order][:-1])]
            flat = np.empty(len(node), np.int64)
            flat[order] = np.cumsum(new) - 1
            ids, first = node[order][new], both[order][new]
            root = roots(flat[: len(p)], flat[len(p) :], len(ids))
            at = bounds(p, keys)[first]
            yield pd.DataFrame({"signal_id": p["signal_id"].to_numpy()[at], "seg_id": p["seg_id"].to_numpy()[at], "node": ids, "root": ids[root]})

    kind = dict(edges.dtypes)["signal_id"]
    small, some = edges, large.limit(1).count() > 0
    if some:
        small = edges.join(large, keys, "left_anti")
    out = small.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(of, f"signal_id {kind}, seg_id int, node long, root long")
    return out.union(components(edges.join(large, keys, "left_semi"))) if some else out


def components(edges: DataFrame, most: int = 50) -> DataFrame:
    """The same for graphs of any size: labels fall to the least neighbour and jump, a checkpoint a round."""
    both = cut(edges.select(*KEYS, "a", "b").union(edges.select(*KEYS, "b", "a")).distinct())
    label = cut(both.select(*KEYS, F.col("a").alias("node")).distinct().withColumn("root", F.col("node")))
    for _ in range(most):
        near = both.join(label.withColumnRenamed("node", "b"), [*KEYS, "b"]).groupBy(*KEYS, F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = label.join(near, [*KEYS, "node"]).select(*KEYS, "node", F.least("root", "near").alias("low"), "root")
        jump = step.select(*KEYS, F.col("node").alias("low"), F.col("low").alias("jump"))
        new = cut(step.join(jump, [*KEYS, "low"], "left").select(*KEYS, "node", F.least("low", F.coalesce("jump", "low")).alias("root"), F.col("root").alias("was")))
        moved = new.where("root < was").limit(1).count()
        label = new.drop("was")
        if not moved:
            return label
    raise RuntimeError("the components did not settle")
