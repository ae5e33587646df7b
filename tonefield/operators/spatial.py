"""A k-d tree over the points of one task, searched for many points at a time, and the spanning tree by rounds over it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .graph import roots

#: Points of a leaf at most, and points that are searched for at a time.
LEAF, TURN = 16, 8192
#: What squares of roots may be off by; bounds are wider by so much.
SLACK = 1 + 1e-12


class Tree:
    """Points in the order of the leaves, and of each node its box, its points (start, end) and its two children."""

    def __init__(self, xy: np.ndarray):
        self.xy = xy
        order = np.arange(len(xy))
        self.start, self.end, self.child, depth = [0], [len(xy)], [-1], [0]
        at = 0
        while at < len(self.start):
            a, b = self.start[at], self.end[at]
            if b - a > LEAF:
                own = xy[order[a:b]]
                axis = int(np.ptp(own, axis=0).argmax())
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, axis], mid)]
                self.child[at] = len(self.start)
                self.start += [a, a + mid]
                self.end += [a + mid, b]
                self.child += [-1, -1]
                depth += [depth[at] + 1] * 2
            at += 1
        self.order = order
        self.start, self.end, self.child = np.array(self.start), np.array(self.end), np.array(self.child)
        self.levels = [np.flatnonzero(np.array(depth) == d) for d in range(max(depth) + 1)]
        self.low, self.high = self.least(xy), -self.least(-xy)

    def least(self, value: np.ndarray) -> np.ndarray:
        """The least value of the points of each node."""
        out = np.empty((len(self.start), *value.shape[1:]), value.dtype)
        leaves = np.flatnonzero(self.child < 0)
        leaves = leaves[np.argsort(self.start[leaves])]
        if len(self.order):
            out[leaves] = np.minimum.reduceat(value[self.order], self.start[leaves])
        for level in reversed(self.levels):
            inner = level[self.child[level] >= 0]
            out[inner] = np.minimum(out[self.child[inner]], out[self.child[inner] + 1])
        return out

    def spans(self, of: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squares of the least and the greatest distance of points from the boxes of nodes."""
        low, high = self.low[node] - of, of - self.high[node]
        near = np.maximum(np.maximum(low, high), 0)
        far = np.maximum(-low, -high)
        return (near**2).sum(1), (far**2).sum(1)

    def pairs(self, asked: np.ndarray, floor: np.ndarray | None, many: int, may: Callable[[np.ndarray, np.ndarray], np.ndarray], reach: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """(query, point): for each asked point those points among which its `many` nearest are that are let in.

        may(points, nodes): whether a node holds anything that is let in. floor: no distance counts as less than that
        of either of its points. A node with `many` points bounds the distance from above, all others that are farther,
        or beyond reach, are left out.
        """
        q, node = np.arange(len(asked)), np.zeros(len(asked), np.int64)
        bound, found_q, found_n, found_low = np.full(len(asked), reach**2), [], [], []
        size = self.end - self.start
        floor_low, floor_high = (None, None) if floor is None else (self.least(floor) ** 2, self.least(-floor) ** 2)
        while len(q):
            inside = may(asked[q], node)
            q, node = q[inside], node[inside]
            low, high = self.spans(self.xy[asked[q]], node)
            if floor is not None:
                own = floor[asked[q]] ** 2
                low, high = np.maximum(low, np.maximum(own, floor_low[node])), np.maximum(high, np.maximum(own, floor_high[node]))
            enough = size[node] >= many
            np.minimum.at(bound, q[enough], high[enough])
            near = low <= bound[q] * SLACK
            leaf = near & (self.child[node] < 0)
            found_q.append(q[leaf])
            found_n.append(node[leaf])
            found_low.append(low[leaf])
            inner = near & (self.child[node] >= 0)
            q, node = np.repeat(q[inner], 2), (self.child[node[inner]][:, None] + [0, 1]).ravel()
        q, node, low = np.concatenate(found_q), np.concatenate(found_n), np.concatenate(found_low)
        near = low <= bound[q] * SLACK
        q, node = q[near], node[near]
        each = size[node]
        place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        return np.repeat(q, each), self.order[np.repeat(self.start[node], each) + place]

    def turns(self, asked: np.ndarray) -> list[np.ndarray]:
        """The asked points in turns of neighbours, so that a turn stays in few nodes."""
        rank = np.empty(len(self.xy), np.int64)
        rank[self.order] = np.arange(len(self.xy))
        asked = asked[np.argsort(rank[asked])]
        return [asked[a : a + TURN] for a in range(0, len(asked), TURN)]

    def nearest(self, asked: np.ndarray, may, let: Callable[[np.ndarray, np.ndarray], np.ndarray], floor: np.ndarray | None = None, reach: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """(point, distance) of the nearest point that is let in of each asked one, the first of equals; -1 where none is.

        Without floors distances are squares, so that roots make no ties. Points beyond reach may be left out.
        """
        best, far = np.full(len(self.xy), -1), np.full(len(self.xy), np.inf)
        for turn in self.turns(asked):
            q, p = self.pairs(turn, floor, 1, may, reach)
            ok = let(turn[q], p)
            q, p = q[ok], p[ok]
            d = ((self.xy[p] - self.xy[turn[q]]) ** 2).sum(1)
            if floor is not None:
                d = np.maximum(np.sqrt(d), np.maximum(floor[p], floor[turn[q]]))
            by = np.lexsort((p, d, q))
            first = by[np.r_[True, q[by][1:] != q[by][:-1]]] if len(by) else by
            best[turn[q[first]]], far[turn[q[first]]] = p[first], d[first]
        return best[asked], far[asked]

    def kth(self, k: int) -> np.ndarray:
        """The distance of each point's k-th nearest, itself the first."""
        out = np.zeros(len(self.xy))
        for turn in self.turns(np.arange(len(self.xy))):
            q, p = self.pairs(turn, None, k, lambda points, nodes: np.ones(len(points), bool))
            d = ((self.xy[p] - self.xy[turn[q]]) ** 2).sum(1)
            by = np.lexsort((d, q))
            first = np.flatnonzero(np.r_[True, q[by][1:] != q[by][:-1]])
            out[turn] = np.sqrt(d[by][first + k - 1])
        return out


def later(xy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(point, square of the distance) of the nearest of the points after each, the first of equals; for all but the last."""
    tree = Tree(xy)
    last = -tree.least(-np.arange(len(xy)))
    return tree.nearest(np.arange(len(xy) - 1), lambda points, nodes: last[nodes] > points, lambda a, b: b > a)


def spanning(xy: np.ndarray, floor: np.ndarray | None = None, reach: float = np.inf) -> np.ndarray:
    """Rows (u, v, w), u < v: the least spanning tree by max(distance, floor of u, floor of v), ties by u, then v.

    By rounds: every component takes its least edge to another one, which the tree finds at once for all points,
    nodes that lie within one component being passed over; then components that met are one. Edges beyond reach are
    left out, so that trees of several components remain; a point with nothing foreign within reach is asked no more.
    """
    n = len(xy)
    tree, part, out, floor = Tree(xy), np.arange(n), [], np.zeros(n) if floor is None else floor
    asked = np.arange(n)
    while part.any():
        low, high = tree.least(part), -tree.least(-part)
        foreign = lambda points, nodes: (low[nodes] != part[points]) | (high[nodes] != part[points])  # noqa: E731,B023
        to, d = tree.nearest(asked, foreign, lambda a, b: part[a] != part[b], floor, reach)  # noqa: B023
        near = d <= reach
        asked, to, d = asked[near], to[near], d[near]
        if not len(asked):
            break
        u, v, own_part = np.minimum(asked, to), np.maximum(asked, to), part[asked]
        by = np.lexsort((v, u, d, own_part))
        pick = by[np.r_[True, own_part[by][1:] != own_part[by][:-1]]]
        edges = np.unique(np.column_stack([u[pick], v[pick]]), axis=0)
        own = {(a, b): w for a, b, w in zip(u[pick].tolist(), v[pick].tolist(), d[pick].tolist(), strict=True)}
        out += [(a, b, own[a, b]) for a, b in edges.tolist()]
        part = roots(part[edges[:, 0]], part[edges[:, 1]], n)[part]
    return np.array(out, float).reshape(-1, 3)


def dense(xy: np.ndarray, eps: float, least: int) -> np.ndarray:
    """Whether each point has `least` points within eps, itself included."""
    return Tree(xy).kth(least) <= eps if len(xy) >= least else np.zeros(len(xy), bool)


def within(xy: np.ndarray, eps: float, least: int) -> np.ndarray:
    """The first point of the component, by steps of at most eps, of each dense point; -1 for all others.

    Components come from spanning trees, so a crowd of points within eps of each other never gives all its pairs.
    """
    out, core = np.full(len(xy), -1), np.flatnonzero(dense(xy, eps, least))
    e = spanning(xy[core], reach=eps)
    out[core] = core[roots(e[:, 0].astype(int), e[:, 1].astype(int), len(core))]
    return out


class Sets:
    """Union-find; the root of a union is that of the set that takes the other in."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def take(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[j] = i
        return i != j


def agglomerated(xy: np.ndarray, goal: int, single_linkage: bool) -> np.ndarray:
    """A label a point, from 0: pairs in rising distance are merged until `goal` clusters are left.

    A pair is a point and its nearest later one. With single linkage all pairs count; of those only the edges of the
    spanning tree, ties by their points, can ever merge two clusters. A heap gives pairs as they are needed.
    """
    import heapq

    n = len(xy)
    sets = Sets(n)
    if n > 1:
        if single_linkage:
            e = spanning(xy)
            i, j, d = e[:, 0].astype(int), e[:, 1].astype(int), e[:, 2]
        else:
            j, d = later(xy)
            i, d = np.arange(n - 1), np.sqrt(d)
        heap = list(zip(d.tolist(), i.tolist(), j.tolist(), strict=True))
        heapq.heapify(heap)
        left = n
        while left > goal and heap:
            _, a, b = heapq.heappop(heap)
            left -= sets.take(a, b)
    return np.unique([sets.root(k) for k in range(n)], return_inverse=True)[1] if n else np.zeros(0, int)
