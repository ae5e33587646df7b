"""Approximate nearest neighbours: inverted lists, product-quantised residuals, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

#: Vectors that the index is fitted on, on average, chosen by hash: so many, or so many a list; every vector is indexed.
FIT, FIT_LIST = 20_000, 8
#: Recall that the number of probed lists is chosen for, on the sample, and queries it is measured with.
RECALL, TRIALS = 0.99, 200
#: Lists that a query probes at least: few vectors give few trials to choose by, and small lists cost little.
LEAST = 8
#: Dimensions of a subvector and codes of its codebook.
SUB, CODES = 2, 256
#: Vectors of a block of a list, and queries that meet it in one call.
BLOCK, QUERIES = 2048, 256
#: Spreads of the quantisation error that a candidate is allowed before it is left out.
MARGIN = 4.0


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of the rows with an id and a finite vector that is not zero, of the commonest length."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(F.col(id_col).isNotNull() & F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (length["d"] if length else 0))


def scaled(v: str):
    """A vector over the power of two that its largest component reaches: the same direction, exactly, whose squares stay finite."""
    k = F.greatest(F.lit(-1000.0), F.least(F.lit(1000.0), F.floor(F.log2(F.array_max(F.transform(v, F.abs)))).cast("double")))
    return F.transform(v, lambda c: c * F.pow(F.lit(2.0), -k))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, cosine: bool = False) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        to = nearest(x, c)
        n = np.bincount(to, minlength=len(c))
        sums = np.stack([np.bincount(to, x[:, j], len(c)) for j in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        if cosine:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    bias = (c**2).sum(1) / 2
    return np.concatenate([(x[i : i + 4096] @ c.T - bias).argmax(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


@dataclass
class Index:
    centres: np.ndarray  # groups of lists x d
    first: np.ndarray  # of each group: its first list; the lists of a group follow each other
    coarse: np.ndarray  # lists x d
    books: list[np.ndarray]  # of each subvector: codes x its dimensions
    probes: int

    def lists(self, x: np.ndarray) -> np.ndarray:
        """The list of each unit vector, looked for in its nearest group only."""
        group = nearest(x, self.centres)
        out = np.zeros(len(x), np.int64)
        bound = np.append(self.first, len(self.coarse))
        for g in np.unique(group):
            rows = np.flatnonzero(group == g)
            out[rows] = bound[g] + nearest(x[rows], self.coarse[bound[g] : bound[g + 1]])
        return out

    def ranked(self, q: np.ndarray) -> np.ndarray:
        """All lists for each query, nearest first."""
        return np.argsort(-(q @ self.coarse.T), axis=1, kind="stable")

    def parts(self, r: np.ndarray) -> list[np.ndarray]:
        return [r[:, i : i + SUB] for i in range(0, r.shape[1], SUB)]

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and length of what the codes leave out, for unit vectors."""
        to = self.lists(x)
        parts = self.parts(x - self.coarse[to])
        codes = np.stack([nearest(p, b) for p, b in zip(parts, self.books, strict=True)], 1)
        rest = sum(((p - b[codes[:, i]]) ** 2).sum(1) for i, (p, b) in enumerate(zip(parts, self.books, strict=True)))
        return to, codes.astype(np.uint8), np.sqrt(rest)


def fit(vectors: DataFrame, n: int, k: int, lists: int | None = None, seed: int = 5) -> Index | None:
    """Fits the lists (half the root of n, in groups about the root of their number) and codebooks on a bounded sample.

    The number of probed lists is the least that finds RECALL of the sample's true neighbours within the sample.
    """
    lists = lists or max(4, int(np.sqrt(n) / 2))
    size = max(FIT, FIT_LIST * lists)
    sample = vectors.where((F.xxhash64("v", F.lit(seed)) / F.lit(2.0**64) + 0.5) < size / max(n, 1)).select("v").orderBy("v").toPandas()
    if not len(sample):
        sample = vectors.select("v").limit(1).toPandas()
    if not len(sample):
        return None
    rng = np.random.default_rng(seed)
    x = unit(np.stack(sample["v"].to_numpy()))
    centres = k_means(x, int(np.ceil(np.sqrt(lists))), 8, rng, cosine=True)
    group = nearest(x, centres)
    parts = [k_means(x[group == g], max(1, round(lists * np.mean(group == g))), 8, rng, cosine=True) if (group == g).any() else centres[g : g + 1] for g in range(len(centres))]
    index = Index(centres, np.cumsum([0, *map(len, parts[:-1])]), np.concatenate(parts), [], 1)
    to = index.lists(x)
    index.books = [k_means(p, CODES, 5, rng) for p in index.parts(x - index.coarse[to])]
    trials = x[rng.choice(len(x), min(TRIALS, len(x)), replace=False)]
    rank = np.argsort(index.ranked(trials), axis=1)
    found = [rank[i, to[np.argsort(-(x @ q), kind="stable")[1 : k + 1]]] + 1 for i, q in enumerate(trials)]
    found = np.concatenate(found)
    index.probes = int(np.clip(np.quantile(found, RECALL), min(LEAST, len(index.coarse)), len(index.coarse))) if len(found) else len(index.coarse)
    return index


def met(index: Index, k: int, only_best: bool):
    """The work of a block of a list and the queries that probe it: the classes (q, cid) that matter.

    A class is kept if its distance from the tables, give or take MARGIN spreads of its own quantisation error,
    may be among the k best: not below the query's bar, nor below the k-th surest of the block. With only_best
    the k that look best are kept, whose exact cosines make the bar.
    """

    def of(some: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        q_out, class_out = [], []
        if len(some) and len(block):
            codes = np.stack([np.frombuffer(c, np.uint8) for c in block["code"]])
            cid, id_, many, slack = (block[c].to_numpy() for c in ("cid", "id", "many", "rest"))
            slack = MARGIN * slack / np.sqrt(index.coarse.shape[1])
            centre = index.coarse[int(some["list"].iloc[0])]
            for q, v, bar in zip(some["q"], some["query"], some["bar"], strict=True):
                v = np.frombuffer(v)
                s = v @ centre + sum((b @ v[i * SUB : (i + 1) * SUB])[codes[:, i]] for i, b in enumerate(index.books))
                s[(id_ == q) & ~many] = -np.inf
                if only_best:
                    keep = np.argpartition(s, -k)[-k:] if len(s) > k else np.arange(len(s))
                    keep = cid[keep[s[keep] > -np.inf]]
                else:
                    low = s - slack
                    sure = np.partition(low, -k)[-k] if len(low) >= k else -np.inf
                    keep = cid[(s + slack >= max(bar, sure)) & (s > -np.inf)]
                q_out.append(np.full(len(keep), q))
                class_out.append(keep)
        none = np.zeros(0, np.int64)
        return pd.DataFrame({"q": np.concatenate([none, *q_out]).astype(np.int64), "cid": np.concatenate([none, *class_out]).astype(np.int64)})

    return of


def scanned(asked: DataFrame, entries: DataFrame, sizes: DataFrame, index: Index, k: int, only_best: bool) -> DataFrame:
    """What `met` gives for all asked (q, list, query, bar), in blocks of lists and turns of queries; bars look at one block."""
    turns = asked.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).alias("turns"))
    sizes = stored(sizes.join(turns, "list").select(F.col("list").alias("l"), "blocks", "turns"), "list-sizes")
    zero = F.lit(0).cast("long")
    block = F.pmod(F.xxhash64("q"), F.col("blocks")) if only_best else F.explode(F.sequence(zero, F.col("blocks") - 1))
    left = asked.join(sizes, F.col("list") == F.col("l")).select("list", F.pmod(F.xxhash64("q"), F.col("turns")).alias("turn"), block.alias("block"), "q", "query", "bar")
    right = entries.join(sizes, F.col("list") == F.col("l")).select(F.col("list").alias("of_list"), F.explode(F.sequence(zero, F.col("turns") - 1)).alias("of_turn"), F.pmod(F.xxhash64("cid"), F.col("blocks")).alias("of_block"), "cid", "id", "many", "code", "rest")
    pairs = left.groupBy("list", "turn", "block").cogroup(right.groupBy("of_list", "of_turn", "of_block"))
    return pairs.applyInPandas(met(index, k, only_best), "q long, cid long")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each query (vec_id, v) its k nearest of vectors by cosine in double precision.

    A vector with the query's own id is no candidate; of several vectors of one query id the least is asked for.
    Rows that `usable` leaves out take no part; vectors of one direction, up to a power of two, are one class. Of equal cosines the smaller id comes first; with fewer than k
    candidates all are returned; empty tables give an empty result; repeated rows are candidates of their own.

    1. Equal vectors are one class, of which the k + 1 smallest ids can matter. Every class is in one list.
    2. A block of its nearest list gives each query a bar: the exact cosine of the worst of k that look best there.
    3. A query probes the lists that the fit asks for, and more until they hold k others. Their blocks tell the
       classes that may pass the bar; no number of them is fixed.
    4. Those are ranked by their exact cosines. A query that is left with fewer than k probes all lists.
    """
    vectors, queries = vectors.withColumn("v", scaled("v")), queries.withColumn("v", scaled("v"))
    ids = vectors.groupBy("v", "vec_id").agg(F.least(F.count("*"), F.lit(k)).alias("m")).withColumn("h", F.xxhash64("v"))
    first = ids.withColumn("r", F.row_number().over(Window.partitionBy("h", "v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    classes = first.groupBy("h", "v").agg(F.sort_array(F.collect_list(F.struct("vec_id", "m"))).alias("ids"))
    classes = stored(classes.select("v", "ids").withColumn("cid", F.monotonically_increasing_id()), "vectors")
    n = classes.count()
    index = fit(classes, n, k)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def coded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                to, codes, rest = index.coded(unit(np.stack(p["v"].to_numpy())))
                yield pd.DataFrame({"list": to, "cid": p["cid"], "id": p["id"], "many": p["many"], "code": [c.tobytes() for c in codes], "rest": rest})

    named = classes.select("v", "cid", F.col("ids")[0]["vec_id"].alias("id"), (F.size("ids") > 1).alias("many"))
    entries = stored(named.mapInPandas(coded, "list int, cid long, id long, many boolean, code binary, rest double"), "index")
    counts = stored(entries.groupBy("list").agg(F.count("*").alias("n")), "list-counts")
    held = np.zeros(len(index.coarse), np.int64)
    for r in counts.collect():  # a row a list
        held[r["list"]] = r["n"]
    sizes = counts.select("list", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    asked = stored(queries.groupBy("vec_id").agg(F.min("v").alias("x")), "queries")

    def probed(lists: int | None):
        """The lists to probe: the nearest, or at least so many and more until they hold k others, or all of them."""

        def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                if len(p):
                    q = unit(np.stack(p["x"].to_numpy()))
                    some = [b[held[b] > 0] for b in index.ranked(q)]
                    if lists is not None:
                        enough = [int(np.searchsorted(np.cumsum(held[b]), k, side="right")) + 1 for b in some]
                        some = [b[: lists if lists == 1 else max(lists, m)] for b, m in zip(some, enough, strict=True)]
                    size = [len(b) for b in some]
                    yield pd.DataFrame({"q": np.repeat(p["vec_id"].to_numpy(), size), "list": np.concatenate(some), "query": [x for v, m in zip(q, size, strict=True) for x in [v.tobytes()] * m]})

        return of

    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda m, n: m * n), F.lit(0.0), lambda s, y: s + y)
    score = dot("x", "v") / (F.sqrt(dot("x", "x")) * F.sqrt(dot("v", "v")))

    def found(some: DataFrame, bars: DataFrame | None, least: int | None) -> DataFrame:
        lists = some.mapInPandas(probed(least), "q long, list int, query binary")
        lists = lists.withColumn("bar", F.lit(-2.0)) if bars is None else lists.join(bars, "q", "left").withColumn("bar", F.coalesce("bar", F.lit(-2.0)))
        close = stored(scanned(stored(lists, "probes"), entries, sizes, index, k, False), "candidates")
        exact = close.join(classes, "cid").join(some.withColumnRenamed("vec_id", "q"), "q").select("q", score.alias("score"), F.explode("ids").alias("i"))
        exact = exact.where(F.col("i.vec_id") != F.col("q")).select("q", "score", F.col("i.vec_id").alias("vec_id"), F.explode(F.array_repeat(F.lit(1), F.col("i.m").cast("int"))).alias("one"))
        ranked = exact.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
        return stored(ranked.select(F.col("q").alias("query_id"), "rank", "vec_id", "score"), "ranked")

    one = asked.mapInPandas(probed(1), "q long, list int, query binary").withColumn("bar", F.lit(-2.0))
    first = scanned(stored(one, "first-lists"), entries, sizes, index, k, True).join(classes.select("cid", "v"), "cid").join(asked.withColumnRenamed("vec_id", "q"), "q")
    # less what a sum in another order may differ by
    bars = stored(first.groupBy("q").agg((F.min(score) - 1e-9).alias("bar"), F.count("*").alias("c")).where(F.col("c") >= k).select("q", "bar"), "bars")
    out = found(asked, bars, max(2, index.probes))
    full = out.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = stored(asked.join(full, "vec_id", "left_anti"), "short")
    if short.limit(1).count():
        again = found(short, None, None)
        out = out.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").select(*again.columns).union(again)
    return out
