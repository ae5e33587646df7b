"""Similarity self-join of word n-gram sets by a token-group matrix, and the groups that its links form."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .exact_dedup import BROADCAST_ROWS
from .shared import chosen, connected_components, stored, text_mark, with_texts
from .shingles import distinct

#: Per cent of a set's tokens that its sketch holds beyond those that it can't do without.
EXTRA = 10
#: Documents and tokens of a group, on average; queries that open a group in one call.
GROUP, GROUP_TOKENS, QUERIES = 64, 200_000, 256
#: Sizes of a group's sets lie within this factor.
BAND = 1.03


def needed(n, percent: int):
    """The least intersection of a set of n that reaches percent: -(-n * percent // 100)."""
    return -((-n * percent) // 100)


def sketch_size(n, percent: int, least=min):
    """Tokens of a set of n, those of least hash, that are looked at first."""
    return least(n, n - needed(n, percent) + 1 + n * EXTRA // 100)


def sure(n, percent: int, least=min, most=max):
    """How many tokens a sketch shares with that of any set that the set of n links with.

    Of two sketches one ends first in the order of hashes; each token of it that the other set has is in the
    other's sketch. What it leaves out can't add more than its size. It is the set's own sketch, or that of a
    partner, for which the sum is least at the greatest size that can link.
    """
    other = n * 100 // percent
    own_first = needed(n, percent) - n + sketch_size(n, percent, least)
    other_first = n - other + sketch_size(other, percent, least) - 1
    return most(1, least(own_first, other_first))


def signatures(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, mark, n, key, sketch) of each row: mark of its text, size and hash of its set, its tokens of least hash."""

    def of(texts: list[str | None]) -> dict:
        out = []
        for text in texts:
            h = distinct(text, width)[0]
            out.append((len(h), xxhash.xxh128_digest(h.tobytes()), h[: sketch_size(len(h), percent)].view(np.int64)))
        return {"n": [x[0] for x in out], "key": [x[1] for x in out], "sketch": [x[2] for x in out]}

    marked = docs.select("doc_id", "text", text_mark().alias("mark"))
    return with_texts(marked, ["doc_id", "mark"], of, {"n": pa.int64(), "key": pa.binary(), "sketch": pa.list_(pa.int64())})


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    def of(texts: list[str | None]) -> dict:
        h = [distinct(t, width)[0] for t in texts]
        return {"key": [xxhash.xxh128_digest(x.tobytes()) for x in h], "tokens": [x.tobytes() for x in h]}

    return with_texts(docs, [], of, {"key": pa.binary(), "tokens": pa.binary()})


def small(df: DataFrame) -> DataFrame:
    """df, a few longs a row, to be broadcast if it has BROADCAST_ROWS rows at most; else the join shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def opened(pairs: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) of pairs (q, g) of query set and group, one for each pair that has any; members(g, cls).

    A group whose token union shares too few of the query's tokens stays closed. The queries of a group come
    in blocks of QUERIES, each with the group's sets, so that a group with very many queries is many tasks.
    """
    blocks = pairs.groupBy("g").agg(F.count("*").alias("nq")).withColumn("blocks", F.ceil(F.col("nq") / QUERIES))
    blocks = stored(blocks, "blocks")
    asked = stored(pairs.join(blocks, "g").select("g", F.pmod(F.xxhash64("q"), F.col("blocks")).alias("block"), "q"), "asked")
    held = stored(blocks.select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")).join(members, "g").select(F.col("g").alias("of_g"), F.col("block").alias("of_block"), "cls"), "held")
    # the sets are many bytes each, so what they are joined with goes to them where it can
    left = sets.withColumnRenamed("cls", "q").join(small(asked), "q").select("g", "block", "q", "tokens")
    right = sets.join(small(held), "cls").select("of_g", "of_block", "cls", F.col("tokens").alias("inside"))

    def of(queries: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        inside = [np.frombuffer(t, np.uint64) for t in group["inside"]]
        union = np.unique(np.concatenate(inside)) if len(inside) > 1 else inside[0] if inside else np.zeros(0, np.uint64)
        out = []
        for q, t in zip(queries["q"], queries["tokens"], strict=True):
            mine = np.frombuffer(t, np.uint64)
            if 100 * len(np.intersect1d(mine, union, assume_unique=True)) < percent * len(mine):
                continue
            for other, s in zip(group["cls"], inside, strict=True):
                if 100 * min(len(s), len(mine)) >= percent * max(len(s), len(mine)):
                    both = len(np.intersect1d(mine, s, assume_unique=True))
                    if 100 * both >= percent * (len(mine) + len(s) - both):
                        out.append((q, other))
                        break
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return left.groupBy("g", "block").cogroup(right.groupBy("of_g", "of_block")).applyInPandas(of, "a long, b long")


def opened_groups(pairs: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the members (g, cls, comp) of each pair of groups (ga, gb), enough to join what links join.

    A member of one group is a query against the other: unless the group's token union may hold enough of its
    tokens, the group stays closed to it. Members whose components are joined already are not compared.
    """
    of_g = lambda g, cls, comp: stored(pairs.join(members.select(F.col("g").alias(g), F.col("cls").alias(cls), F.col("comp").alias(comp)), g), f"members-{g}")
    left = sets.join(small(of_g("ga", "cls", "comp")), "cls").select("ga", "gb", "cls", "comp", "tokens")
    right = sets.withColumnRenamed("cls", "cls2").join(small(of_g("gb", "cls2", "comp2")), "cls2").select(F.col("ga").alias("ga2"), F.col("gb").alias("gb2"), "cls2", "comp2", F.col("tokens").alias("tokens2"))

    def of(queries: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        inside = [np.frombuffer(t, np.uint64) for t in group["tokens2"]]
        union = np.unique(np.concatenate([np.zeros(0, np.uint64), *inside]))
        root: dict[int, int] = {}

        def top(c: int) -> int:
            while root.setdefault(c, c) != c:
                c = root[c]
            return c

        out = []
        for q, own, t in zip(queries["cls"], queries["comp"], queries["tokens"], strict=True):
            mine = np.frombuffer(t, np.uint64)
            if 100 * len(np.intersect1d(mine, union, assume_unique=True)) < percent * len(mine):
                continue
            for other, comp, s in zip(group["cls2"], group["comp2"], inside, strict=True):
                if 100 * min(len(s), len(mine)) >= percent * max(len(s), len(mine)) and top(own) != top(comp):
                    both = len(np.intersect1d(mine, s, assume_unique=True))
                    if 100 * both >= percent * (len(mine) + len(s) - both):
                        out.append((q, other))
                        root[top(own)] = top(comp)
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return left.groupBy("ga", "gb").cogroup(right.groupBy("ga2", "gb2")).applyInPandas(of, "a long, b long")


def least_shared(a: str, b: str, low: str, high: str, percent: int):
    """Tokens that the sketches of two linking sets share, whose sizes lie from a to low and from b to high at most."""
    share = F.ceil(percent * (F.col(a) + F.col(b)) / F.lit(100.0 + percent))
    n = F.greatest(low, high)
    left_out = n - F.least(n, n - F.floor((percent * n + 99) / 100) + 1 + F.floor(n * EXTRA / 100))
    # a set of one token less may leave out one more
    return F.greatest(share - left_out - 1, F.lit(1))


def promising(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (q, g) of classes whose sketches share enough tokens for a link."""
    of = lambda name: sketches.select(F.col("cls").alias(name), F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"s_{name}"))
    both = pairs.join(of("q"), "q").join(of("g"), "g")
    return both.where(F.size(F.array_intersect("s_q", "s_g")) >= least_shared("n_q", "n_g", "n_q", "n_g", percent)).select("q", "g")


def lists_of(reps: DataFrame, percent: int) -> DataFrame:
    """(t, cls, n): each class (cls, n, sketch) under the tokens, of its sketch, that it can't do without.

    Its sketch shares sure(n) tokens with that of any class that it links with, so it has to be listed under all
    but sure(n) - 1 of them, in any order of all tokens. Ours is by the exact number of sketches that hold a
    token, so the rare ones; one that no other sketch holds needs no list. A class that shares less than sure(n)
    with all others together links with nothing.
    """
    each = reps.select("cls", F.col("n").cast("int").alias("n"), F.explode("sketch").alias("t"))
    often = stored(each.groupBy("t").agg(F.count("*").alias("df")).where("df > 1"), "token-counts")
    shared = each.join(often, "t").groupBy("cls", "n").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("by_df"))
    n = F.col("n")
    least = sure_column(n, percent)
    few = shared.where(F.size("by_df") >= least).select("cls", "n", F.explode(F.slice("by_df", F.lit(1), F.size("by_df") - least + 1)).alias("x"))
    return few.select(F.col("x.t").alias("t"), "cls", F.col("n").cast("long").alias("n"))


def sure_column(n, percent: int):
    """sure() as a column."""
    quotient = lambda a, b: F.floor(a / F.lit(float(b)))
    need = lambda m: F.ceil(m * percent / F.lit(100.0))
    size = lambda m: F.least(m, m - need(m) + 1 + quotient(m * EXTRA, 100))
    other = quotient(n * 100, percent)
    return F.greatest(F.lit(1), F.least(need(n) - n + size(n), n - other + size(other) - 1)).cast("int")


def similar_size(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, class_size for each row of docs (doc_id, text).

    A row's set: the distinct runs of `width` words of its whole text, A-Z in lower case, split at ASCII white
    space; fewer words make one run of all, no words (or a null text) the empty set, which links with nothing.
    Two sets link when 100 x intersection >= percent x union. component_id is the smallest id that links
    reach, the row's own included; class_size counts the rows with the same set. A null id takes part and
    only has no number to give; repeated rows are rows; an empty table gives an empty result.

    1. Rows with the same set become one class; what follows sees classes.
    2. Each class is listed under the few rare tokens of its sketch; two classes that link share a list.
    3. Within each list all classes are compared with one of them. That joins most near copies in linear work.
    4. Lists with classes of different components remain. Their classes form groups of similar sets, of bounded
       size; groups meet by the tokens of the token-group matrix, and a class opens a met group only if the
       group's token union bounds the overlap high enough.

    Tokens are 64-bit hashes of the words' bytes, whose collisions can be built on purpose; two texts of which
    that is so may be told too similar.
    """
    return grouped(docs, width, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class_size")


def grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """near_copies with the mark of each row's text, its size n, and root, which the rows of a component share."""
    rows = stored(signatures(docs, width, percent).withColumn("rid", F.monotonically_increasing_id()), "signatures")
    classes = stored(rows.where("n > 0").groupBy("key", "n").agg(F.min("rid").alias("cls"), F.min("doc_id").alias("doc_id"), F.count("*").alias("class_size")), "classes")
    # all but one row of each class, mostly few, are left out
    copies = rows.select("rid").join(classes.select(F.col("cls").alias("rid")), "rid", "left_anti")
    reps = rows.where("n > 0").select("rid", "n", "sketch").join(small(stored(copies, "copies")), "rid", "left_anti").withColumnRenamed("rid", "cls")
    listed = stored(lists_of(reps, percent), "listed")
    sizes = listed.groupBy("t", "n").agg(F.count("*").alias("c"))
    by_size = Window.partitionBy("t").orderBy("n")
    near = (F.col("c") > 1) | (100 * F.lag("n").over(by_size) >= percent * F.col("n")) | (100 * F.col("n") >= percent * F.lead("n").over(by_size))
    partnered = sizes.withColumn("near", near).where("near").select("t", "n")
    lists = stored(listed.join(partnered, ["t", "n"]).select("t", "cls", "n"), "lists")
    named = stored(lists.select("cls").distinct(), "listed-classes")
    sketches = stored(rows.select(F.col("rid").alias("cls"), "n", "sketch").join(small(named), "cls", "left_semi"), "sketches")
    repeated_ids = rows.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0

    def sets_of(some: DataFrame) -> DataFrame:
        """(cls, tokens) of the classes in some (cls), from the texts once more."""
        involved = stored(classes.join(some.distinct(), "cls", "left_semi").select("key", "cls", "doc_id"), "involved")
        ids = involved.select(F.col("doc_id").alias("__id")).distinct()
        texts = docs.select("doc_id", "text").join(small(ids), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
        sets = full_sets(texts, width).join(small(involved.select("key", "cls")), "key").select("cls", "tokens")
        return stored(sets.groupBy("cls").agg(F.first("tokens").alias("tokens")) if repeated_ids else sets, "sets")

    hub = lists.groupBy("t").agg(F.min_by(F.struct("cls", "n"), F.xxhash64("cls")).alias("hub"))
    pairs = lists.join(hub, "t").where((F.col("cls") != F.col("hub.cls")) & similar_size("n", "hub.n", percent)).select(F.col("cls").alias("q"), F.col("hub.cls").alias("g")).distinct()
    pairs = stored(promising(pairs, sketches, percent), "star-pairs")
    hubs = pairs.select("g").distinct().withColumn("cls", F.col("g"))
    links = stored(opened(pairs, hubs, sets_of(pairs.select(F.col("q").alias("cls")).union(pairs.select("g"))), percent), "links")
    comps = stored(connected_components(links), "components")
    now = lists.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("component", "cls")).drop("component")
    torn = now.groupBy("t").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("t")
    now = stored(now.join(torn, "t"), "torn")

    # groups of similar sets: those that have the same token as the least of theirs, of like size
    members = stored(now.groupBy("cls", "n", "comp").agg(F.min(F.xxhash64("t")).alias("home")).withColumn("band", F.floor(F.log("n") / F.log(F.lit(BAND)))), "torn-classes")
    parts = stored(members.groupBy("home", "band").agg(F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("n") / GROUP_TOKENS)).alias("parts")), "parts")
    members = stored(members.join(parts, ["home", "band"]).select("cls", "n", "comp", F.xxhash64("home", "band", F.pmod(F.xxhash64("cls"), F.col("parts"))).alias("g")), "groups")
    # the matrix: of each group the tokens that lists hold, to meet by, and the union of its sketches, for the bound
    union = F.array_distinct(F.flatten(F.collect_list("sketch"))).alias("tokens")
    unions = stored(members.join(sketches.select("cls", "sketch"), "cls").groupBy("g").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), union), "unions")
    matrix = stored(now.select("t", "cls").join(members.select("cls", "g"), "cls").select("t", "g").distinct().join(unions.drop("tokens"), "g"), "matrix")
    other = matrix.select("t", *[F.col(c).alias(f"{c}_b") for c in ("g", "low", "high", "c0", "c1")])
    apart = ~((F.col("c0") == F.col("c1")) & (F.col("c0_b") == F.col("c1_b")) & (F.col("c0") == F.col("c0_b")))
    fits = (100 * F.col("high") >= percent * F.col("low_b")) & (100 * F.col("high_b") >= percent * F.col("low"))
    met = stored(matrix.join(other, "t").where((F.col("g") <= F.col("g_b")) & apart & fits).select("g", "g_b", "low", "low_b", "high", "high_b").distinct(), "met")
    side = lambda g, tokens: unions.select(F.col("g").alias(g), F.col("tokens").alias(tokens))
    met = met.join(side("g", "mine"), "g").join(side("g_b", "theirs"), "g_b")
    met = met.where(F.size(F.array_intersect("mine", "theirs")) >= least_shared("low", "low_b", "high", "high_b", percent))
    pairs = stored(met.select(F.col("g").alias("ga"), F.col("g_b").alias("gb")), "group-pairs")
    inside = members.join(pairs.select(F.col("ga").alias("g")).union(pairs.select("gb")).distinct(), "g", "left_semi")
    links = stored(links.union(opened_groups(pairs, inside, sets_of(inside.select("cls")), percent)), "all-links")
    comps = stored(connected_components(links), "components")

    named = classes.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("component", "cls")).select("key", "doc_id", "class_size", "root")
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "root").select("key", "component_id", "class_size", "root")
    out = rows.where("n > 0").join(named, "key").select("doc_id", "mark", "n", "component_id", "class_size", "root")
    return out.union(rows.where("n = 0").select("doc_id", "mark", "n", "doc_id", F.lit(1).cast("long"), F.lit(None).cast("long")))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component, that of the smallest id, and every text without words.

    Rows are told apart by id and text, so where an id repeats each of its rows is judged by itself.
    """
    rows = stored(grouped(docs, width, percent), "near-copies")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("lacks"), "doc_id", "mark")).alias("first")
    kept = rows.where("n > 0").groupBy("root").agg(first).select(F.col("first.doc_id").alias("id"), F.col("first.mark").alias("mark"))
    return chosen(docs, kept.union(rows.where("n = 0").select("doc_id", "mark")))
