"""Exact deduplication through an extendible-hash index on shared files. Built-in functions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE, chosen, stored, text_mark

#: A table of at most so many rows of a few longs may be broadcast (tens of MB); beyond that the join shuffles.
BROADCAST_ROWS = 500_000
#: Bits by which the directory grows at a time.
DOUBLINGS = 4


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", "")


def prefix(h: Column, depth: int) -> Column:
    """The first `depth` bits of a 64-bit key."""
    return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, n_keys: int, bucket_capacity: int) -> list[tuple[int, DataFrame]]:
    """The directory of an extendible hash over the distinct keys (h), as tables of leaves, each with its global depth.

    A leaf (leaf, bucket, local_depth) is a prefix of the global depth. A bucket of local depth d is the range of
    keys that share their first d bits; an overfull one is split, so that many leaves share a bucket that is not.
    The directory doubles as often as a leaf is overfull: its keys alone get a table of leaves with more bits,
    until no bucket holds over bucket_capacity keys. Its size follows the keys divided by the capacity.
    """
    tables, base, left = [], 0, keys
    depth = min(64, DOUBLINGS + (math.ceil(math.log2(n_keys / bucket_capacity)) if n_keys > bucket_capacity else 0))
    while True:
        leaves = stored(left.groupBy(prefix(F.col("h"), depth).alias("leaf")).agg(F.count("*").alias("n")), "leaves")
        at = lambda d, depth=depth: F.when(F.col(d) == 0, F.lit(0).cast("long")).otherwise(F.expr(f"shiftrightunsigned(leaf, {depth} - {d})"))
        up = leaves.select("leaf", "n", F.explode(F.sequence(F.lit(base), F.lit(depth))).alias("d")).withColumn("prefix", at("d"))
        overfull = up.groupBy("d", "prefix").agg(F.sum("n").alias("n")).where(F.col("n") > bucket_capacity).select("d", "prefix")
        split = up.join(overfull, ["d", "prefix"]).groupBy("leaf").agg((F.max("d") + 1).alias("d"))
        local = leaves.select("leaf").join(split, "leaf", "left").select("leaf", F.coalesce("d", F.lit(base)).cast("int").alias("local_depth"))
        local = stored(local.withColumn("bucket", at("local_depth")), "directory")
        tables.append((depth, local.where(F.col("local_depth") <= depth)))
        full = local.where(F.col("local_depth") > depth).select("leaf")
        if depth == 64 or not full.limit(1).count():
            return tables
        left = left.withColumn("leaf", prefix(F.col("h"), depth)).join(full, "leaf", "left_semi").select("h")
        base, depth = depth + 1, min(64, depth + DOUBLINGS)


def looked_up(keys: DataFrame, tables: list[tuple[int, DataFrame]]) -> DataFrame:
    """keys with the bucket and local_depth that the directory has for h."""
    found = []
    for depth, leaves in tables:
        small = F.broadcast(leaves) if leaves.count() <= BROADCAST_ROWS else leaves
        found.append(keys.withColumn("leaf", prefix(F.col("h"), depth)).join(small, "leaf").drop("leaf"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_capacity: int = 65_536, hash_fn: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, bucket, local_depth, chain, n_chars, mark.

    Texts are equal when they are the same bytes once white space is deleted; a null text is empty. In a
    group, the row with the most code points in its original text stays, then the smallest id (a null id
    comes last); of rows that agree in both, exactly one stays. mark tells original texts apart. An empty
    table gives an empty result; other columns play no part.

    1. The entries (id, length, hash, digests; no text) are written to the shared folder.
    2. The directory is built from the keys, doubling until no bucket is overfull.
    3. The entries are reduced by key where they were read; each bucket, a range of keys, goes to one owner task.
    4. Owners compare bytes: the different texts of each key that has more than one row meet in its bucket's
       owner, each text once, and are chained there. A key with one text needs nothing more; the rows of a key
       with several are told apart by their bytes.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.length(text_col), F.lit(0)).alias("n_chars"), normalised(F.col(text_col)).alias("norm"), text_mark(text_col).alias("mark")).withColumn("h", hash_fn(F.col("norm")).cast("long"))
    digest = F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")
    entries = stored(rows.select("doc_id", "n_chars", "h", digest, "mark", F.monotonically_increasing_id().alias("rid")), "entries")
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("lacks"), "doc_id", "rid")).alias("best")
    keys = stored(entries.groupBy("h").agg(best, F.count("*").alias("n")), "keys")
    tables = directory(keys.select("h"), keys.count(), bucket_capacity)
    owner = ["bucket", "local_depth"]
    index = stored(looked_up(keys, tables).repartition(*owner).sortWithinPartitions(*owner, "h"), "index")

    # bytes are compared where a key has more than one row; each owner gets each text once
    several = index.where("n > 1").select("h", *owner)
    several = F.broadcast(several) if several.count() <= BROADCAST_ROWS else several
    texts = rows.select("h", "norm").join(several, "h").groupBy(*owner, "h", "norm").agg(F.count("*").alias("n"))
    place = Window.partitionBy(*owner, "h").orderBy("norm")
    chains = texts.repartition(*owner).withColumn("chain", F.row_number().over(place) - 1).withColumn("texts", F.max("chain").over(Window.partitionBy(*owner, "h")))
    chained = stored(chains.where("texts > 0").select("h", *owner, F.col("norm"), "chain"), "chains")

    group = [F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), F.col("best.rid").alias("keep_rid")]
    plain = index.select("h", *owner, F.lit(0).alias("chain"), *group)
    collide = chained.limit(1).count() > 0
    if collide:
        plain = plain.join(chained.select("h").distinct(), "h", "left_anti")
    out = [F.col("e.doc_id"), "keep_id", "group_size", (F.col("e.rid") == F.col("keep_rid")).alias("kept"), F.col("e.text_sha256"), *owner, "chain", F.col("e.n_chars"), F.col("e.mark")]
    result = entries.alias("e").join(plain, "h").select(*out)
    if collide:
        told = stored(rows.join(chained.select("h").distinct(), "h", "left_semi").withColumn("rid", F.monotonically_increasing_id()), "told")
        by_text = told.groupBy("h", "norm").agg(best, F.count("*").alias("n")).join(chained, ["h", "norm"]).select("h", "norm", *owner, "chain", *group)
        result = result.union(told.withColumn("text_sha256", digest).alias("e").join(by_text, ["h", "norm"]).select(*out))
    return result


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each group, also where ids repeat."""
    kept = exact_groups(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("id"), "mark")
    return chosen(docs, stored(kept, "kept"), id_col, text_col)
