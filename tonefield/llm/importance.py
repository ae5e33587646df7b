"""Resampling towards a target distribution: importance weights over hashed words, drawn by an exact histogram of scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import numbered, stored

#: The letters that are lowered, and what stands between two words.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, SEED = 10_000, 2024


def bucket(run: Column, buckets: int) -> Column:
    return (F.crc32(run.cast("binary")) % buckets).cast("int")


def runs(words: str, n: int, buckets: int) -> Column:
    """The bucket of each run of n consecutive words of an array."""
    if n == 1:
        return F.transform(words, lambda w: bucket(w, buckets))
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1)))
    return F.coalesce(F.transform(starts, lambda i: bucket(F.array_join(F.slice(words, i, F.lit(n)), " "), buckets)), F.array().cast("array<int>"))


def features(docs: DataFrame, keep: list[str], longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """The columns `keep`, n_words, and the bucket of each run of 1 to `longest` words, repeats included; none of a null text."""
    parts = F.split(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER), BETWEEN)
    told = docs.select(*keep, F.filter(parts, lambda w: w != "").alias("__words"))
    every = [runs("__words", n, buckets) for n in range(1, longest + 1)]
    return told.select(*keep, F.size("__words").cast("long").alias("n_words"), (F.concat(*every) if longest > 1 else every[0]).alias("buckets"))


def counts(rows: DataFrame, buckets: int) -> list[int]:
    """How many features of rows lie in each bucket: a number a bucket comes to the driver, whatever the rows."""
    out = [0] * buckets
    for r in rows.select(F.explode("buckets").alias("b")).groupBy("b").agg(F.count("*").alias("n")).collect():
        out[r["b"]] = r["n"]
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """What a feature of each bucket adds to a weight: a thousand times the log of its smoothed share in target over that in source."""
    k, s_all, t_all = len(source), sum(source), sum(target)
    return [math.floor(1000 * math.log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k)))) for s, t in zip(source, target, strict=True)]


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise of an id, in thousandths, rounded down; that of a null id is that of the text 'null'."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def drawn(rows: DataFrame, percent: int, least_words: int) -> DataFrame:
    """rows (doc_id, n_words, n_features, weight, score) with rank: the percent of highest scores among rows with enough words.

    Scores are whole numbers of a bounded range (two logs of 64-bit counts and the noise of 32 bits: under 200,000 of
    them), so the exact histogram fits any task and may be broadcast. Its suffix sums tell how many rows stand above
    each score; scores that begin beyond the draw are out, and the others number their rows by doc_id. Noise spreads
    different ids over the scores, so only rows that repeat an id could make a score large: they are counted as one
    entry, and numbered apart, in parts.
    """
    fit = F.col("n_words") >= least_words
    bars = rows.where(fit).groupBy("score").agg(F.count("*").alias("n"))
    bars = stored(bars.withColumn("above", F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")), "histogram")
    size = int((bars.agg(F.sum("n")).first()[0] or 0) * percent // 100)
    bars = bars.select(F.col("score").alias("__s"), "above")
    told = rows.join(F.broadcast(bars.where(F.col("above") < size)), fit & (F.col("score") == F.col("__s")), "left").drop("__s")
    some, rest = told.where("above IS NOT NULL"), told.where("above IS NULL")

    entries = some.groupBy("score", "above", "doc_id").agg(F.count("*").alias("m"), F.min("n_features").alias("n_features"), F.min("weight").alias("weight"))
    by_id = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last())
    earlier = F.coalesce(F.sum(F.col("m") - 1).over(by_id.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    entries = stored(entries.withColumn("rank", F.col("above") + F.row_number().over(by_id) + earlier), "entries")
    out = ["doc_id", "n_features", "weight", "score"]
    ranked = entries.where("m = 1").select(*out, "rank")
    again = entries.where("m > 1").select(F.col("doc_id").alias("__d"), F.col("score").alias("__s"), F.col("rank").alias("first"))
    if again.limit(1).count():
        same = (F.col("score") == F.col("__s")) & F.col("doc_id").eqNullSafe(F.col("__d"))
        copies = numbered(stored(some.join(again, same).select(*out, "first"), "repeats"), ["score", "doc_id"], "place")
        ranked = ranked.unionByName(copies.select(*out, (F.col("first") + F.col("place") - 1).alias("rank")))
    rank = F.when(F.col("rank") <= size, F.col("rank")).cast("long").alias("rank")
    return ranked.select(*out, rank).unionByName(rest.select(*out, F.lit(None).cast("long").alias("rank")))


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank for each row of docs; rank is null where a row is not drawn.

    A row's weight is the floored mean gain of its features, of which gains an array holds one a bucket; without
    features it is 0. Its score adds noise of its id, so that the highest scores are a sample in proportion to the
    weights. `percent` of the rows with at least `least_words` words are drawn, ties by the smaller doc_id, a null one
    last; rows that repeat an id have ranks of their own, in any order. Null and empty texts have no features and are
    not drawn. Empty tables give an empty result, or gains of an empty target; other columns play no part. Texts are
    counted whole, once: their buckets are written, and both passes read those.
    """
    rows = stored(features(docs, ["doc_id"], longest, buckets), "features")
    gain = gains(counts(rows, buckets), counts(features(target, [], longest, buckets), buckets))
    told = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<long>")
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda s, b: s + F.get(told, b))
    n = F.size("buckets").cast("long")
    weight = F.when(n > 0, F.floor(total / n)).otherwise(F.lit(0)).cast("long")
    scored = rows.select("doc_id", "n_words", n.alias("n_features"), weight.alias("weight"))
    return drawn(stored(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores"), percent, least_words)


def sampled(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The rows of docs that are drawn, with their columns; rows that repeat a drawn id go with it."""
    ids = resampled(docs, target, **how).where("rank IS NOT NULL").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
