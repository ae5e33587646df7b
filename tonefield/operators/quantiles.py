"""Exact percentiles in bounded memory: groups of bounded size are sorted, larger ones narrowed down by histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import KEYS
from ..session import cut

#: Values of a group that one task may sort, bins of a histogram, intervals that may be sent to all tasks.
FEW, BINS, SMALL = 1_000_000, 4096, 100_000


def alike(a: DataFrame, b: DataFrame, keys: tuple[str, ...], mark: str = "__o_"):
    """The condition that keys of a are those of b, whose columns begin with mark; nulls are equal."""
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[f"{mark}{k}"])
    return out


def marked(df: DataFrame, keys: tuple[str, ...], mark: str = "__o_") -> DataFrame:
    return df.withColumnsRenamed({k: f"{mark}{k}" for k in keys})


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL else df


def percentiles(rows: DataFrame, value: str, shares: dict[str, float], keys: tuple[str, ...] = KEYS, few: int = FEW) -> DataFrame:
    """(keys, a column for each of shares): exact percentiles of each group's values, interpolated between two neighbours.

    Nulls are left out, and a group without values has no row. A group of at most `few` values is sorted in one task,
    which may spill. Of a larger one only the intervals that hold a wanted rank are looked at again: a histogram over
    the interval tells the bin, its least and greatest value are the next interval, and so on until one holds `few`
    values or a single one. No task holds the values of a large group, whose rows meet by partial counts only.
    """
    x = cut(rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v")))
    sizes = cut(x.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    large = sizes.where(F.col("n") > few)
    some = large.limit(1).count() > 0
    if some:
        names = marked(large.select(*keys), keys)
        rest = x.join(small(names), alike(x, names, keys), "left_anti")
    else:
        rest = x
    own = Window.partitionBy(*keys)
    placed = rest.withColumn("i", F.row_number().over(own.orderBy("v")) - 1).withColumn("n", F.count("*").over(own))
    places = {name: F.lit(float(p)) * (F.col("n") - 1) for name, p in shares.items()}
    wanted = F.lit(False)
    for at in places.values():
        wanted = wanted | (F.col("i") == F.floor(at)) | (F.col("i") == F.ceil(at))
    out = between(placed.where(wanted), places, keys)
    return out.unionByName(between(ranked(x, cut(large), shares, keys, few), places, keys)) if some else out


def between(found: DataFrame, places: dict, keys: tuple[str, ...]) -> DataFrame:
    """(keys, a column a share) from the values v at places i of groups of n."""
    picks = []
    for name, at in places.items():
        picks += [F.max(F.when(F.col("i") == F.floor(at), F.col("v"))).alias(f"__a_{name}"), F.max(F.when(F.col("i") == F.ceil(at), F.col("v"))).alias(f"__b_{name}")]
    ends = found.groupBy(*keys, "n").agg(*picks)
    out = []
    for name, at in places.items():
        a, b = F.col(f"__a_{name}"), F.col(f"__b_{name}")
        out.append(F.when(a == b, a).otherwise((F.ceil(at) - at) * a + (at - F.floor(at)) * b).alias(name))
    return ends.select(*keys, *out)


def binned(v: Column, lo: Column, hi: Column) -> Column:
    """The bin of v in lo .. hi, never falling with v: by sign, then by logarithm where the ends are far apart, then evenly."""
    log = lambda c: F.log(F.abs(c))
    by_log = (log(v) - log(lo)) / (log(hi) - log(lo))
    apart = F.greatest(F.abs(lo), F.abs(hi)) > 4 * F.least(F.abs(lo), F.abs(hi))
    # within a factor of four no difference leaves the range of a double
    evenly = (v - lo) / (hi - lo)
    place = lambda share: F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(share * BINS)))
    return F.when((lo <= 0) & (hi >= 0), F.signum(v).cast("long") + 1).when(apart, place(by_log)).otherwise(place(evenly))


def ranked(x: DataFrame, large: DataFrame, shares: dict[str, float], keys: tuple[str, ...], few: int) -> DataFrame:
    """(keys, n, i, v): the values at the wanted places of the large groups (keys, n, lo, hi) of x (keys, v)."""
    ranks = F.array_distinct(F.array(*[f(F.lit(float(p)) * (F.col("n") - 1)).cast("long") for p in shares.values() for f in (F.floor, F.ceil)]))
    now = cut(large.select(*keys, "n", F.explode(ranks).alias("i"), F.lit(0).cast("long").alias("below"), F.col("n").alias("held"), "lo", "hi"))
    while True:
        wide = now.where((F.col("held") > few) & (F.col("lo") < F.col("hi")))
        asked = marked(wide.select(*keys, "lo", "hi").distinct(), keys)
        if not wide.limit(1).count():
            break
        inside = x.join(small(asked), alike(x, asked, keys) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        part = binned(F.col("v"), F.col("lo"), F.col("hi"))
        bins = inside.groupBy(*keys, "lo", "hi", part.alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("b"))
        bins = bins.withColumn("before", F.sum("c").over(Window.partitionBy(*keys, "lo", "hi").orderBy("bin")) - F.col("c"))
        bins = marked(bins.withColumnsRenamed({"lo": "__lo", "hi": "__hi"}), keys)
        hit = alike(wide, bins, keys) & (F.col("lo") == F.col("__lo")) & (F.col("hi") == F.col("__hi")) & (F.col("i") - F.col("below") >= F.col("before")) & (F.col("i") - F.col("below") < F.col("before") + F.col("c"))
        narrowed = wide.join(bins, hit).select(*keys, "n", "i", (F.col("below") + F.col("before")).alias("below"), F.col("c").alias("held"), F.col("a").alias("lo"), F.col("b").alias("hi"))
        now = cut(now.where(~((F.col("held") > few) & (F.col("lo") < F.col("hi")))).unionByName(narrowed))
    done = now.where("lo = hi").select(*keys, "n", "i", F.col("lo").alias("v"))
    left = now.where("lo < hi")
    asked = marked(left.select(*keys, "lo", "hi").distinct(), keys)
    inside = x.join(small(asked), alike(x, asked, keys) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))).select(*keys, "lo", "hi", "v")
    inside = inside.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "lo", "hi").orderBy("v")) - 1)
    inside = marked(inside.withColumnsRenamed({"lo": "__lo", "hi": "__hi"}), keys)
    hit = alike(left, inside, keys) & (F.col("lo") == F.col("__lo")) & (F.col("hi") == F.col("__hi")) & (F.col("i") - F.col("below") == F.col("place"))
    return done.unionByName(left.join(inside, hit).select(*keys, "n", "i", "v"))
