"""Mixing sources to target weights by pivotal dependent rounding. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE, numbered, stored

WEIGHTS, SEED = (1, 2, 3), 20240229


def unit_type(doc_id: str) -> str:
    return f"struct<uid:bigint,doc_id:{doc_id},m:bigint,size:bigint,a:double,p:double,whole:bigint>"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = 3) -> DataFrame:
    """sizes(source, source_size) with sid (rank of the source by code point, null last), weight and target.

    Targets share `share` of all sizes by weight; none is over `most` times its source's size, and what is
    above is shared again by weight among the rest. That ends where target = min(cap, level x weight), so the
    level is found from running sums over the sources by cap / weight. One row per source, no documents: the
    windows hold the sources in one task, millions of them at most, which no corpus has.
    """
    by_code = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    s = sizes.withColumn("sid", F.row_number().over(by_code) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("sid") % len(weights) + 1)).withColumn("cap", most * F.col("source_size").cast("double")).withColumn("full_at", F.col("cap") / F.col("weight"))
    up = Window.orderBy("full_at", "sid").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumns({"capped": F.coalesce(F.sum("cap").over(up), F.lit(0.0)), "gone": F.coalesce(F.sum("weight").over(up), F.lit(0.0)), "total": share * F.sum("source_size").over(every), "w": F.sum("weight").over(every)})
    s = s.withColumn("level", (F.col("total") - F.col("capped")) / (F.col("w") - F.col("gone")))
    # the level is the first at which the next source is not full
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "sid", "level"))).over(every)["level"]
    return s.withColumn("target", F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap")))).select("source", "source_size", "sid", "weight", "target")


def chance(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) that depends on its arguments only."""
    return F.xxhash64(F.lit(seed), *cols).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def pivot(seed: int, level: int, unit: str):
    """The step that pairs the pending unit s.pend with x: mass (probability x size) moves until one is integral."""

    def step(s: Column, x: Column) -> Column:
        q = s["pend"]
        a, p, b, r = q["a"], q["p"], x["a"], x["p"]
        d_up, d_down = F.least(a * (1 - p), b * r), F.least(a * p, b * (1 - r))
        up = chance(seed, F.lit(level), q["uid"], x["uid"]) * (d_up + d_down) < d_down
        first_done = F.when(up, a * (1 - p) <= b * r).otherwise(a * p <= b * (1 - r))
        with_p = lambda u, v: F.struct(*[u[k].alias(k) for k in ("uid", "doc_id", "m", "size", "a")], v.alias("p"), u["whole"].alias("whole"))
        moved = F.when(up, d_up).otherwise(-d_down)
        left = F.when(first_done, with_p(x, r - moved / b)).otherwise(with_p(q, p + moved / a))
        done = F.when(first_done, with_p(q, F.when(up, 1.0).otherwise(0.0))).otherwise(with_p(x, F.when(up, 0.0).otherwise(1.0)))
        return F.struct(F.concat(s["out"], F.array(done)).cast(f"array<{unit}>").alias("out"), left.cast(unit).alias("pend"))

    return step


def decided(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = 3, seed: int = SEED, fan_in: int = 32) -> DataFrame:
    """uid, doc_id, source, size, m, source_size, target, base, extra: of each unit's m equal rows, all are taken base times and `extra` once more.

    A source's documents share one expected number of copies, target / source_size. Its whole part is taken of each
    row, and so are the whole copies that the fractions of a unit's rows add up to; what is left of a unit, less than
    one document, is rounded by the pivotal method with sizes as weights. So every document keeps its expectation and
    a source's taken words miss its target by less than one document, however often rows repeat.

    Fractions are paired within blocks of about fan_in units, dealt by hash, whatever the source's size;
    each block decides all but one unit, and the residuals form the blocks of the next level. The tree has
    log(largest source) / log(fan_in) levels, each a written table. Chances come from hashes of ids and
    texts, so reruns and retried tasks agree.
    """
    kind = unit_type(dict(docs.dtypes)["doc_id"])
    units = docs.select("doc_id", "source", F.xxhash64("doc_id", "text", F.lit(seed)).alias("uid"), n_words(F.col("text")).alias("size"))
    units = stored(units.groupBy("source", "doc_id", "uid", "size").agg(F.count("*").alias("m")), "units")
    goals = stored(targets(units.groupBy("source").agg(F.sum(F.col("m") * F.col("size")).alias("source_size")), weights, share, most), "targets")
    s = goals.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    s = s.withColumn("base", F.floor("rate").cast("int")).withColumn("part", F.col("rate") - F.col("base")).select(F.col("source").alias("__s"), "sid", "base", "part")
    told = units.join(s, units["source"].eqNullSafe(s["__s"])).withColumn("a", F.col("size").cast("double"))
    told = told.withColumn("whole", F.floor(F.col("m") * F.col("part"))).withColumn("p", F.col("m") * F.col("part") - F.col("whole"))
    columns = ["sid", "uid", "doc_id", "m", "size", "a", "p", "whole"]
    split = (F.col("p") > 0) & (F.col("a") > 0)
    done = [told.where(~split).withColumn("p", F.lit(0.0)).select(*columns)]
    open_ = told.where(split).select(*columns)
    level = 0
    while True:
        counts = stored(open_.groupBy("sid").agg(F.ceil(F.count("*") / fan_in).alias("blocks")), "counts")
        top = counts.agg(F.max("blocks")).first()[0]
        if top is None:
            break
        blocks = open_.join(counts, "sid").withColumn("block", F.pmod(F.xxhash64("uid", F.lit(level)), F.col("blocks")))
        unit = F.struct(*columns[1:]).cast(kind)
        folded = blocks.groupBy("sid", "block").agg(F.sort_array(F.collect_list(unit)).alias("u"), (F.first("blocks") == 1).alias("last"))
        start = F.struct(F.array().cast(f"array<{kind}>").alias("out"), F.col("u")[0].alias("pend"))
        rest = F.when(F.size("u") > 1, F.slice("u", F.lit(2), F.greatest(F.size("u") - 1, F.lit(1)))).otherwise(F.array().cast(f"array<{kind}>"))
        folded = stored(folded.select("sid", "last", F.aggregate(rest, start, pivot(seed, level, kind)).alias("f")), "blocks")
        done.append(folded.select("sid", F.explode("f.out").alias("u")).select("sid", "u.*"))
        left = folded.select("sid", "last", "f.pend.*")
        final = (chance(seed, F.lit(-1), F.col("uid")) < F.col("p")).cast("double")
        done.append(left.where("last").withColumn("p", final).select(*columns))
        open_ = left.where("not last").select(*columns)
        level += 1
    rounded = done[0]
    for d in done[1:]:
        rounded = rounded.union(d)
    out = rounded.join(goals.join(s.select("sid", "base"), "sid"), "sid")
    some = F.col("size") > 0
    out = out.withColumn("extra", F.when(some, F.col("whole") + F.round("p").cast("long")).otherwise(0)).withColumn("base", F.when(some, F.col("base")).otherwise(0))
    return out.select("uid", "doc_id", "source", "size", "m", "source_size", "target", "base", "extra")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = 3, seed: int = SEED, fan_in: int = 32) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, copies, source, uid.

    size counts the words of the text (null: 0), and `decided` says how often each row is taken.
    Rows with equal id, source and text are one unit, of which some rows may be taken once more than others. A null
    source is a source of its own, a null id an id like others; ids may be of any type. A text without words has
    size 0 and is taken 0 times. An empty table gives an empty result; other columns play no part.
    """
    out = decided(docs, weights, share, most, seed, fan_in)
    # a unit's rows again, in two steps so that no array is long
    out = out.withColumn("__k", F.explode(F.sequence(F.lit(0), F.floor((F.col("m") - 1) / 10_000)))).withColumn("__i", F.explode(F.sequence(F.lit(1), F.least(F.lit(10_000), F.col("m") - F.col("__k") * 10_000).cast("int"))))
    out = out.withColumn("copies", F.col("base") + (F.col("__k") * 10_000 + F.col("__i") <= F.col("extra")).cast("int"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source", "uid")


def mixed_documents(docs: DataFrame, seed: int = SEED, **how) -> DataFrame:
    """docs with each row as often as the mix takes it; a row that is taken no times goes.

    Nulls, empty texts and empty tables are as in `mix`. Rows that agree in id, source and text are numbered where
    some of them are taken once more than others, whatever their other columns hold; of such rows any may be the ones.
    """
    units = stored(decided(docs, seed=seed, **how), "mix")
    names = {"uid": "__u", "doc_id": "__d", "source": "__s", "m": "__m", "base": "__b", "extra": "__e"}
    picks = units.where("m * base + extra > 0").select(*[F.col(c).alias(x) for c, x in names.items()])
    marked = docs.withColumn("__uid", F.xxhash64("doc_id", "text", F.lit(seed)))
    hit = (F.col("__uid") == F.col("__u")) & F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("source").eqNullSafe(F.col("__s"))
    alike = F.col("__e").isin(0) | (F.col("__e") == F.col("__m"))
    again = lambda rows: rows.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int")))).select(*docs.columns)
    out = again(marked.join(picks.where(alike), hit).withColumn("__n", F.col("__b") + (F.col("__e") > 0).cast("int")))
    uneven = picks.where(~alike)
    if uneven.limit(1).count():
        rows = numbered(stored(marked.join(uneven, hit), "uneven"), ["__u", "__d", "__s"], "__place")
        rows = rows.withColumn("__n", F.col("__b") + (F.col("__place") <= F.col("__e")).cast("int")).where("__n > 0")
        out = out.unionByName(again(rows))
    return out
