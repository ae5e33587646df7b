"""Signals: adapters from tables, generators, segments. A signal is (signal_id, n, re, im)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filled(sparse: DataFrame, length: int | DataFrame) -> DataFrame:
    """sparse(signal_id, n, x) on the whole regular grid 0..length-1, gaps as zero; length: a number, or a table of one (length)."""
    names = sparse.select("signal_id").distinct()
    names = names.withColumn("length", F.lit(length).cast("long")) if isinstance(length, int) else names.crossJoin(F.broadcast(length))
    grid = names.where("length > 0").select("signal_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1)).alias("n"))
    return grid.join(sparse, ["signal_id", "n"], "left").select("signal_id", "n", F.coalesce("x", F.lit(0.0)).alias("re"), F.lit(0.0).alias("im"))


def events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal per event type: the sum of values by hour, from the first day of all events to the last hour of all.

    Events are read once: the hours, a row a type and hour, are written, and the span is taken from those.
    """
    hour = (F.datediff(F.col("ts"), F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour("ts")).alias("hour")
    e = table(spark, sf_dir, "events").where("ts IS NOT NULL")
    e = cut(e.groupBy(F.col("event_type").alias("signal_id"), hour).agg(F.round(F.sum("value"), 2).alias("x")))
    first, last = e.agg(F.min("hour"), F.max("hour")).first()
    day = 0 if first is None else first // 24 * 24
    return filled(e.select("signal_id", (F.col("hour") - day).alias("n"), "x"), 0 if last is None else last - day + 1)


def events_iq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One complex signal: purchases as I, clicks as Q."""
    e = events_hourly(spark, sf_dir).where(F.col("signal_id").isin("purchase", "click"))
    pick = lambda name: F.sum(F.when(F.col("signal_id") == name, F.col("re")).otherwise(0.0))
    return e.groupBy("n").agg(pick("purchase").alias("re"), pick("click").alias("im")).select(F.lit("iq").alias("signal_id"), "n", "re", "im")


def events_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal per user: the values in order of event_id."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("signal_id"), n.cast("long").alias("n"), F.col("value").alias("re"), F.lit(0.0).alias("im"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal of 64 samples per vector."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("signal_id"), F.posexplode("embedding").alias("n", "x")).select("signal_id", F.col("n").cast("long").alias("n"), F.col("x").cast("double").alias("re"), F.lit(0.0).alias("im"))


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One signal: the order value by day since the first."""
    o = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("x"))
    first = o.agg(F.min("day").alias("d0"), F.max("day").alias("d1"))
    o = o.crossJoin(F.broadcast(first)).select(F.lit("orders").alias("signal_id"), F.datediff("day", "d0").cast("long").alias("n"), "x")
    length = first.select(F.datediff("d1", "d0").cast("long").alias("last"))
    days = length.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("n"))
    return days.join(o, "n", "left").select(F.lit("orders").alias("signal_id"), "n", F.coalesce("x", F.lit(0.0)).alias("re"), F.lit(0.0).alias("im"))


def segments(signal: DataFrame, length: int, step: int | None = None, most: int | None = None) -> DataFrame:
    """Tumbling (step None) or sliding segments, numbered by seg_id with n from 0; those cut short are dropped."""
    step = step or length
    n, low = F.col("n"), F.greatest(F.lit(0), F.floor((F.col("n") - length) / step) + 1)
    s = signal.withColumn("seg_id", F.explode(F.sequence(low, F.floor(n / step)))) if step < length else signal.withColumn("seg_id", F.floor(n / step)).where(n % step < length)
    last = signal.groupBy("signal_id").agg(F.max("n").alias("last"))
    s = s.join(last, "signal_id").where(F.col("seg_id") * step + length - 1 <= F.col("last"))
    s = s.where(F.col("seg_id") < most) if most is not None else s
    return s.select("signal_id", F.col("seg_id").cast("int").alias("seg_id"), (n - F.col("seg_id") * step).alias("n"), "re", "im")


def whole(signal: DataFrame) -> DataFrame:
    """The signal as its only segment."""
    return signal.select("signal_id", F.lit(0).alias("seg_id"), "n", "re", "im")


def evenly_spaced(signal: DataFrame, starts: int, length: int) -> DataFrame:
    """So many segments of each signal, their starts spread evenly from its first sample to the last that fits one."""
    n = signal.groupBy("signal_id").agg((F.max("n") + 1).alias("__n")).where(F.col("__n") >= length)
    at = F.explode(F.sequence(F.lit(0), F.lit(starts - 1))).alias("seg_id")
    first = n.select("signal_id", at, "__n").withColumn("__first", F.floor(F.col("seg_id") * (F.col("__n") - length) / max(1, starts - 1)))
    # a sample belongs to few segments: it meets them by blocks of their length
    blocks = first.withColumn("__block", F.explode(F.sequence(F.floor(F.col("__first") / length), F.floor((F.col("__first") + length - 1) / length)))).drop("__n")
    x = signal.withColumn("__block", F.floor(F.col("n") / length)).join(blocks, ["signal_id", "__block"])
    return x.where((F.col("n") >= F.col("__first")) & (F.col("n") < F.col("__first") + length)).select("signal_id", "seg_id", (F.col("n") - F.col("__first")).alias("n"), "re", "im")


def chirp(spark: SparkSession, n: int = 375, rate: float = 12.5e6, alpha: float = 1.5e11, gamma: float = 2e50, real: bool = False) -> DataFrame:
    """A chirp with a linear and a ninth-power term around its middle, under a Tukey taper of 0.1."""
    from ..functions.tapers import taper_column

    t = (F.col("id") - n / 2) / rate
    phase = 2 * math.pi * (alpha * t * t / 2 + gamma * F.pow(t, F.lit(10.0)) / 10)
    w = taper_column("tukey", F.col("id"), n, alpha=0.1)
    return spark.range(n).select(F.lit("chirp").alias("signal_id"), F.col("id").alias("n"), (w * F.cos(phase)).alias("re"), (F.lit(0.0) if real else w * F.sin(phase)).alias("im"))


def mixture(spark: SparkSession, seconds: float = 5.0, rate: int = 44100, f0: float = 500.0, f1: float = 2000.0, noise: float = 0.05, seed: int = 0) -> DataFrame:
    """A linear chirp, an 800 Hz tone, a 1500 Hz pulse in [0.5, 0.7) s and white noise."""
    n = int(seconds * rate)
    t = F.col("id") * seconds / (n - 1)
    sweep = 0.8 * F.cos(2 * math.pi * (f0 * t + (f1 - f0) * t * t / (2 * seconds)))
    pulse = F.when((t >= 0.5) & (t < 0.7), 0.7 * F.sin(2 * math.pi * 1500 * t)).otherwise(0.0)
    return spark.range(n).select(F.lit("mixture").alias("signal_id"), F.col("id").alias("n"), (sweep + 0.6 * F.sin(2 * math.pi * 800 * t) + pulse + noise * normal_of(seed, F.col("id"))).alias("re"), F.lit(0.0).alias("im"))


def white_noise(spark: SparkSession, n: int = 4096, seed: int = 0) -> DataFrame:
    return spark.range(n).select(F.lit("noise").alias("signal_id"), F.col("id").alias("n"), normal_of(seed, F.col("id")).alias("re"), F.lit(0.0).alias("im"))


def normal_of(seed: int, *cols: Column) -> Column:
    """A standard normal number that depends on its arguments only, so that retried tasks agree."""
    u = lambda k: (F.xxhash64(F.lit(seed), F.lit(k), *cols).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)
    return F.sqrt(-2 * F.log(u(0))) * F.cos(2 * math.pi * u(1))


def with_noise(signal: DataFrame, snr_db: Column, seed: int = 1, complex_: bool = True, keys: tuple[str, ...] = ("signal_id", "seg_id")) -> DataFrame:
    """White noise at snr_db under the mean power of each segment, halved between both parts if complex."""
    power = signal.groupBy(*keys).agg(F.avg(F.col("re") ** 2 + F.col("im") ** 2).alias("__p"))
    sigma = F.sqrt(F.col("__p") / F.pow(F.lit(10.0), snr_db / 10) / (2 if complex_ else 1))
    noisy = signal.join(power, list(keys)).withColumn("re", F.col("re") + sigma * normal_of(seed, *keys, F.col("n"), F.lit("i")))
    noisy = noisy.withColumn("im", F.col("im") + sigma * normal_of(seed, *keys, F.col("n"), F.lit("q"))) if complex_ else noisy
    return noisy.drop("__p")
