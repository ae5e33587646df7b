"""Acoustic classes of components by their frequency, and the distance their energy suggests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import COMPONENT

#: Order, class, lowest and highest frequency, fundamental, harmonics, bandwidth, modulation.
SIGNATURES = [
    (0, "jet_engine", 500.0, 8000.0, 1000.0, [1000.0, 2000.0, 4000.0, 6000.0], "broadband", "continuous"),
    (1, "propeller", 50.0, 500.0, 80.0, [80.0, 160.0, 240.0, 320.0, 400.0], "narrowband", "periodic"),
    (2, "helicopter", 20.0, 200.0, 25.0, [25.0, 50.0, 75.0, 100.0, 125.0, 150.0], "narrowband", "periodic"),
    (3, "turboprop", 80.0, 2000.0, 100.0, [100.0, 200.0, 300.0, 400.0, 500.0], "mixed", "continuous"),
    (4, "drone", 100.0, 8000.0, 200.0, [200.0, 400.0, 600.0, 800.0, 1000.0], "narrowband", "periodic"),
]
SIGNATURE = "ord int, aircraft_type string, f_min double, f_max double, fundamental double, harmonics array<double>, bandwidth string, modulation string"


def signatures(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SIGNATURES, SIGNATURE)


def classified(parts: DataFrame, known: DataFrame | None = None, keys: tuple[str, ...] = COMPONENT) -> DataFrame:
    """parts (keys, centroid_freq, ...) with aircraft_type and confidence.

    Of the classes whose range holds the frequency the best score wins, the first of equal ones: nearness to the
    fundamental and 0.2 for each harmonic within a tenth. No score over zero is `unknown`, 0. The classes are a
    table of a few rows, so it is broadcast.
    """
    known = signatures(parts.sparkSession) if known is None else known
    f = F.col("centroid_freq")
    score = F.greatest(F.lit(0.0), 1 - F.abs(f - F.col("fundamental")) / F.col("fundamental")) + 0.2 * F.size(F.filter("harmonics", lambda h: F.abs(f - h) < 0.1 * h))
    hits = parts.join(F.broadcast(known), f.between(F.col("f_min"), F.col("f_max"))).withColumn("score", score).where("score > 0")
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "ord"))
    best = hits.withColumn("__r", first).where("__r = 1").select(*keys, "aircraft_type", F.least(F.lit(1.0), "score").alias("confidence"))
    return parts.join(best, list(keys), "left").withColumn("aircraft_type", F.coalesce("aircraft_type", F.lit("unknown"))).withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def distance(energy: Column) -> Column:
    """Metres: 100 x 10^(lost dB / 20) between 10 and 20000, where 80 dB is the source; 50 if nothing was lost."""
    lost = 80 - 10 * F.log10(energy + 1e-10)
    return F.when(lost <= 0, 50.0).otherwise(F.greatest(F.lit(10.0), F.least(F.lit(20000.0), 100 * F.pow(F.lit(10.0), lost / 20))))


def analysed(parts: DataFrame) -> DataFrame:
    """parts with class, confidence and distance."""
    return classified(parts).withColumn("distance_m", distance(F.col("energy")))
