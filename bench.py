"""Times the headline queries and prints one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

HEADLINE = ["stft_onesided", "stft_relational", "cfar_goca", "cfar_ca", "cfar_os", "dbscan_aniso", "components_topk", "geodesic_10", "round_trip", "hurst_user", "higuchi_user", "fractal_boost_tf", "histogram_2d", "ecdf_summary", "stream_sliding", "embedding_components", "monte_carlo", "sea_segments"]


#: Samples of a segment of the published figure's kind, from one to the next, and those that a vector gives.
SEGMENT, STEP, OF_VECTOR = 1000, 31, 32


def sea_segments(spark, sf):
    """The published kind of run: statistics of segments of a second at 1000 samples a second, over one recording.

    The recording is the vectors one after the other, their numbers in turn the two parts of a sample; segments slide.
    """
    from pyspark.sql import functions as F

    from tonefield.config import PRESETS
    from tonefield.plans import detector
    from tonefield.sources import signals

    e = signals.table(spark, sf, "embeddings").select("vec_id", F.posexplode(F.sequence(F.lit(0), F.lit(OF_VECTOR - 1))).alias("i", "_"), "embedding")
    part = lambda j: F.col("embedding")[2 * F.col("i") + j].cast("double")
    recording = e.select(F.lit("recording").alias("signal_id"), (F.col("vec_id") * OF_VECTOR + F.col("i")).alias("n"), part(0).alias("re"), part(1).alias("im"))
    return detector.segment_statistics(recording, PRESETS["sea_statistics"], SEGMENT, step=STEP)


def main() -> None:
    from tonefield.plans.queries import QUERIES
    from tonefield.session import session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", int(cpus), **{"spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/events.parquet").count()  # the JVM and the page cache are warm
    took = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        began = time.perf_counter()
        (sea_segments if name == "sea_segments" else QUERIES[name])(spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    # the published figure: 75 ms a segment, its length and machine unknown
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    out = {"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}
    if "sea_segments" in took:
        out["ms_per_segment"] = round(1000 * took["sea_segments"] / max(1, (n * OF_VECTOR - SEGMENT) // STEP + 1), 2)
    if "embedding_components" in took:
        out["ms_per_short_segment"] = round(1000 * took["embedding_components"] / max(1, n), 2)
    print(json.dumps(out))


if __name__ == "__main__":
    main()
