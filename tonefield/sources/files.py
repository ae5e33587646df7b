"""Files: arrays, sound, result JSON in; Parquet, JSON, CSV out. All reading goes through Spark's readers."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Samples of a row batch.
STEP = 1 << 16
#: What is known of each recording of the sea-clutter set.
TARGETS = [
    ("19931107_135603_starea.cdf", 17, "targA", 2660.0, 9, [8, 9, 10, 11], 2.1, "Sea clutter with 1m sphere target, moderate waves"),
    ("19931107_141630_starea.cdf", 18, "targA", 2660.0, 9, [8, 9, 10, 11], 2.1, "Sea clutter with 1m sphere target, moderate waves"),
    ("19931109_191449_starea.cdf", 30, "targA", 2660.0, 7, [6, 7, 8], 0.9, "Sea clutter with 1m sphere target, calm seas"),
    ("19931110_001635_starea.cdf", 40, "targA", 2660.0, 7, [5, 6, 7, 8], 0.9, "Sea clutter with 1m sphere target, calm seas"),
]
TARGET = "file string, file_number int, target_type string, target_m double, primary_bin int, secondary_bins array<int>, wave_height_m double, description string"


def target_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TARGETS, TARGET)


def named(path: Column, suffix: str) -> Column:
    """The file's name without folder and suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), suffix.replace(".", r"\.") + "$", "")


def npy_signals(spark: SparkSession, path: str, glob: str = "*.npy", suffix: str = ".npy") -> DataFrame:
    """(signal_id, n, re, im) of every array file under path that matches; none at all is an error.

    A file is read where its row is; a matrix gives a signal per column, named file/column.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    if not files.select("path").limit(1).count():
        raise FileNotFoundError(f"no {glob} under {path}")

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for name, data in zip(p["signal_id"], p["content"], strict=True):
                x = np.load(io.BytesIO(data))
                for j, column in enumerate(x.T if x.ndim == 2 else [x]):
                    for at in range(0, len(column), STEP):
                        y = column[at : at + STEP]
                        yield pd.DataFrame({"signal_id": name if x.ndim == 1 else f"{name}/{j}", "n": np.arange(at, at + len(y)), "re": y.real.astype(float), "im": np.imag(y).astype(float)})

    return files.select(named(F.col("path"), suffix).alias("signal_id"), "content").mapInPandas(of, "signal_id string, n long, re double, im double")


def npy_pair(spark: SparkSession, path: str, names: tuple[str, ...] = ("hi", "lo"), strict: bool = True) -> DataFrame:
    """The named recordings together; a missing one is an error only if strict."""
    out = npy_signals(spark, path, "{" + ",".join(f"{n}.npy" for n in names) + "}")
    if strict:
        missing = set(names) - {r[0] for r in out.select("signal_id").distinct().collect()}
        if missing:
            raise FileNotFoundError(f"missing: {', '.join(sorted(missing))}")
    return out


def signal_meta(signal: DataFrame, rate: float = 1000.0, rf_ghz: float = 9.39) -> DataFrame:
    x = signal.groupBy("signal_id").agg(F.count("*").alias("n_samples"), (F.max(F.abs("im")) > 0).alias("is_complex"))
    return x.withColumns({"fs_hz": F.lit(rate), "rf_ghz": F.lit(rf_ghz), "duration_s": F.col("n_samples") / rate})


def wav_signals(spark: SparkSession, path: str) -> DataFrame:
    """(signal_id, n, re, im) of the first channel of 16-bit sound files, within -1..1."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for name, data in zip(p["signal_id"], p["content"], strict=True):
                with wave.open(io.BytesIO(data)) as w:
                    channels, at = w.getnchannels(), 0
                    while raw := w.readframes(STEP):
                        x = np.frombuffer(raw, "<i2")[::channels] / 32768.0
                        yield pd.DataFrame({"signal_id": name, "n": np.arange(at, at + len(x)), "re": x, "im": 0.0})
                        at += len(x)

    return files.select(named(F.col("path"), ".wav").alias("signal_id"), "content").mapInPandas(of, "signal_id string, n long, re double, im double")


def acquisition_pulses(raw: DataFrame, channels: DataFrame, txpol: int = 0) -> DataFrame:
    """(file_id, sweep, range_bin, re, im) of staged acquisition rows (file_id, sweep, txpol, range_bin, channel, value);
    channels (file_id, like_i_idx, like_q_idx) says which channels are I and Q."""
    x = raw.where(F.col("txpol") == txpol).join(F.broadcast(channels), "file_id")
    pick = lambda c: F.sum(F.when(F.col("channel") == F.col(c), F.col("value")))
    return x.groupBy("file_id", "sweep", "range_bin").agg(pick("like_i_idx").alias("re"), pick("like_q_idx").alias("im")).where("re IS NOT NULL AND im IS NOT NULL")


def known_files(files: DataFrame, targets: DataFrame, known: bool = True) -> DataFrame:
    """files (path) with what is known of them by base name, or, known off, those of which nothing is."""
    x = files.withColumn("file", F.element_at(F.split("path", "/"), -1))
    return x.join(F.broadcast(targets), "file", "inner" if known else "left_anti")


def listing(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(path), sorted, of the files under path with the suffix."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path).select("path").orderBy("path")


RESULT = "map<string, struct<rqf_mean: double, rqf_std: double, detection_rate: double, detection_rate_mean: double, detection_rate_std: double, n_simulations: int>>"


def monte_carlo_results(spark: SparkSession, path: str) -> DataFrame:
    """(snr_db, rqf_mean, rqf_std, detection_rate, n_simulations) of a JSON map by SNR, by rising SNR."""
    x = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", RESULT)).alias("snr", "r"))
    return x.select(F.col("snr").cast("int").alias("snr_db"), "r.rqf_mean", "r.rqf_std", F.coalesce("r.detection_rate", "r.detection_rate_mean").alias("detection_rate"), "r.n_simulations").orderBy("snr_db")


def write_signals(signal: DataFrame, path: str) -> None:
    signal.write.partitionBy("signal_id").parquet(path)


def write_json(df: DataFrame, path: str, leave_out: tuple[str, ...] = ()) -> None:
    df.drop(*leave_out).write.json(path)


def write_csv(df: DataFrame, path: str, decimals: int | None = None) -> None:
    """CSV with a header; doubles with so many decimals."""
    if decimals is not None:
        df = df.select(*[F.format_string(f"%.{decimals}f", c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    df.write.option("header", True).csv(path)


def run_stamp() -> Column:
    return F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")
