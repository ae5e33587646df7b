"""Streams: windows over events, frames of a signal with a buffer a key, and a history that grows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import Fractal, Stft
from ..functions.udfs import hurst_of
from ..operators.stft import window_of

#: Samples that a window's buffer takes on at a time.
BLOCK = 1 << 16
EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, delay: str = "1 hour") -> DataFrame:
    """The events files of a folder as a stream, event time as TIMESTAMP, late rows beyond `delay` left out."""
    x = spark.readStream.schema(EVENT).option("recursiveFileLookup", True).parquet(folder)
    return x.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    return windowed(events, F.window("ts", width))


def sliding(events: DataFrame, width: str = "2 hours", step: str = "30 minutes") -> DataFrame:
    return windowed(events, F.window("ts", width, step))


def windowed(events: DataFrame, window: Column) -> DataFrame:
    x = events.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return x.select(F.col("event_type"), F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """A row per user and session: runs of events less than `gap` apart."""
    x = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return x.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def parted(events: DataFrame, folder: str, delay: str = "1 hour") -> tuple[str, DataFrame]:
    """Parts a stream of events (without a watermark) into rows in time and late ones: the folder of the former, and the latter.

    A row is late if its time is further than `delay` behind the greatest of all earlier batches, or if it has none. A
    windowed stream drops such rows without a trace. What a batch is judged by is written beside it, so a batch that
    runs again parts its rows as before. Called again with more in the source it goes on.
    """

    def kept(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        mark = spark.read.parquet(f"{folder}/marks/{number - 1}").first()["mark"] if number else None
        fresh = F.col("ts").isNotNull() if mark is None else F.col("ts").isNotNull() & (F.col("ts") >= F.lit(mark))
        batch.where(F.coalesce(fresh, F.lit(False))).write.mode("overwrite").parquet(f"{folder}/rows/{number}")
        batch.where(~F.coalesce(fresh, F.lit(False))).write.mode("overwrite").parquet(f"{folder}/late/batch={number}")
        now = F.max(F.col("ts")) - F.expr(f"INTERVAL {delay}")
        batch.agg(F.greatest(now, F.lit(mark).cast(dict(batch.dtypes)["ts"])).alias("mark")).write.mode("overwrite").parquet(f"{folder}/marks/{number}")
        batch.unpersist()

    q = events.writeStream.foreachBatch(kept).option("checkpointLocation", f"{folder}/parted").trigger(availableNow=True).start()
    q.awaitTermination()
    late = T.StructType([*events.schema.fields, T.StructField("batch", T.LongType())])
    return f"{folder}/rows", events.sparkSession.read.schema(late).option("basePath", f"{folder}/late").parquet(f"{folder}/late/batch=*")


class Windows(StatefulProcessor):
    """Per signal: the samples that future windows still need, and the number of the next window.

    A sample that comes late still counts for the windows to come; those made stay as they are. A row without a
    value ends the signal at its place.
    """

    fields, columns = "re array<double>, im array<double>", ["signal_id"]

    def __init__(self, width: int, step: int, before: int = 0):
        self.width, self.step, self.before = width, step, before

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tail = handle.getValueState("tail", f"m long, first long, {self.fields}")

    def made(self, x: np.ndarray) -> dict[str, list]:
        """The columns of a row a window, from a matrix with one a row."""
        raise NotImplementedError

    def windows_of(self, n: int) -> int:
        """How many windows a signal of n samples has once it has ended."""
        return max(0, (n - self.width) // self.step + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        m, first, re, im = self.tail.get() if self.tail.exists() else (0, -self.before, [0.0] * self.before, [0.0] * self.before)
        x = np.array(re, float) + 1j * np.array(im, float)
        new = pd.concat(list(rows)).sort_values("n")
        ended = new[new["re"].isna()]["n"]
        new = new[new["re"].notna() & (new["n"] >= first)]
        n, v = new["n"].to_numpy(np.int64), new["re"].to_numpy() + 1j * new["im"].to_numpy()
        end = max([first + len(x), *(n[-1:] + 1)])
        until = int(ended.max()) if len(ended) else None
        last = None if until is None else self.windows_of(until)
        stop = end if last is None else max(end, (last - 1) * self.step - self.before + self.width)
        done = 0
        while True:  # a wide gap is gone through in steps, so that no array has its length
            to = min(stop, max(first + len(x), first + self.width + BLOCK))
            x = np.concatenate([x, np.zeros(max(0, to - first - len(x)), complex)])
            upto = int(np.searchsorted(n, first + len(x)))
            x[n[done:upto] - first] = v[done:upto]
            done = upto
            count = max(0, (first + len(x) - self.width + self.before) // self.step + 1 - m)
            count = count if last is None else max(0, min(count, last - m))
            if count:
                at = m * self.step - self.before - first
                view = np.lib.stride_tricks.sliding_window_view(x[at:], self.width)[:: self.step][:count]
                yield pd.DataFrame({**dict(zip(self.columns, key, strict=True)), "m": np.arange(m, m + count), **self.made(view)})
                m += count
            keep = min(len(x), max(0, m * self.step - self.before - first))
            x, first = x[keep:], first + keep
            if to == stop:
                break
        if until is None:
            self.tail.update((m, first, x.real.tolist(), x.imag.tolist()))
        else:
            self.tail.clear()

    def close(self) -> None:
        pass


class Frames(Windows):
    def __init__(self, c: Stft):
        super().__init__(c.length, c.hop, c.length // 2)
        self.c = c

    def windows_of(self, n: int) -> int:
        return self.c.frames(n)

    def made(self, x: np.ndarray) -> dict[str, list]:
        w = window_of(self.c)
        z = np.fft.fft(x * w, axis=1) / w.sum()
        return {"power": list(np.abs(np.fft.fftshift(z, axes=1) if self.c.two_sided else z[:, : self.c.bins]) ** 2)}


class Hursts(Windows):
    def made(self, x: np.ndarray) -> dict[str, list]:
        return {"hurst": [hurst_of(np.abs(v), max(8, self.width // 4)) for v in x]}


class BandHursts(Windows):
    """Per signal and band: the exponent of each window of its series."""

    columns = ["signal_id", "band"]

    def made(self, x: np.ndarray) -> dict[str, list]:
        return {"hurst": [hurst_of(v.real, max(8, self.width // 4)) for v in x]}


def stream_frames(samples: DataFrame, c: Stft) -> DataFrame:
    """(signal_id, m, power[]) of each frame once all its samples have come; samples: (signal_id, n, re, im).

    A row with a null re ends a signal of n samples: its last frames, which reach beyond, come out padded. State
    is a window a signal.
    """
    return samples.groupBy("signal_id").transformWithStateInPandas(statefulProcessor=Frames(c), outputStructType="signal_id string, m long, power array<double>", outputMode="Append", timeMode="None")


def stream_hurst(samples: DataFrame, width: int = 64, step: int = 16) -> DataFrame:
    """(signal_id, m, hurst) of the magnitude over sliding windows, as their samples come."""
    return samples.groupBy("signal_id").transformWithStateInPandas(statefulProcessor=Hursts(width, step), outputStructType="signal_id string, m long, hurst double", outputMode="Append", timeMode="None")


def band_series(frames: DataFrame, f: Fractal) -> DataFrame:
    """(signal_id, band, n, re, im): the mean log power about every stride-th bin in each frame; frames: (signal_id, m, power[])."""
    half, stride = max(1, f.band // 2), max(1, f.stride)
    last = F.size("power") - 1
    band = F.explode(F.sequence(F.lit(0), F.floor(last / stride).cast("int"))).alias("i")
    x = frames.select("signal_id", F.col("m").alias("n"), F.transform("power", lambda p: F.log(p + 1e-12)).alias("level"), band).withColumn("band", F.col("i") * stride)
    low = F.greatest(F.lit(0), F.col("band") - half)
    part = F.slice("level", low + 1, F.least(F.size("level") - 1, F.col("band") + half) - low + 1)
    mean = F.aggregate(part, F.lit(0.0), lambda s, v: s + v) / F.size(part)
    return x.select("signal_id", "band", "n", mean.alias("re"), F.lit(0.0).alias("im"))


def stream_exponents(samples: DataFrame, c: Stft, f: Fractal, digits: int | None = None) -> DataFrame:
    """(signal_id, band, m, hurst): exponents of each band's log power over windows of frames, as samples come.

    Two stateful steps of one query: the first makes frames of samples, the second windows of frames. Window m begins
    at frame m * step. digits: decimals of the power, if it is to be rounded.
    """
    frames = stream_frames(samples, c)
    if digits is not None:
        frames = frames.withColumn("power", F.transform("power", lambda p: F.round(p, digits)))
    series = band_series(frames, f)
    step = BandHursts(max(8, f.frames), max(1, f.step))
    return series.groupBy("signal_id", "band").transformWithStateInPandas(statefulProcessor=step, outputStructType="signal_id string, band int, m long, hurst double", outputMode="Append", timeMode="None")


def merged(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows written in update mode (with `batch`), the last of each key: the table that they stand for."""
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in rest])


def history(frames: DataFrame) -> DataFrame:
    """(signal_id, k, hits): in how many frames each bin was hit so far; frames: (signal_id, frame_idx, k).

    Of a stream in update mode each batch gives the bins that it hit, with all hits so far; `merged` makes the table.
    """
    return frames.groupBy("signal_id", "k").agg(F.count("*").alias("hits"))


def drained(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """What a stream makes of all that is there, through files in a shared folder.

    A batch that runs again writes its own files over, so nothing counts twice. With mode complete the last batch holds
    the whole result; with mode update rows carry the number of their `batch`. Called again with more in the source it
    goes on where it ended.
    """

    def kept(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/{'all' if mode == 'complete' else f'batch={number}'}")

    q = stream.writeStream.foreachBatch(kept).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())]) if mode == "update" else stream.schema
    read = stream.sparkSession.read.schema(schema).option("basePath", f"{folder}/out")
    return read.parquet(f"{folder}/out/all" if mode == "complete" else f"{folder}/out/batch=*").select(*schema.names)
