"""Streams that are stopped and go on, rows that come late, and state that ends."""

import os
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from tonefield.config import Fractal, Stft
from tonefield.operators import fractal, stft
from tonefield.plans.queries import STORE
from tonefield.sources import signals
from tonefield.streaming import stream

EVENT = stream.EVENT


def events(spark, rows):
    start = datetime(2024, 1, 1)
    return spark.createDataFrame([(i, start + timedelta(hours=h), u, "x", v, None) for i, (h, u, v) in enumerate(rows)], EVENT)


def test_sessions_close_and_late_rows_are_kept_apart(spark, tmp_path):
    source, folder = f"{tmp_path}/source", f"{tmp_path}/run"
    turns = [[(0, 1, 1.0), (1, 1, 2.0), (3, 2, 4.0)], [(40, 2, 8.0)], [(2, 1, 16.0), (41, 2, 32.0)], [(2000, None, 0.0)]]
    seen = []
    for i, rows in enumerate(turns):
        events(spark, rows).coalesce(1).write.parquet(f"{source}/{i}")
        raw = spark.readStream.schema(EVENT).option("recursiveFileLookup", True).parquet(source)
        in_time, late = stream.parted(raw, f"{tmp_path}/parted")
        out = stream.drained(stream.sessions(stream.event_stream(spark, in_time), "6 hours"), "append", folder)
        seen.append(out.count())
    # nothing is given out before it is closed, and nothing twice
    assert seen[0] == 0 and seen[1] == 2 and seen[2] == 2 and seen[3] == 3
    got = {(r["user_id"], r["n"], r["total"]) for r in out.collect()}
    assert got == {(1, 2, 3.0), (2, 1, 4.0), (2, 2, 40.0)}
    assert [(r["user_id"], r["value"], r["batch"]) for r in late.collect()] == [(1, 16.0, 2)]


def test_history_counts_a_batch_that_runs_again_once(spark, tmp_path):
    source, folder = f"{tmp_path}/source", f"{tmp_path}/run"
    rng = np.random.default_rng(1)
    rows = [("ab"[int(s)], int(f), int(k)) for s, f, k in zip(rng.integers(0, 2, 400), np.sort(rng.integers(0, 60, 400)), rng.integers(0, 9, 400))]
    df = spark.createDataFrame(rows, "signal_id string, frame_idx long, k int")
    build = lambda: stream.history(spark.readStream.schema(df.schema).option("recursiveFileLookup", True).parquet(source))
    for i in range(3):
        df.where(F.col("frame_idx") % 60 >= 20 * i).where(F.col("frame_idx") < 20 * i + 20).write.parquet(f"{source}/{i}")
        updates = stream.drained(build(), "update", folder)
    # as if the driver had died before the last batch was noted as done
    last = max(int(x) for x in os.listdir(f"{folder}/state/commits") if x.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(f"{folder}/state/commits/{name}"):
            os.remove(f"{folder}/state/commits/{name}")
    updates = stream.drained(build(), "update", folder)
    assert updates.select("batch").distinct().count() >= 3
    got = sorted(map(tuple, stream.merged(updates, ["signal_id", "k"]).select("signal_id", "k", "hits").collect()))
    assert got == sorted(map(tuple, stream.history(df).select("signal_id", "k", "hits").collect()))


def test_exponents_over_frames_equal_those_of_the_grid(spark, tmp_path):
    rng = np.random.default_rng(2)
    c, f = Stft(16, 4, rate=1.0), Fractal(frames=16, step=4, band=3, stride=2)
    rows = [(s, n, float(v), 0.0) for s in ("a", "b") for n, v in enumerate(np.cumsum(rng.normal(size=220)))]
    df = spark.createDataFrame(rows, "signal_id string, n long, re double, im double")
    source, was = f"{tmp_path}/source", spark.conf.get(STORE[0])
    spark.conf.set(*STORE)
    try:
        end = spark.createDataFrame([(s, 220, None, 0.0) for s in ("a", "b")], df.schema)
        for i, part in enumerate([df.where("n < 70"), df.where("n BETWEEN 70 AND 150"), df.where("n > 150").unionByName(end)]):
            part.write.parquet(f"{source}/{i}")
            out = stream.drained(stream.stream_exponents(spark.readStream.schema(df.schema).option("recursiveFileLookup", True).parquet(source), c, f), "append", f"{tmp_path}/run")
    finally:
        spark.conf.set(STORE[0], was)
    grid = stft.stft(signals.whole(df), c)
    series = grid.join(grid.select(F.col("k").alias("band")).where("band % 2 = 0").distinct(), F.abs(F.col("k") - F.col("band")) <= 1).groupBy("signal_id", "seg_id", "band", "m").agg(F.avg(F.log(F.col("power") + 1e-12)).alias("x"))
    at = F.explode(F.sequence(F.lit(0), F.lit((c.frames(220) - 16) // 4))).alias("w")
    windows = series.select("*", at).where("m >= w * 4 AND m < w * 4 + 16").select("signal_id", "seg_id", "band", "w", (F.col("m") - F.col("w") * 4).alias("i"), "x")
    want = {(r["signal_id"], r["band"], r["w"]): r["hurst"] for r in fractal.hurst(windows, 8, ("signal_id", "seg_id", "band", "w")).collect()}
    got = {(r["signal_id"], r["band"], r["m"]): r["hurst"] for r in out.collect()}
    assert set(got) == set(want) and max(abs(got[x] - want[x]) for x in want) < 1e-9
