"""Queries over the driver's tables, by name. Their SQL is in the module beside this one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import KEYS, Cfar, Cluster, Fractal, Preset, Stft
from ..functions import udfs
from ..operators import cfar, classify, cluster, components, evaluate, fractal, morphology, stft, triangulate
from ..session import cut, shared_dir
from ..sources import files, signals
from ..streaming import stream
from . import detector

HOURLY = Stft(32, 8, rate=1.0)
IQ = Stft(32, 8, rate=1.0, two_sided=True)
WINDOW = Cfar("goca", 1, 2, 0.05)
LOOSE = Cfar("ca", 1, 2, 0.4, count="ring")
ANISO, ISO = Cluster("dbscan", 3, 3), Cluster("dbscan_iso", 2, 4, (1.0, 1.0))
EXTENDED = Cfar("os", 1, 2, 0.3, count="ring", value="magnitude")
SCALED = Cluster("hdbscan", 20.0, 3)
BOOST = Fractal(threshold=0.1, window=64, frames=24, step=6, band=5, stride=2)
#: Trials of each SNR; every trial is a segment, so their number is the size of the job and nothing else.
RUNS = 5
#: Turns in which a table is given to a stream.
TURNS = 3
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def tidy(df: DataFrame, digits: int = 6, leave: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[r(c, digits).alias(c) if t == "double" and c not in leave else F.col(c) for c, t in df.dtypes if c != "seg_id"])


def hourly(spark: SparkSession, d: str) -> DataFrame:
    return signals.whole(signals.events_hourly(spark, d))


def grid(spark: SparkSession, d: str) -> DataFrame:
    """The hourly grid with its power to four decimals, on which all decisions rest."""
    return stft.stft(hourly(spark, d), HOURLY).withColumn("power", r("power", 4))


def loose(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The grid and the cells of a permissive detector."""
    g = cut(grid(spark, d))
    return g, cut(cfar.detect(g, LOOSE).where("detected").select(*KEYS, "k", "m", "freq_hz", "time_s", "power"))


def labelled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    g, cells = loose(spark, d)
    return g, cut(cluster.dbscan(cells, ANISO))


@query
def signal_hourly(spark, d):
    return tidy(hourly(spark, d))


@query
def signal_iq(spark, d):
    return tidy(signals.events_iq(spark, d))


@query
def signal_padded(spark, d):
    return tidy(signals.filled(signals.events_hourly(spark, d).select("signal_id", "n", F.col("re").alias("x")), 1024))


@query
def signal_segments(spark, d):
    return signals.segments(signals.events_hourly(spark, d), 100, most=6).select("signal_id", "seg_id", "n", r("re").alias("re"))


@query
def signal_sampled(spark, d):
    return signals.evenly_spaced(signals.events_hourly(spark, d), 7, 100).select("signal_id", "seg_id", "n", r("re").alias("re"))


@query
def first_samples(spark, d):
    """I, Q, magnitude and phase of the first fifty samples."""
    x = signals.events_iq(spark, d).where("n < 50")
    return x.select("signal_id", "n", r("re").alias("i"), r("im").alias("q"), r(F.sqrt(F.col("re") ** 2 + F.col("im") ** 2)).alias("magnitude"), r(F.atan2("im", "re")).alias("phase"))


@query
def signal_frames(spark, d):
    return signals.segments(signals.events_hourly(spark, d), 96, 24).select("signal_id", "seg_id", "n", r("re").alias("re"))


@query
def signal_summary(spark, d):
    return tidy(evaluate.signal_summary(signals.whole(signals.events_iq(spark, d))), 5)


@query
def histogram_1d(spark, d):
    v = signals.events_hourly(spark, d).select(F.col("signal_id").alias("metric"), F.col("re").alias("value"))
    return tidy(evaluate.histogram(v, 20))


@query
def histogram_2d(spark, d):
    x = signals.table(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return evaluate.histogram_2d(x, 100)


@query
def running_mean_std(spark, d):
    return tidy(evaluate.running(signals.whole(signals.orders_daily(spark, d)), 30), 3)


@query
def autocorrelation(spark, d):
    return tidy(evaluate.autocorrelation(hourly(spark, d)))


def _taper(name: str) -> Query:
    """The hourly grid under a taper of 64 samples."""
    return lambda spark, d: stft.stft(hourly(spark, d), Stft(64, 16, name, rate=1.0)).select("signal_id", "k", "m", r("power", 4).alias("power"))


for _name in ("gaussian", "hamming", "hann", "blackman", "bartlett", "flattop", "tukey", "kaiser"):
    QUERIES[f"taper_{_name}"] = _taper(_name)


@query
def stft_onesided(spark, d):
    return grid(spark, d).select("signal_id", "k", "m", r("freq_hz").alias("freq_hz"), r("time_s").alias("time_s"), r("re", 4).alias("re"), r("im", 4).alias("im"), "power")


@query
def stft_twosided(spark, d):
    g = stft.stft(signals.whole(signals.events_iq(spark, d)), IQ)
    return g.select("signal_id", "k", "m", r("freq_hz").alias("freq_hz"), r("re", 4).alias("re"), r("im", 4).alias("im"), r("power", 4).alias("power"))


@query
def stft_relational(spark, d):
    g = stft.stft_relational(hourly(spark, d), HOURLY)
    return g.select("signal_id", "k", "m", r("freq_hz").alias("freq_hz"), r("time_s").alias("time_s"), r("re", 4).alias("re"), r("im", 4).alias("im"), r("power", 4).alias("power"))


@query
def spectrogram_db(spark, d):
    g = components.relative_db(grid(spark, d))
    p = F.col("power")
    return g.select("signal_id", "k", "m", r(10 * F.log10(p + 1e-12)).alias("power_db"), r(20 * F.log10(F.sqrt(p) + 1e-10)).alias("magnitude_db"), r("db").alias("relative_db"), r(F.log(p + 1e-12)).alias("log_power"))


@query
def spectrogram_gaussian(spark, d):
    """The two-sided spectrogram under a Gaussian of a sixth of the window, in dB."""
    g = stft.stft(signals.whole(signals.events_iq(spark, d)), Stft(32, 8, sigma=None, rate=1.0, two_sided=True))
    return g.select("signal_id", "k", "m", r("freq_hz").alias("freq_hz"), r(10 * F.log10(r("power", 4) + 1e-12), 4).alias("db"))


@query
def region_db(spark, d):
    x = components.region_db(grid(spark, d), 96.0, 480.0, 0.0625, 0.375)
    return x.select("signal_id", "k", "m", r("db").alias("db"))


@query
def velocity_table(spark, d):
    """The mean Doppler frequency of each frame, weighted by power, its velocity, and the greatest that the pulse rate tells apart."""
    g = stft.stft(signals.whole(signals.events_iq(spark, d)), IQ).withColumn("power", r("power", 4))
    x = g.groupBy("signal_id", "m").agg((F.sum(F.col("freq_hz") * F.col("power")) / F.sum("power")).alias("doppler_hz"))
    return tidy(x.withColumn("velocity_mps", components.velocity(F.col("doppler_hz"))).withColumn("v_max_mps", components.velocity(F.lit(IQ.rate / 2))), 9)


@query
def doppler_spectrum(spark, d):
    s = stft.spectrum(signals.whole(signals.events_iq(spark, d)), 1.0, 128)
    return s.select("signal_id", "k", r("freq_hz").alias("freq_hz"), r("magnitude", 4).alias("magnitude"), r(components.velocity(F.col("freq_hz"))).alias("velocity"))


@query
def welch_psd(spark, d):
    return tidy(stft.welch(hourly(spark, d), 1.0, 64), 4)


@query
def spectrogram_density(spark, d):
    return tidy(stft.mean_frames(hourly(spark, d), 1.0, 64, 16), 4)


@query
def level_marginals(spark, d):
    return tidy(evaluate.marginals(grid(spark, d)))


def _cfar(c: Cfar) -> Query:
    def q(spark, d):
        x = cfar.detect(grid(spark, d), c).where("detected")
        return x.select("signal_id", "k", "m", "power", r("noise", 8).alias("noise"), r("threshold", 5).alias("threshold"))

    return q


CFARS = {
    "cfar_goca": WINDOW,
    "cfar_goca_sides": Cfar("goca_sides", 1, 2, 0.05, strict=True, count="ring"),
    "cfar_soca_corner": Cfar("soca", 1, 2, 0.05),
    "cfar_soca_band": Cfar("soca_bands", 1, 2, 0.05),
    "cfar_ca": LOOSE,
    "cfar_ca_corners": Cfar("ca", 1, 2, 0.05),
    "cfar_os": Cfar("os", 1, 2, 0.3),
    "cfar_ca_magnitude": Cfar("ca", 1, 2, 0.4, count="ring", value="magnitude"),
}
for _name, _c in CFARS.items():
    QUERIES[_name] = _cfar(_c)
QUERIES["cfar_goca_k"] = _cfar(Cfar("goca", 1, 2, 0.2, "k"))


@query
def k_params(spark, d):
    x = cfar.k_parameters(grid(spark, d))
    ratio = F.col("var") / (F.col("mean") * F.col("mean"))
    return x.select("signal_id", "n", r("mean", 4).alias("mean"), r(ratio).alias("ratio"), r(F.greatest(F.lit(0.5), F.least(F.lit(100.0), 1 / (2 * ratio - 1)))).alias("shape"))


@query
def zero_map(spark, d):
    return cfar.zero_map(grid(spark, d)).select("signal_id", "k", "m", "zero")


@query
def dilate4(spark, d):
    g, cells = loose(spark, d)
    return morphology.dilated(cells, g).select("signal_id", "k", "m")


@query
def dilate_rect(spark, d):
    g, cells = loose(spark, d)
    return morphology.dilated(cells, g, morphology.rectangle(5, 1)).select("signal_id", "k", "m")


@query
def closing_opening(spark, d):
    g, cells = loose(spark, d)
    return morphology.opened(morphology.closed(cells, g), g).select("signal_id", "k", "m")


def _zeroed(g: DataFrame) -> DataFrame:
    """The weakest two fifths as barriers, so that growth meets some."""
    return cut(cfar.zero_map(g, 0.4))


@query
def geodesic_10(spark, d):
    g = _zeroed(cut(grid(spark, d)))
    return morphology.grown(cfar.detect(g, WINDOW).where("detected").select(*KEYS, "k", "m"), g, rounds=10).select("signal_id", "k", "m")


@query
def geodesic_full(spark, d):
    g = _zeroed(cut(grid(spark, d)))
    return morphology.grown(cfar.detect(g, WINDOW).where("detected").select(*KEYS, "k", "m"), g, rounds=None, steps=morphology.SQUARE).select("signal_id", "k", "m")


@query
def dbscan_aniso(spark, d):
    return labelled(spark, d)[1].drop("seg_id")


@query
def dbscan_iso(spark, d):
    return cluster.dbscan(loose(spark, d)[1], ISO).drop("seg_id")


@query
def hdbscan_like(spark, d):
    x = loose(spark, d)[1].withColumn("freq_hz", F.col("k") * 400.0).withColumn("time_s", F.col("m") * 0.5)
    return cluster.hdbscan(x, SCALED).drop("seg_id")


@query
def agglomerative(spark, d):
    x = loose(spark, d)[1].withColumn("freq_hz", F.col("k") * 400.0).withColumn("time_s", F.col("m") * 0.5)
    return cluster.agglomerative(x, 4).drop("seg_id")


@query
def spanning_tree(spark, d):
    x = loose(spark, d)[1].withColumn("freq_hz", F.col("k") * 400.0).withColumn("time_s", F.col("m") * 0.5)
    return tidy(cluster.spanning_tree(x, SCALED))


@query
def components_topk(spark, d):
    g, labels = labelled(spark, d)
    return tidy(components.strongest(components.components(labels, g), 3), 4)


@query
def components_grown(spark, d):
    g, labels = labelled(spark, d)
    g = _zeroed(g)
    seeds = components.strongest(components.components(labels, g), 2)
    cells = labels.join(seeds.select(*components.COMPONENT), list(components.COMPONENT), "left_semi")
    return tidy(components.grown_components(morphology.grown(cells, g, components.COMPONENT, 3), g), 4)


@query
def local_masks(spark, d):
    """The masks from which the plain detector rebuilds the two strongest components."""
    g, labels = labelled(spark, d)
    seeds = components.strongest(components.components(labels, g), 2)
    cells = labels.join(seeds.select(*components.COMPONENT), list(components.COMPONENT), "left_semi")
    return components.local_masks(cells, g).drop("seg_id")


@query
def smoothed_masks(spark, d):
    """The masks of the two strongest components, closed and opened."""
    g, labels = labelled(spark, d)
    seeds = components.strongest(components.components(labels, g), 2)
    cells = labels.join(seeds.select(*components.COMPONENT), list(components.COMPONENT), "left_semi").select(*components.COMPONENT, "k", "m")
    return components.final_masks(cells, g, None).select("signal_id", "cluster_id", "k", "m")


@query
def acoustic_analysis(spark, d):
    """Components with class, confidence and distance; the hourly frequencies stand for audible ones."""
    g, labels = labelled(spark, d)
    x = components.components(labels, g.withColumn("freq_hz", F.col("freq_hz") * 2000.0))
    x = classify.analysed(x.withColumn("energy", F.col("energy") / 1e4))
    return tidy(x.select("signal_id", "cluster_id", "n_points", "centroid_freq", "centroid_time", "aircraft_type", "confidence", "distance_m"), 4)


@query
def extended_pipeline(spark, d):
    """Order statistic on magnitudes, then density clusters of scaled cells, then components."""
    g = cut(grid(spark, d))
    cells = cut(cfar.detect(g, EXTENDED).where("detected").select(*KEYS, "k", "m", "freq_hz", "time_s", "power"))
    scaled = cells.withColumn("freq_hz", F.col("k") * 400.0).withColumn("time_s", F.col("m") * 0.5)
    return tidy(components.components(cluster.hdbscan(scaled, SCALED), g), 4)


@query
def doppler_info(spark, d):
    g, labels = labelled(spark, d)
    return tidy(components.doppler(labels, g), 4)


@query
def cluster_info(spark, d):
    g, labels = labelled(spark, d)
    return tidy(components.cluster_info(labels, g), 4)


@query
def detection_overview(spark, d):
    g, labels = labelled(spark, d)
    x = components.cluster_info(labels, g)
    return tidy(x.select("signal_id", "cluster_id", "time_mean", "freq_mean", "velocity", "energy", "n_points", F.when(F.col("approaching"), "approaching").otherwise("receding").alias("direction")), 4)


@query
def rebuilt_signal(spark, d):
    g, cells = loose(spark, d)
    lengths = stft.padded_length(hourly(spark, d), HOURLY)
    x = stft.istft(g.join(cells.select(*KEYS, "k", "m"), [*KEYS, "k", "m"], "left_semi"), HOURLY, lengths, real=True)
    return tidy(x, 4)


@query
def round_trip(spark, d):
    s = hourly(spark, d)
    return tidy(stft.istft(stft.stft(s, HOURLY), HOURLY, stft.padded_length(s, HOURLY), real=True), 4)


@query
def quality_of_rebuilt(spark, d):
    s = hourly(spark, d)
    g, cells = loose(spark, d)
    x = stft.istft(g.join(cells.select(*KEYS, "k", "m"), [*KEYS, "k", "m"], "left_semi"), HOURLY, stft.padded_length(s, HOURLY), real=True)
    return tidy(evaluate.rqf(s, x), 4)


def _users(spark: SparkSession, d: str) -> DataFrame:
    return signals.events_user(spark, d).select("signal_id", F.col("n").alias("i"), F.col("re").alias("x"))


@query
def hurst_user(spark, d):
    return tidy(fractal.hurst(_users(spark, d), 10, ("signal_id",)))


@query
def higuchi_user(spark, d):
    return tidy(fractal.higuchi(_users(spark, d), 8, ("signal_id",)))


@query
def fractal_boost_time(spark, d):
    s, g = hourly(spark, d), cut(grid(spark, d))
    return fractal.boost_time(s, g, HOURLY, BOOST).select("signal_id", "k", "m")


@query
def fractal_boost_tf(spark, d):
    return fractal.boost_grid(cut(grid(spark, d)), BOOST).select("signal_id", "k", "m")


@query
def boosted_cells(spark, d):
    s, g = hourly(spark, d), cut(grid(spark, d))
    cells = cfar.detect(g, WINDOW).where("detected")
    return fractal.combined(cells, fractal.boost_time(s, g, HOURLY, BOOST), g, BOOST, False).select("signal_id", "k", "m")


@query
def boost_stats(spark, d):
    s, g = hourly(spark, d), cut(grid(spark, d))
    cells = cut(cfar.detect(g, WINDOW).where("detected").select(*KEYS, "k", "m"))
    wide = cut(fractal.boost_time(s, g, HOURLY, BOOST))
    return tidy(fractal.boost_statistics(cells, wide, fractal.combined(cells, wide, g, BOOST, False)))


@query
def local_maxima(spark, d):
    return morphology.local_maxima(grid(spark, d), "power", 3).where("is_max").select("signal_id", "k", "m", "power")


@query
def peaks(spark, d):
    return morphology.peaks(grid(spark, d), "power", 0.9, 3).select("signal_id", "k", "m", "power")


def _peaks(spark: SparkSession, d: str) -> DataFrame:
    return cut(triangulate.numbered_peaks(grid(spark, d).withColumn("freq_hz", F.col("k") * 100.0).withColumn("time_s", F.col("m") * 0.05), 0.9, 3))


@query
def delaunay(spark, d):
    return triangulate.triangles(_peaks(spark, d)).drop("seg_id")


@query
def triangle_components(spark, d):
    p = _peaks(spark, d)
    return tidy(triangulate.triangle_components(triangulate.triangle_groups(cut(triangulate.triangles(p)), p, 0.25), p), 4)


def _tones(spark: SparkSession, d: str) -> DataFrame:
    """Components with frequencies from keys and energies from sizes, to classify and range."""
    p = signals.table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 1000 * 3.0 + 20.0).alias("centroid_freq"), F.pow(F.lit(10.0), F.col("p_size") / 5.0).alias("energy"))


@query
def classify_signature(spark, d):
    return classify.classified(_tones(spark, d), keys=("id",)).select("id", "aircraft_type", r("confidence").alias("confidence"))


@query
def distance_model(spark, d):
    return _tones(spark, d).select("id", r(classify.distance(F.col("energy")), 4).alias("distance_m"))


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Days of the hourly signals as segments; hours over 1.5 times the mean as components of one hour."""
    s = signals.segments(signals.events_hourly(spark, d), 24)
    mean = s.groupBy("signal_id").agg(F.avg("re").alias("mu"))
    loud = s.join(mean, "signal_id").where("re > 1.5 * mu")
    parts = loud.select(*KEYS, F.col("n").cast("int").alias("cluster_id"), F.col("re").alias("energy"))
    dop = parts.withColumn("doppler_freq_hz", F.col("cluster_id") - F.lit(12.0)).withColumn("velocity_estimate_mps", components.velocity(F.col("doppler_freq_hz")))
    return evaluate.segment_results(s, parts, dop)


@query
def segment_stats(spark, d):
    return tidy(evaluate.segment_rollup(_results(spark, d)))


@query
def snr_rollup(spark, d):
    e = signals.table(spark, d, "events")
    t = e.select((F.col("user_id") % 6 * 5 + 5).cast("int").alias("snr_db"), F.when(F.col("event_id") % 7 > 0, F.col("value")).alias("rqf"), (F.col("event_id") % 7 > 0).cast("double").alias("detected"))
    return tidy(evaluate.trials_rollup(t), 5)


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    return signals.table(spark, d, "events").select(F.col("event_type").alias("metric"), "value")


@query
def ecdf(spark, d):
    return tidy(evaluate.ecdf(_metrics(spark, d)), 9)


@query
def ecdf_summary(spark, d):
    return tidy(evaluate.ecdf_summary(_metrics(spark, d)))


@query
def quantile_markers(spark, d):
    return tidy(evaluate.quantile_marker(_metrics(spark, d), 0.9))


@query
def accumulated_history(spark, d):
    cells = loose(spark, d)[1].select("signal_id", F.col("m").alias("frame_idx"), "k")
    return stream.history(cells)


@query
def frame_summary(spark, d):
    n = loose(spark, d)[1].groupBy("signal_id", F.col("m").alias("frame_idx")).agg(F.count("*").alias("n_pixels"), F.count_distinct("k").alias("n_clusters"))
    return tidy(evaluate.frame_summary(n))


@query
def mask_coverage(spark, d):
    g, cells = loose(spark, d)
    return tidy(evaluate.coverage(cells, g))


def _two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    g, cells = loose(spark, d)
    return cells, cfar.detect(g, WINDOW).where("detected")


@query
def mask_union(spark, d):
    return morphology.union(*_two(spark, d)).drop("seg_id")


@query
def mask_intersect(spark, d):
    return morphology.intersection(*_two(spark, d)).drop("seg_id")


@query
def mask_except(spark, d):
    return morphology.difference(*_two(spark, d)).drop("seg_id")


@query
def nearest_bin(spark, d):
    p = signals.table(spark, d, "part").select("p_brand", "p_size", "p_retailprice").groupBy("p_brand", "p_size").agg(F.min("p_retailprice").alias("range_m"))
    ranges = p.select(F.col("p_brand").alias("file_id"), F.col("p_size").cast("int").alias("range_bin"), "range_m")
    targets = signals.table(spark, d, "part").groupBy(F.col("p_brand").alias("file_id")).agg(F.round(F.avg("p_retailprice"), 2).alias("target_m"))
    return evaluate.nearest_bin(ranges, targets)


@query
def interval_join(spark, d):
    """Hours in the band of the day that holds the greatest hour of each signal."""
    s = signals.events_hourly(spark, d)
    top = s.groupBy("signal_id").agg(F.max_by("n", F.struct("re", -F.col("n"))).alias("at")).select(F.col("signal_id").alias("sid"), (F.floor(F.col("at") / 24) * 24).alias("t0"), (F.floor(F.col("at") / 24) * 24 + 24).alias("t1"))
    return s.join(top, (F.col("signal_id") == F.col("sid")) & (F.col("n") >= F.col("t0")) & (F.col("n") < F.col("t1"))).select("signal_id", "n", r("re").alias("re"))


#: Of the session while a stream runs that keeps arrays as state, which only this store can.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _streamed(spark: SparkSession, turns: list[DataFrame], build, mode: str) -> DataFrame:
    """What `build` makes of a stream of the rows, which come as files in turns; after each turn the stream stops and goes on."""
    folder = f"{shared_dir(spark)}/tonefield-stream-{uuid.uuid4().hex}"
    out, was = None, spark.conf.get(STORE[0])
    spark.conf.set(*STORE)
    try:
        for i, rows in enumerate(turns):
            rows.write.parquet(f"{folder}/source/{i}")
            out = stream.drained(build(f"{folder}/source"), mode, folder)
    finally:
        spark.conf.set(STORE[0], was)
    return out


def _events(spark: SparkSession, d: str, build, mode: str) -> DataFrame:
    return _times(_streamed(spark, [signals.table(spark, d, "events")], lambda folder: build(stream.event_stream(spark, folder)), mode))


def _in_turns(rows: DataFrame, by: str, turns: int = TURNS) -> list[DataFrame]:
    """rows parted into ranges of a column, of like width; rows without it go with the first."""
    low, high = rows.agg(F.min(by), F.max(by)).first()
    if low is None:
        return [rows]
    ends = [low + (high - low) / turns * i for i in range(1, turns)]
    which = F.lit(0)
    for e in ends:
        which = which + F.coalesce((F.col(by) >= F.lit(e)).cast("int"), F.lit(0))
    return [rows.where(which == i) for i in range(turns)]


def _times(df: DataFrame) -> DataFrame:
    return df.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")).withColumn("end", F.date_format("end", "yyyy-MM-dd HH:mm:ss"))


@query
def stream_tumbling(spark, d):
    return _events(spark, d, stream.tumbling, "complete")


@query
def stream_sliding(spark, d):
    return _events(spark, d, stream.sliding, "complete")


@query
def stream_session(spark, d):
    """Sessions as they close, from files in turn; a last event of nobody, long after, closes those that are open."""
    e = signals.table(spark, d, "events")
    last = e.agg((F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"))
    end = last.select(*[F.col("ts").cast(t).alias(c) if c == "ts" else F.lit(None).cast(t).alias(c) for c, t in e.dtypes])
    turns = [*_in_turns(e.where("ts IS NOT NULL"), "ts"), end]
    return _times(_streamed(spark, turns, lambda folder: stream.sessions(stream.event_stream(spark, folder)), "append"))


def _samples(spark: SparkSession, d: str, build) -> DataFrame:
    """What `build` makes of a stream of the hourly samples, each signal's end told by a row without a value."""
    x = signals.events_hourly(spark, d)
    end = x.groupBy("signal_id").agg((F.max("n") + 1).alias("n")).select("signal_id", "n", F.lit(None).cast("double").alias("re"), F.lit(0.0).alias("im"))
    rows = cut(x.unionByName(end))
    return _streamed(spark, _in_turns(rows, "n"), lambda folder: build(spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(folder)), "append")


@query
def stream_stft(spark, d):
    """The hourly grid's power, made frame by frame as samples come."""
    x = _samples(spark, d, lambda s: stream.stream_frames(s, HOURLY)).select("signal_id", F.col("m").cast("int").alias("m"), F.posexplode("power").alias("k", "power"))
    return x.select("signal_id", "k", "m", r("power", 4).alias("power"))


@query
def stream_hurst(spark, d):
    return tidy(_samples(spark, d, lambda s: stream.stream_hurst(s, 64, 16)))


@query
def stream_exponents(spark, d):
    """The exponents that fractal_boost_tf judges, from frames as they come."""
    x = _samples(spark, d, lambda s: stream.stream_exponents(s, HOURLY, BOOST, 4))
    return x.select("signal_id", "band", (F.col("m") * BOOST.step).cast("int").alias("t0"), r("hurst").alias("hurst"))


@query
def stream_history(spark, d):
    """accumulated_history as running state: detections come in turns of frames, each batch updates the bins that it hit."""
    cells = cut(loose(spark, d)[1].select("signal_id", F.col("m").cast("long").alias("frame_idx"), "k"))
    updates = _streamed(spark, _in_turns(cells, "frame_idx"), lambda folder: stream.history(spark.readStream.schema(cells.schema).option("recursiveFileLookup", True).parquet(folder)), "update")
    return stream.merged(updates, ["signal_id", "k"])


@query
def sql_functions(spark, d):
    """Fractal figures of the vectors by the functions for SQL."""
    udfs.register(spark)
    signals.table(spark, d, "embeddings").createOrReplaceTempView("tonefield_vectors")
    return spark.sql("SELECT vec_id, round(hurst(transform(embedding, x -> CAST(x AS DOUBLE))), 4) + 0.0D AS hurst, round(higuchi(transform(embedding, x -> CAST(x AS DOUBLE))), 4) + 0.0D AS higuchi, round(doppler_velocity(CAST(vec_id AS DOUBLE)), 6) AS velocity, round(power_db(CAST(vec_id AS DOUBLE)), 6) AS db FROM tonefield_vectors")


@query
def monte_carlo(spark, d):
    """The published curve's six SNR, RUNS trials each."""
    return tidy(evaluate.trials_rollup(detector.monte_carlo(spark, [5, 10, 15, 20, 25, 30], RUNS)), 3)


@query
def embedding_components(spark, d):
    """The whole chain over the vectors as signals of 64 samples."""
    p = Preset(Stft(16, 4, rate=1.0), Cfar("ca", 0, 1, 0.4, count="ring"), Cluster(eps=3, min_samples=2))
    f = detector.detected(signals.whole(signals.embeddings(spark, d)), p, 64, top=1)
    return tidy(f.components, 4)


@query
def frame_statistics(spark, d):
    p = Preset(HOURLY, LOOSE, ANISO)
    return tidy(detector.frame_statistics(signals.events_hourly(spark, d), p, 240, 120, mask="dc"))


@query
def sea_statistics(spark, d):
    p = Preset(IQ, LOOSE, ANISO)
    return tidy(detector.segment_statistics(signals.events_iq(spark, d), p, 240), 3)


@query
def target_files(spark, d):
    """Known recordings met by base name."""
    names = spark.createDataFrame([("/data/19931109_191449_starea.cdf",), ("/data/unknown.cdf",)], "path string")
    return files.known_files(names, files.target_files(spark)).select("file", "file_number", "target_m", "wave_height_m")
