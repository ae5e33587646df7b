"""SQL that states the same results as the queries, for DuckDB over the same tables."""

from __future__ import annotations

from ..config import Cfar, Cluster
from .queries import ANISO, BOOST, CFARS, EXTENDED, ISO, LOOSE, WINDOW

# Only parameters are taken from the code that is checked; what they mean is written out here once more.

#: Bins and frames of the hourly grids (720 hours in the tables at hand), samples of a frame, samples between two.
K, M, L, HOP = 17, 91, 32, 8
#: Terms of the flat-top taper.
FLATTOP = (0.21557895, 0.41663158, 0.277263158, 0.083578947, 0.006947368)
#: The acoustic classes.
CLASSES = """(0, 'jet_engine', 500.0, 8000.0, 1000.0, [1000.0, 2000.0, 4000.0, 6000.0]),
(1, 'propeller', 50.0, 500.0, 80.0, [80.0, 160.0, 240.0, 320.0, 400.0]),
(2, 'helicopter', 20.0, 200.0, 25.0, [25.0, 50.0, 75.0, 100.0, 125.0, 150.0]),
(3, 'turboprop', 80.0, 2000.0, 100.0, [100.0, 200.0, 300.0, 400.0, 500.0]),
(4, 'drone', 100.0, 8000.0, 200.0, [200.0, 400.0, 600.0, 800.0, 1000.0])"""


def ctes(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


SIG = """types AS (SELECT DISTINCT event_type FROM events),
raw AS (SELECT event_type, date_diff('day', (SELECT CAST(min(ts) AS DATE) FROM events), CAST(ts AS DATE)) * 24 + hour(ts) AS n, round(sum(value), 2) AS x FROM events GROUP BY 1, 2),
sig AS (SELECT t.event_type AS signal_id, h.n, coalesce(x, 0.0) AS re, 0.0 AS im
  FROM types t CROSS JOIN (SELECT unnest(range((SELECT max(n) + 1 FROM raw))) AS n) h LEFT JOIN raw r ON r.event_type = t.event_type AND r.n = h.n)"""
IQ_SIG = SIG + """,
iq AS (SELECT 'iq' AS signal_id, n, sum(CASE WHEN signal_id = 'purchase' THEN re ELSE 0 END) AS re, sum(CASE WHEN signal_id = 'click' THEN re ELSE 0 END) AS im FROM sig GROUP BY n)"""


def transform(source: str, first: int, bins: int, frames: int = M, spread: float = 128.0, digits: int | None = 4) -> str:
    """Grid cells of a signal at bins first .. first + bins - 1, numbered from 0."""
    return f"""taps AS (SELECT i, exp(-power(i - 15.5, 2) / {spread!r}) AS w FROM (SELECT unnest(range({L})) AS i)),
fr AS (SELECT s.signal_id, m, i, re * w AS a, im * w AS b FROM (SELECT unnest(range({frames})) AS m), taps, {source} s WHERE s.n = m * {HOP} - {L // 2} + i),
tf AS (SELECT signal_id, CAST(k AS INT) AS k, CAST(m AS INT) AS m, sum(a * cos(2 * pi() * (k + {first}) * i / {L}) + b * sin(2 * pi() * (k + {first}) * i / {L})) / (SELECT sum(w) FROM taps) AS re,
  sum(b * cos(2 * pi() * (k + {first}) * i / {L}) - a * sin(2 * pi() * (k + {first}) * i / {L})) / (SELECT sum(w) FROM taps) AS im
  FROM fr, (SELECT unnest(range({bins})) AS k) GROUP BY 1, 2, 3),
g AS (SELECT signal_id, k, m, (k + {first}) / {L}.0 AS freq_hz, m * {HOP}.0 AS time_s, re, im, {'re * re + im * im' if digits is None else f'round(re * re + im * im, {digits}) + 0.0'} AS power FROM tf)"""


GRID = SIG + ",\n" + transform("sig", 0, K)
GRID_IQ = IQ_SIG + ",\n" + transform("iq", -16, L)


def frame(a: int, b: int) -> str:
    side = lambda x: f"{-x} PRECEDING" if x < 0 else f"{x} FOLLOWING" if x > 0 else "CURRENT ROW"
    return f"ROWS BETWEEN {side(a)} AND {side(b)}"


def ring(c: Cfar) -> int:
    """Cells of the window about a cell, the guard cells left out."""
    side, core = 2 * (c.guard + c.train) + 1, 2 * c.guard + 1
    return side * side - core * core


def multiplier(c: Cfar) -> str:
    """n (pfa^(-1/n) - 1), n the cells that are counted; for the order statistic a fixed 2.0, as it is the 75th of 100."""
    n = ring(c) if c.count == "ring" or c.method == "os" else 4 * c.train * c.train
    return f"({'2.0' if c.method == 'os' else float(n)} * (power({c.pfa}, {-1.0 / n!r}) - 1))"


def regions(c: Cfar) -> dict[str, tuple[tuple[int, int], tuple[int, int]]]:
    """Offsets in k and in m, from and to, of the parts of the window whose means are compared."""
    g, t = c.guard, c.guard + c.train
    if c.method in ("goca", "soca"):
        return {"nw": ((-t, -g - 1), (-t, -g - 1)), "ne": ((-t, -g - 1), (g + 1, t)), "sw": ((g + 1, t), (-t, -g - 1)), "se": ((g + 1, t), (g + 1, t))}
    if c.method in ("goca_sides", "soca_bands"):
        aside = (-t, t) if c.method == "goca_sides" else (-g, g)
        return {"n": ((-t, -g - 1), (-t, t)), "s": ((g + 1, t), (-t, t)), "w": (aside, (-t, -g - 1)), "e": (aside, (g + 1, t))}
    return {"full": ((-t, t), (-t, t)), "guard": ((-g, g), (-g, g))}


def detection(c: Cfar, name: str = "det", value: str = "power", bins: int = K, frames: int = M) -> str:
    t = c.guard + c.train
    inside = f"k BETWEEN {t} AND {bins - 1 - t} AND m BETWEEN {t} AND {frames - 1 - t}"
    over = ">" if c.strict else ">="
    if c.method == "os":
        noise = f"""{name}_n AS (SELECT a.signal_id, a.k, a.m, a.power, list_sort(list({value.replace('power', 'b.power')}))[{3 * ring(c) // 4}] AS noise FROM g a JOIN g b ON a.signal_id = b.signal_id
  AND b.k BETWEEN a.k - {t} AND a.k + {t} AND b.m BETWEEN a.m - {t} AND a.m + {t} AND (abs(a.k - b.k) > {c.guard} OR abs(a.m - b.m) > {c.guard}) GROUP BY 1, 2, 3, 4)"""
    else:
        of = regions(c)
        label = lambda span: f"s_{span[0]}_{span[1]}".replace("-", "n")
        rows = ", ".join(f"coalesce(sum(v) OVER (PARTITION BY signal_id, k ORDER BY m {frame(*b)}), 0.0) AS {label(b)}" for b in dict.fromkeys(b for _, b in of.values()))
        sums = ", ".join(f"coalesce(sum({label(b)}) OVER (PARTITION BY signal_id, m ORDER BY k {frame(*a)}), 0.0) AS r_{n}" for n, (a, b) in of.items())
        means = [f"r_{n} / {float((a[1] - a[0] + 1) * (b[1] - b[0] + 1))}" for n, (a, b) in of.items()]
        pick = f"(r_full - r_guard) / {float(ring(c))}" if c.method == "ca" else f"{'greatest' if c.method.startswith('goca') else 'least'}({', '.join(means)})"
        noise = f"""{name}_r AS (SELECT *, {rows} FROM (SELECT *, {value} AS v FROM g)), {name}_c AS (SELECT *, {sums} FROM {name}_r), {name}_n AS (SELECT *, {pick} AS noise FROM {name}_c)"""
    return f"""{noise},
{name} AS (SELECT signal_id, k, m, power, noise, noise * {multiplier(c)} AS threshold FROM {name}_n WHERE {inside} AND {value} {over} noise * {multiplier(c)})"""


DET = GRID + ",\n" + detection(LOOSE)


def clusters(near: str, least: int, count: int = 0) -> str:
    """lab (signal_id, k, m, cluster_id) of det; near: the condition of points a and b. count: least points, no border."""
    own = f", big AS (SELECT signal_id, root FROM root GROUP BY 1, 2 HAVING count(*) >= {count})" if count else ""
    return f"""p AS (SELECT signal_id, k, m, CAST(k AS BIGINT) * 2147483648 + m AS id FROM det),
near AS (SELECT a.signal_id, a.id AS a, b.id AS b FROM p a JOIN p b ON a.signal_id = b.signal_id AND {near}),
core AS (SELECT signal_id, a FROM near GROUP BY 1, 2 HAVING count(*) >= {least}),
link AS (SELECT n.* FROM near n JOIN core x ON n.signal_id = x.signal_id AND n.a = x.a JOIN core y ON n.signal_id = y.signal_id AND n.b = y.a),
reach AS (SELECT signal_id, a, a AS b FROM core UNION SELECT r.signal_id, r.a, l.b FROM reach r JOIN link l ON r.signal_id = l.signal_id AND r.b = l.a),
root AS (SELECT signal_id, a, min(b) AS root FROM reach GROUP BY 1, 2){own},
num AS (SELECT signal_id, a, dense_rank() OVER (PARTITION BY signal_id ORDER BY root) - 1 AS cluster_id FROM root {"JOIN big USING (signal_id, root)" if count else ""}),
border AS (SELECT n.signal_id, n.a, min(cluster_id) AS c FROM near n JOIN num u ON n.signal_id = u.signal_id AND n.b = u.a WHERE {"FALSE" if count else "TRUE"} GROUP BY 1, 2),
lab AS (SELECT p.signal_id, p.k, p.m, CAST(coalesce(u.cluster_id, b.c, -1) AS INT) AS cluster_id FROM p LEFT JOIN num u ON p.signal_id = u.signal_id AND p.id = u.a LEFT JOIN border b ON p.signal_id = b.signal_id AND p.id = b.a)"""


def steps(c: Cluster) -> str:
    """Whether points a and b are within eps, steps weighted by axis."""
    wk, wm = c.weights
    return f"power({wk!r} * (b.k - a.k), 2) + power({wm!r} * (b.m - a.m), 2) <= {c.eps * c.eps + 1e-12!r}"


LAB = DET + ",\n" + clusters(steps(ANISO), ANISO.min_samples)
MEMBER = LAB + ",\nmem AS (SELECT l.signal_id, l.cluster_id, g.k, g.m, g.power, g.freq_hz, g.time_s FROM lab l JOIN g USING (signal_id, k, m) WHERE cluster_id >= 0)"
BAR = ", bar AS (SELECT signal_id, quantile_cont(10 * log10(power + 1e-12), {p}) AS q FROM g GROUP BY 1), z AS (SELECT g.*, 10 * log10(power + 1e-12) < q AS zero FROM g JOIN bar USING (signal_id))"
CROSS = "(VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) s(a, b)"
SQUARE = "(VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 0), (0, 1), (1, -1), (1, 0), (1, 1)) s(a, b)"
INSIDE = f"BETWEEN 0 AND {K - 1} AND m + b BETWEEN 0 AND {M - 1}"


def dilate(cells: str, shape: str = CROSS) -> str:
    return f"(SELECT DISTINCT signal_id, k + a AS k, m + b AS m FROM {cells} x, {shape} WHERE k + a {INSIDE})"


def erode(cells: str) -> str:
    return f"(SELECT signal_id, k + a AS k, m + b AS m FROM {cells} x, {CROSS} GROUP BY 1, 2, 3 HAVING count(*) = 5)"


def ints(select: str) -> str:
    return f"SELECT signal_id, CAST(k AS INT) AS k, CAST(m AS INT) AS m FROM {select} o"


def taper(expr: str) -> str:
    """The hourly grid's power under a window of 64 samples, every 16."""
    return ctes(SIG, f"w AS (SELECT i, {expr} AS w FROM (SELECT unnest(range(64)) AS i))", "ms AS (SELECT unnest(range((SELECT (max(n) + 16) // 16 + 1 FROM sig))) AS m)",
        "fr AS (SELECT signal_id, m, i, re * w AS v FROM ms, w, sig WHERE n = m * 16 - 32 + i)", "z AS (SELECT signal_id, k, m, sum(v * cos(2 * pi() * k * i / 64)) / (SELECT sum(w) FROM w) AS a, sum(v * sin(2 * pi() * k * i / 64)) / (SELECT sum(w) FROM w) AS b FROM fr, (SELECT unnest(range(33)) AS k) GROUP BY 1, 2, 3)",
    ) + "SELECT signal_id, CAST(k AS INT) AS k, CAST(m AS INT) AS m, round(a * a + b * b, 4) + 0.0 AS power FROM z"


def cosine(*a: float) -> str:
    return " + ".join(f"{(-1) ** j * c} * cos(2 * pi() * {j} * i / 63.0)" for j, c in enumerate(a))


def rounded(cols: str, digits: int) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in cols.split())


def bessel(x: str) -> str:
    terms, f = ["1.0"], 1
    for j in range(1, 25):
        f *= j
        terms.append(f"power({x} / 2, {2 * j}) / {float(f) ** 2!r}")
    return "(" + " + ".join(terms) + ")"



SQL: dict[str, str] = {
    "signal_hourly": ctes(SIG) + "SELECT signal_id, n, re + 0.0 AS re, im FROM sig",
    "signal_iq": ctes(IQ_SIG) + f"SELECT signal_id, n, {rounded('re im', 6)} FROM iq",
    "signal_padded": ctes(SIG) + "SELECT t.event_type AS signal_id, h.n, round(coalesce(re, 0.0), 6) + 0.0 AS re, 0.0 AS im FROM types t CROSS JOIN (SELECT unnest(range(1024)) AS n) h LEFT JOIN sig s ON s.signal_id = t.event_type AND s.n = h.n",
    "signal_segments": ctes(SIG) + "SELECT signal_id, CAST(n // 100 AS INT) AS seg_id, n % 100 AS n, round(re, 6) + 0.0 AS re FROM sig WHERE n < 600",
    "signal_frames": ctes(SIG) + "SELECT signal_id, CAST(f AS INT) AS seg_id, n - 24 * f AS n, round(re, 6) + 0.0 AS re FROM sig, (SELECT unnest(range(27)) AS f) WHERE n >= 24 * f AND n < 24 * f + 96",
    "signal_summary": ctes(IQ_SIG) + "SELECT signal_id, count(*) AS n_samples, " + ", ".join(f"round({f}({e}), 5) + 0.0 AS {c}_{n}" for c, e in (("re", "re"), ("im", "im"), ("mag", "sqrt(re * re + im * im)")) for n, f in (("min", "min"), ("max", "max"), ("mean", "avg"), ("std", "stddev_pop")))
    + ", round(min(atan2(im, re)), 5) + 0.0 AS phase_min, round(max(atan2(im, re)), 5) + 0.0 AS phase_max, round(avg(re * re + im * im), 5) + 0.0 AS power_mean, round(max(re * re + im * im), 5) + 0.0 AS power_max, round(10 * log10((max(re * re + im * im) + 1e-12) / (avg(re * re + im * im) + 1e-12)), 5) + 0.0 AS dynamic_range_db FROM iq GROUP BY 1",
    "histogram_1d": ctes(SIG, "sp AS (SELECT signal_id, min(re) AS lo, max(re) AS hi, count(*) AS c, (max(re) - min(re)) / 20 AS w FROM sig GROUP BY 1)", "b AS (SELECT signal_id, least(19, CAST(floor((re - lo) / w) AS INT)) AS bin, count(*) AS n FROM sig JOIN sp USING (signal_id) GROUP BY 1, 2)")
    + "SELECT sp.signal_id AS metric, CAST(i AS INT) AS bin, round(lo + i * w, 6) + 0.0 AS low, round(lo + (i + 1) * w, 6) + 0.0 AS high, coalesce(b.n, 0) AS n, round(coalesce(b.n, 0) / (c * w), 6) + 0.0 AS density FROM sp CROSS JOIN (SELECT unnest(range(20)) AS i) LEFT JOIN b ON b.signal_id = sp.signal_id AND b.bin = i",
    "histogram_2d": "WITH s AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS d FROM lineitem) SELECT least(99, CAST(floor((l_quantity - a) * 100 / (b - a)) AS INT)) AS bx, least(99, CAST(floor((l_extendedprice - c) * 100 / (d - c)) AS INT)) AS by, count(*) AS n FROM lineitem, s GROUP BY 1, 2",
    "running_mean_std": """WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice), 2) AS x FROM orders GROUP BY 1), e AS (SELECT min(day) AS d0, max(day) AS d1 FROM o),
s AS (SELECT n, coalesce(x, 0.0) AS x FROM (SELECT unnest(range(CAST(date_diff('day', d0, d1) AS BIGINT) + 1)) AS n, d0 FROM e) LEFT JOIN o ON date_diff('day', d0, day) = n),
w AS (SELECT a.n, avg(b.x) AS mean, stddev_pop(b.x) AS std, count(*) AS c FROM s a JOIN s b ON b.n BETWEEN a.n AND a.n + 29 GROUP BY 1)
SELECT 'orders' AS signal_id, n, round(mean, 3) + 0.0 AS mean, round(std, 3) + 0.0 AS std FROM w WHERE c = 30""",
    "autocorrelation": ctes(SIG, "x AS (SELECT signal_id, n, (re - avg(re) OVER (PARTITION BY signal_id)) / stddev_pop(re) OVER (PARTITION BY signal_id) AS z FROM sig WHERE n < 2000)", "l AS (SELECT a.signal_id, b.n - a.n AS lag, sum(a.z * b.z) AS s FROM x a JOIN x b ON a.signal_id = b.signal_id AND b.n - a.n BETWEEN 0 AND 499 GROUP BY 1, 2)") + "SELECT signal_id, CAST(lag AS INT) AS lag, round(s / first_value(s) OVER (PARTITION BY signal_id ORDER BY lag), 6) + 0.0 AS acf FROM l",
    "taper_gaussian": taper("exp(-power(i - 31.5, 2) / 128.0)"),
    "taper_hamming": taper(cosine(0.54, 0.46)),
    "taper_hann": taper(cosine(0.5, 0.5)),
    "taper_blackman": taper(cosine(0.42, 0.5, 0.08)),
    "taper_flattop": taper(cosine(*FLATTOP)),
    "taper_bartlett": taper("1 - abs(2 * i / 63.0 - 1)"),
    "taper_tukey": taper("CASE WHEN least(i, 63 - i) <= 15 THEN 0.5 * (1 + cos(pi() * (2 * least(i, 63 - i) / 31.5 - 1))) ELSE 1.0 END"),
    "taper_kaiser": taper(f"{bessel('(8.6 * sqrt(greatest(0.0, 1 - power(2 * i / 63.0 - 1, 2))))')} / {bessel('8.6')}"),
    "stft_onesided": ctes(GRID) + f"SELECT signal_id, k, m, {rounded('freq_hz time_s', 6)}, {rounded('re im', 4)}, power FROM g",
    "stft_twosided": ctes(GRID_IQ) + f"SELECT signal_id, k, m, {rounded('freq_hz', 6)}, {rounded('re im power', 4)} FROM g",
    "spectrogram_db": ctes(GRID) + "SELECT signal_id, k, m, round(10 * log10(power + 1e-12), 6) + 0.0 AS power_db, round(20 * log10(sqrt(power) + 1e-10), 6) + 0.0 AS magnitude_db, round(10 * log10(power / (max(power) OVER (PARTITION BY signal_id) + 1e-10) + 1e-10), 6) + 0.0 AS relative_db, round(ln(power + 1e-12), 6) + 0.0 AS log_power FROM g",
    "doppler_spectrum": ctes(IQ_SIG, "x AS (SELECT k, sum(re * cos(2 * pi() * (k - 64) * n / 128) + im * sin(2 * pi() * (k - 64) * n / 128)) AS a, sum(im * cos(2 * pi() * (k - 64) * n / 128) - re * sin(2 * pi() * (k - 64) * n / 128)) AS b FROM iq, (SELECT unnest(range(128)) AS k) WHERE n < 128 GROUP BY k)")
    + "SELECT 'iq' AS signal_id, CAST(k AS INT) AS k, round((k - 64) / 128.0, 6) + 0.0 AS freq_hz, round(sqrt(a * a + b * b), 4) + 0.0 AS magnitude, round((k - 64) / 128.0 * 3e8 / (2 * 9.39e9), 6) + 0.0 AS velocity FROM x",
    "level_marginals": ctes(GRID) + "SELECT signal_id, k, m, round(avg(10 * log10(power + 1e-12)), 6) + 0.0 AS mean_db FROM g GROUP BY GROUPING SETS ((signal_id, k), (signal_id, m))",
    "k_params": ctes(GRID, "a AS (SELECT signal_id, count(*) AS c, quantile_cont(power, 0.95) AS q FROM g WHERE power > 1e-12 GROUP BY 1 HAVING count(*) >= 1000)", "b AS (SELECT signal_id, count(*) AS n, avg(power) AS mean, var_pop(power) / (avg(power) * avg(power)) AS ratio FROM g JOIN a USING (signal_id) WHERE power > 1e-10 AND power <= q GROUP BY 1)")
    + f"SELECT signal_id, n, {rounded('mean', 4)}, {rounded('ratio', 6)}, round(greatest(0.5, least(100.0, 1 / (2 * ratio - 1))), 6) + 0.0 AS shape FROM b",
    "zero_map": ctes(GRID + BAR.format(p=0.05)) + "SELECT signal_id, k, m, zero FROM z",
    "dilate4": ctes(DET) + ints(dilate("det")),
    "dilate_rect": ctes(DET) + ints(dilate("det", "(VALUES (-2, 0), (-1, 0), (0, 0), (1, 0), (2, 0)) s(a, b)")),
    "closing_opening": ctes(DET) + ints(dilate(erode(erode(dilate("det"))))),
    "geodesic_10": ctes(GRID + BAR.format(p=0.4), detection(WINDOW, "seed"), f"w AS (SELECT signal_id, k, m, 0 AS d FROM seed UNION SELECT w.signal_id, w.k + a, w.m + b, d + 1 FROM w, {CROSS}, z WHERE d < 10 AND z.signal_id = w.signal_id AND z.k = w.k + a AND z.m = w.m + b AND NOT zero)") + ints("(SELECT DISTINCT signal_id, k, m FROM w WHERE d > 0)"),
    "geodesic_full": ctes(GRID + BAR.format(p=0.4), detection(WINDOW, "seed"), f"w AS (SELECT signal_id, k, m FROM seed UNION SELECT w.signal_id, w.k + a, w.m + b FROM w, {SQUARE}, z WHERE z.signal_id = w.signal_id AND z.k = w.k + a AND z.m = w.m + b AND NOT zero)") + ints("w"),
    "dbscan_aniso": ctes(LAB) + "SELECT * FROM lab",
    "dbscan_iso": ctes(DET, clusters(steps(ISO), ISO.min_samples)) + "SELECT * FROM lab",
    "hdbscan_like": ctes(DET, clusters("sqrt(power((a.k - b.k) * 4.0, 2) + power((a.m - b.m) * 10.0, 2)) <= 20.0", 3, 3)) + "SELECT * FROM lab",
    "components_topk": ctes(MEMBER, "c AS (SELECT signal_id, cluster_id, count(*) AS n_points, sum(power) AS energy, avg(time_s) AS centroid_time, avg(freq_hz) AS centroid_freq FROM mem GROUP BY 1, 2)", "o AS (SELECT *, CAST(row_number() OVER (PARTITION BY signal_id ORDER BY energy DESC, cluster_id) AS INT) AS rank FROM c)") + f"SELECT signal_id, cluster_id, n_points, {rounded('energy centroid_time centroid_freq', 4)}, rank FROM o WHERE rank <= 3",
    "components_grown": ctes(MEMBER + BAR.format(p=0.4), "c AS (SELECT signal_id, cluster_id, row_number() OVER (PARTITION BY signal_id ORDER BY sum(power) DESC, cluster_id) AS rank FROM mem GROUP BY 1, 2)",
        f"w AS (SELECT signal_id, cluster_id, k, m, 0 AS d FROM mem JOIN c USING (signal_id, cluster_id) WHERE rank <= 2 UNION SELECT w.signal_id, cluster_id, w.k + a, w.m + b, d + 1 FROM w, {CROSS}, z WHERE d < 3 AND z.signal_id = w.signal_id AND z.k = w.k + a AND z.m = w.m + b AND NOT zero)",
        "u AS (SELECT DISTINCT signal_id, cluster_id, k, m FROM w WHERE d > 0)") + f"SELECT signal_id, cluster_id, count(*) AS n_cells, round(sum(power), 4) + 0.0 AS energy, round(avg(DISTINCT freq_hz), 4) + 0.0 AS centroid_freq, round(avg(DISTINCT time_s), 4) + 0.0 AS centroid_time FROM u JOIN g USING (signal_id, k, m) GROUP BY 1, 2",
    "doppler_info": ctes(MEMBER, "c AS (SELECT signal_id, cluster_id, avg(freq_hz) AS doppler_freq_hz, max(freq_hz) - min(freq_hz) AS doppler_bandwidth_hz, stddev_pop(freq_hz) AS doppler_std_hz, avg(time_s) AS centroid_time_s, sum(power) AS energy, avg(freq_hz) * 3e8 / (2 * 9.39e9) AS velocity_estimate_mps FROM mem GROUP BY 1, 2)") + f"SELECT signal_id, cluster_id, {rounded('doppler_freq_hz doppler_bandwidth_hz doppler_std_hz centroid_time_s energy velocity_estimate_mps', 4)} FROM c",
}
INFO = "c AS (SELECT signal_id, cluster_id, count(*) AS n_points, sum(power) AS energy, avg(freq_hz) AS freq_mean, stddev_pop(freq_hz) AS freq_std, avg(time_s) AS time_mean, stddev_pop(time_s) AS time_std, min(time_s) - 0.02 AS t_low, max(time_s) + 0.02 AS t_high, min(freq_hz) - 10.0 AS f_low, max(freq_hz) + 10.0 AS f_high, avg(freq_hz) * 299792458.0 / (2 * 9.39e9) AS velocity FROM mem GROUP BY 1, 2)"
SQL["cluster_info"] = ctes(MEMBER, INFO) + f"SELECT signal_id, cluster_id, n_points, {rounded('energy freq_mean freq_std time_mean time_std t_low t_high f_low f_high velocity', 4)}, velocity > 0 AS approaching FROM c"
SQL["detection_overview"] = ctes(MEMBER, INFO) + f"SELECT signal_id, cluster_id, {rounded('time_mean freq_mean velocity energy', 4)}, n_points, CASE WHEN velocity > 0 THEN 'approaching' ELSE 'receding' END AS direction FROM c"
SQL["stft_relational"] = SQL["stft_onesided"]
for _name, _c in CFARS.items():
    _value = "sqrt(power)" if _c.value == "magnitude" else "power"
    SQL[_name] = ctes(GRID, detection(_c, value=_value)) + f"SELECT signal_id, k, m, power, {rounded('noise', 8)}, {rounded('threshold', 5)} FROM det"

INVERSE = f"""h AS (SELECT g.signal_id, g.m, t.i, t.w, (CASE WHEN g.k IN (0, 16) THEN 1.0 ELSE 2.0 END) * (g.re * cos(2 * pi() * g.k * t.i / {L}) - g.im * sin(2 * pi() * g.k * t.i / {L})) / {L} AS x FROM g JOIN det d ON g.signal_id = d.signal_id AND g.k = d.k AND g.m = d.m, taps t),
y AS (SELECT signal_id, m * {HOP} - 16 + i AS n, sum(x * w) * (SELECT sum(w) FROM taps) AS x FROM h GROUP BY 1, 2),
nw AS (SELECT m * {HOP} - 16 + i AS n, sum(w * w) AS q FROM taps, (SELECT unnest(range({M})) AS m) GROUP BY 1),
back AS (SELECT s.signal_id, s.n, s.re AS was, coalesce(y.x, 0.0) / (CASE WHEN q > 1e-10 THEN q ELSE 1.0 END) AS re FROM sig s JOIN nw USING (n) LEFT JOIN y ON y.signal_id = s.signal_id AND y.n = s.n)"""
SQL |= {
    "rebuilt_signal": ctes(DET, INVERSE) + "SELECT signal_id, n, round(re, 4) + 0.0 AS re, 0.0 AS im FROM back",
    "round_trip": ctes(SIG) + "SELECT signal_id, n, round(re, 4) + 0.0 AS re, 0.0 AS im FROM sig",
    "quality_of_rebuilt": ctes(DET, INVERSE) + "SELECT signal_id, round(CASE WHEN sum(power(was - re, 2)) < 1e-15 THEN 100.0 ELSE 10 * log10(sum(was * was) / sum(power(was - re, 2))) END, 4) + 0.0 AS rqf FROM back GROUP BY 1",
}


def hurst(source: str, keys: str, lag: int) -> str:
    """h (keys, hurst) of a series (keys, i, x)."""
    return f"""hn AS (SELECT {keys}, count(*) AS cnt FROM {source} GROUP BY ALL),
hx AS (SELECT s.*, lag, i // lag AS chunk FROM {source} s JOIN hn USING ({keys}), (SELECT unnest(range(2, {lag})) AS lag) WHERE cnt >= {2 * lag} AND lag < least({lag}, cnt // 4) AND i // lag < cnt // lag),
hd AS (SELECT *, x - avg(x) OVER (PARTITION BY {keys}, lag, chunk) AS dv FROM hx),
hy AS (SELECT *, sum(dv) OVER (PARTITION BY {keys}, lag, chunk ORDER BY i ROWS UNBOUNDED PRECEDING) AS y FROM hd),
hc AS (SELECT {keys}, lag, (max(y) - min(y)) / stddev_pop(x) AS rs FROM hy GROUP BY {keys}, lag, chunk HAVING stddev_pop(x) > 1e-10),
hl AS (SELECT {keys}, avg(rs) AS rs, row_number() OVER (PARTITION BY {keys} ORDER BY lag) + 1 AS pos FROM hc GROUP BY {keys}, lag),
hs AS (SELECT {keys}, count(*) AS c, regr_slope(ln(rs), ln(pos)) AS s FROM hl GROUP BY ALL),
h AS (SELECT {keys}, CASE WHEN c >= 3 THEN greatest(0.0, least(1.0, s)) ELSE 0.5 END AS hurst FROM hn LEFT JOIN hs USING ({keys}))"""


USERS = "usr AS (SELECT CAST(user_id AS VARCHAR) AS signal_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, value AS x FROM events)"
WINDOWS = f"win AS (SELECT signal_id, n // {BOOST.window} AS win, n % {BOOST.window} AS i, abs(re) AS x FROM sig WHERE n < {720 // BOOST.window * BOOST.window})"
TIMED = ctes(GRID, WINDOWS, hurst("win", "signal_id, win", BOOST.window // 4), f"bad AS (SELECT signal_id, win FROM (SELECT *, median(hurst) OVER (PARTITION BY signal_id) AS base FROM h) WHERE abs(hurst - base) > {BOOST.threshold})", f"boost AS (SELECT signal_id, k, m FROM g JOIN bad USING (signal_id) WHERE time_s >= win * {BOOST.window}.0 AND time_s < (win + 1) * {BOOST.window}.0)", detection(WINDOW), "loud AS (SELECT signal_id, quantile_cont(power, 0.85) AS q FROM g GROUP BY 1)", "fin AS (SELECT signal_id, k, m FROM det UNION SELECT signal_id, k, m FROM boost JOIN g USING (signal_id, k, m) JOIN loud USING (signal_id) WHERE power > q)")
_tw, _ts, _half = BOOST.frames, BOOST.step, BOOST.band // 2
SQL |= {
    "hurst_user": ctes(USERS, hurst("usr", "signal_id", 10)) + "SELECT signal_id, round(hurst, 6) + 0.0 AS hurst FROM h",
    "higuchi_user": ctes(USERS, "n AS (SELECT signal_id, count(*) AS cnt FROM usr GROUP BY 1)", "d AS (SELECT signal_id, cnt, k, i % k AS m, abs(x - lag(x) OVER (PARTITION BY signal_id, k, i % k ORDER BY i)) AS d FROM usr JOIN n USING (signal_id), (SELECT unnest(range(1, 9)) AS k) WHERE cnt >= 16)", "l AS (SELECT signal_id, k, sum(d) * (cnt - 1) / (k * count(*) * k) AS l FROM d GROUP BY signal_id, k, m, cnt HAVING count(*) >= 2)", "b AS (SELECT signal_id, k, sum(l) / k AS lk FROM l GROUP BY 1, 2 HAVING sum(l) > 0)", "a AS (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY k) AS pos FROM b)", "s AS (SELECT signal_id, count(*) AS c, -regr_slope(ln(lk), ln(pos)) AS s FROM a GROUP BY 1)") + "SELECT signal_id, round(CASE WHEN c >= 3 THEN greatest(1.0, least(2.0, s)) ELSE 1.5 END, 6) + 0.0 AS dimension FROM n LEFT JOIN s USING (signal_id)",
    "fractal_boost_time": TIMED + "SELECT signal_id, k, m FROM boost",
    "boosted_cells": TIMED + "SELECT signal_id, k, m FROM fin",
    "boost_stats": TIMED + "SELECT *, n_combined - n_cfar AS n_added, round(100.0 * (n_combined - n_cfar) / greatest(1, n_cfar), 6) + 0.0 AS boost_percent FROM (SELECT signal_id, count(*) FILTER (w = 1) AS n_cfar, count(*) FILTER (w = 2) AS n_fractal, count(*) FILTER (w = 3) AS n_combined FROM (SELECT signal_id, 1 AS w FROM det UNION ALL SELECT signal_id, 2 FROM boost UNION ALL SELECT signal_id, 3 FROM fin) GROUP BY 1)",
    "fractal_boost_tf": ctes(GRID, f"ser AS (SELECT signal_id, band, m, avg(ln(power + 1e-12)) AS x FROM g, (SELECT unnest(range(0, {K}, {BOOST.stride})) AS band) WHERE abs(k - band) <= {_half} GROUP BY 1, 2, 3)", f"win AS (SELECT signal_id, band, t0, m - t0 AS i, x FROM ser, (SELECT unnest(range(0, {M - _tw + 1}, {_ts})) AS t0) WHERE m >= t0 AND m < t0 + {_tw})", hurst("win", "signal_id, band, t0", max(8, _tw // 4)), f"bad AS (SELECT signal_id, band, t0 FROM (SELECT *, median(hurst) OVER (PARTITION BY signal_id, band) AS base FROM h) WHERE abs(hurst - base) > {BOOST.threshold})") + f"SELECT DISTINCT signal_id, k, m FROM g JOIN bad USING (signal_id) WHERE abs(k - band) <= {_half} AND m >= t0 AND m < t0 + {_tw}",
    "local_maxima": ctes(GRID, "a AS (SELECT *, max(power) OVER (PARTITION BY signal_id, k ORDER BY m ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS r FROM g)", "b AS (SELECT *, max(r) OVER (PARTITION BY signal_id, m ORDER BY k ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS q FROM a)") + "SELECT signal_id, k, m, power FROM b WHERE power = q",
    "classify_signature": "WITH t AS (SELECT p_partkey AS id, p_partkey % 1000 * 3.0 + 20 AS f FROM part), s(ord, name, lo, hi, fund, harm) AS (VALUES " + CLASSES + "), x AS (SELECT id, ord, name, greatest(0.0, 1 - abs(f - fund) / fund) + 0.2 * len(list_filter(harm, lambda q: abs(f - q) < 0.1 * q)) AS score FROM t JOIN s ON f BETWEEN lo AND hi), y AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, ord) AS r FROM x WHERE score > 0) SELECT t.id, coalesce(name, 'unknown') AS aircraft_type, round(least(1.0, coalesce(score, 0.0)), 6) + 0.0 AS confidence FROM t LEFT JOIN y ON t.id = y.id AND r = 1",
    "distance_model": "WITH t AS (SELECT p_partkey AS id, 80 - 10 * log10(power(10.0, p_size / 5.0) + 1e-10) AS lost FROM part) SELECT id, round(CASE WHEN lost <= 0 THEN 50.0 ELSE greatest(10.0, least(20000.0, 100 * power(10.0, lost / 20))) END, 4) + 0.0 AS distance_m FROM t",
    "segment_stats": ctes(SIG, "x AS (SELECT signal_id, n // 24 AS seg, n % 24 AS c, re, re > 1.5 * avg(re) OVER (PARTITION BY signal_id) AS loud FROM sig)", "o AS (SELECT *, row_number() OVER (PARTITION BY signal_id, seg ORDER BY re DESC, c) AS r FROM x WHERE loud)", "s AS (SELECT signal_id, seg, count(*) FILTER (loud) AS nc, coalesce(sum(re) FILTER (loud), 0.0) AS e FROM x GROUP BY 1, 2)", "j AS (SELECT s.*, o.c - 12.0 AS f FROM s LEFT JOIN o ON s.signal_id = o.signal_id AND s.seg = o.seg AND r = 1)") + "SELECT signal_id, count(*) AS n_segments, round(avg(nc), 6) + 0.0 AS mean_components, round(stddev_pop(nc), 6) + 0.0 AS std_components, round(sum(e), 6) + 0.0 AS total_energy, count(*) FILTER (nc > 0) AS detection_segments, count(f) AS n_detections_with_doppler, round(avg(f), 6) + 0.0 AS mean_doppler_freq_hz, round(avg(f * 3e8 / (2 * 9.39e9)), 6) + 0.0 AS mean_velocity_mps, round(100.0 * count(*) FILTER (nc > 0) / count(*), 6) + 0.0 AS detection_percent FROM j GROUP BY 1",
    "snr_rollup": "SELECT CAST(user_id % 6 * 5 + 5 AS INT) AS snr_db, round(avg(CASE WHEN event_id % 7 > 0 THEN value ELSE -10.0 END), 5) + 0.0 AS rqf_mean, round(stddev_pop(CASE WHEN event_id % 7 > 0 THEN value ELSE -10.0 END), 5) + 0.0 AS rqf_std, round(avg(CASE WHEN event_id % 7 > 0 THEN 1.0 ELSE 0.0 END), 5) + 0.0 AS detection_rate, count(*) AS n_simulations FROM events GROUP BY 1",
    "ecdf": "SELECT event_type AS metric, round(value, 9) + 0.0 AS value, round(row_number() OVER (PARTITION BY event_type ORDER BY value) / count(*) OVER (PARTITION BY event_type), 9) + 0.0 AS cum_prob FROM events",
    "ecdf_summary": "SELECT event_type AS metric, round(min(value), 6) + 0.0 AS min, round(max(value), 6) + 0.0 AS max, round(median(value), 6) + 0.0 AS median, round(quantile_cont(value, 0.25), 6) + 0.0 AS q25, round(quantile_cont(value, 0.75), 6) + 0.0 AS q75, round(avg(value), 6) + 0.0 AS mean, round(stddev_pop(value), 6) + 0.0 AS std FROM events GROUP BY 1",
    "quantile_markers": "WITH x AS (SELECT event_type AS metric, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS c FROM events) SELECT metric, round(value, 6) + 0.0 AS marker FROM x WHERE i = floor(0.9 * c)",
    "accumulated_history": ctes(DET) + "SELECT signal_id, k, count(*) AS hits FROM det GROUP BY 1, 2",
    "frame_summary": ctes(DET, "f AS (SELECT signal_id, m, count(*) AS p, count(DISTINCT k) AS c FROM det GROUP BY 1, 2)") + "SELECT signal_id, count(*) AS n_frames, CAST(sum(p) AS BIGINT) AS total_pixels, round(avg(p), 6) + 0.0 AS mean_pixels, max(p) AS max_pixels, CAST(sum(c) AS BIGINT) AS total_clusters, round(avg(c), 6) + 0.0 AS mean_clusters, round(100.0 * avg(CASE WHEN c > 0 THEN 1 ELSE 0 END), 6) + 0.0 AS active_percent FROM f GROUP BY 1",
    "mask_coverage": ctes(DET) + "SELECT signal_id, round(100.0 * count(d.k) / count(*), 6) + 0.0 AS percent FROM g LEFT JOIN det d USING (signal_id, k, m) GROUP BY 1",
    "mask_union": ctes(DET, detection(WINDOW, "other")) + "SELECT signal_id, k, m FROM det UNION SELECT signal_id, k, m FROM other",
    "mask_intersect": ctes(DET, detection(WINDOW, "other")) + "SELECT signal_id, k, m FROM det INTERSECT SELECT signal_id, k, m FROM other",
    "mask_except": ctes(DET, detection(WINDOW, "other")) + "SELECT signal_id, k, m FROM det EXCEPT SELECT signal_id, k, m FROM other",
    "nearest_bin": "WITH r AS (SELECT p_brand AS f, p_size AS b, min(p_retailprice) AS m FROM part GROUP BY 1, 2), t AS (SELECT p_brand AS f, round(avg(p_retailprice), 2) AS t FROM part GROUP BY 1), x AS (SELECT f, b, count(*) OVER (PARTITION BY f) AS c, row_number() OVER (PARTITION BY f ORDER BY abs(m - t), b) AS o FROM r JOIN t USING (f)) SELECT f AS file_id, CAST(b AS INT) AS range_bin, CAST(CASE WHEN b > c / 2 THEN 0 ELSE c - 1 END AS INT) AS clutter_bin FROM x WHERE o = 1",
    "interval_join": ctes(SIG, "t AS (SELECT signal_id, n // 24 * 24 AS t0, row_number() OVER (PARTITION BY signal_id ORDER BY re DESC, n) AS o FROM sig)") + "SELECT s.signal_id, s.n, round(re, 6) + 0.0 AS re FROM sig s JOIN t ON s.signal_id = t.signal_id AND o = 1 AND n >= t0 AND n < t0 + 24",
    "stream_tumbling": "SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(date_trunc('hour', ts) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS \"end\", count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "stream_sliding": "WITH x AS (SELECT event_type, value, time_bucket(INTERVAL 30 MINUTE, ts) - i * INTERVAL 30 MINUTE AS s FROM events, (SELECT unnest(range(4)) AS i)) SELECT event_type, strftime(s, '%Y-%m-%d %H:%M:%S') AS start, strftime(s + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS \"end\", count(*) AS n, round(sum(value), 2) AS total FROM x GROUP BY event_type, s",
    "stream_session": "WITH x AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS \"end\", count(*) AS n, round(sum(value), 2) AS total FROM y GROUP BY user_id, s",
    "target_files": "SELECT * FROM (VALUES ('19931109_191449_starea.cdf', 30, 2660.0, 0.9)) t(file, file_number, target_m, wave_height_m)",
}
_peaks = ctes(GRID, "a AS (SELECT *, max(power) OVER (PARTITION BY signal_id, k ORDER BY m ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS r FROM g)", "b AS (SELECT *, max(r) OVER (PARTITION BY signal_id, m ORDER BY k ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS q FROM a)", "t AS (SELECT signal_id, quantile_cont(power, 0.9) AS bar FROM g GROUP BY 1)")
SQL["peaks"] = _peaks + "SELECT signal_id, k, m, power FROM b JOIN t USING (signal_id) WHERE power = q AND power > bar"

SQL |= {
    "signal_sampled": ctes(SIG, "f AS (SELECT signal_id, i, CAST(floor(i * (count(*) - 100) / 6.0) AS BIGINT) AS a FROM sig, (SELECT unnest(range(7)) AS i) GROUP BY 1, 2)") + "SELECT s.signal_id, CAST(i AS INT) AS seg_id, n - a AS n, round(re, 6) + 0.0 AS re FROM sig s JOIN f ON f.signal_id = s.signal_id AND n >= a AND n < a + 100",
    "first_samples": ctes(IQ_SIG) + "SELECT signal_id, n, round(re, 6) + 0.0 AS i, round(im, 6) + 0.0 AS q, round(sqrt(re * re + im * im), 6) + 0.0 AS magnitude, round(atan2(im, re), 6) + 0.0 AS phase FROM iq WHERE n < 50",
    "spectrogram_gaussian": ctes(IQ_SIG + ",\n" + transform("iq", -16, L, spread=2 * (32 / 6) ** 2)) + "SELECT signal_id, k, m, round(freq_hz, 6) + 0.0 AS freq_hz, round(10 * log10(power + 1e-12), 4) + 0.0 AS db FROM g",
    "region_db": ctes(GRID) + "SELECT signal_id, k, m, round(10 * log10(power / (max(power) OVER (PARTITION BY signal_id) + 1e-10) + 1e-10), 6) + 0.0 AS db FROM g WHERE time_s BETWEEN 96 AND 480 AND freq_hz BETWEEN 0.0625 AND 0.375",
    "velocity_table": ctes(GRID_IQ, "v AS (SELECT signal_id, m, sum(freq_hz * power) / sum(power) AS f FROM g GROUP BY 1, 2)") + "SELECT signal_id, m, round(f, 9) + 0.0 AS doppler_hz, round(f * 3e8 / (2 * 9.39e9), 9) + 0.0 AS velocity_mps, round(3e8 / (4 * 9.39e9), 9) AS v_max_mps FROM v",
    "stream_stft": ctes(GRID) + "SELECT signal_id, k, m, power FROM g",
    "stream_hurst": ctes(SIG, "win AS (SELECT signal_id, m, n - 16 * m AS i, abs(re) AS x FROM sig, (SELECT unnest(range((SELECT (max(n) + 1 - 64) // 16 + 1 FROM sig))) AS m) WHERE n >= 16 * m AND n < 16 * m + 64)", hurst("win", "signal_id, m", 16)) + "SELECT signal_id, m, round(hurst, 6) + 0.0 AS hurst FROM h",
}
STRONG = "top AS (SELECT signal_id, cluster_id, row_number() OVER (PARTITION BY signal_id ORDER BY sum(power) DESC, cluster_id) AS rank FROM mem GROUP BY 1, 2), own AS (SELECT signal_id, cluster_id, k, m FROM mem JOIN top USING (signal_id, cluster_id) WHERE rank <= 2)"
AROUND = f"w AS (SELECT *, 0 AS d FROM own UNION SELECT signal_id, cluster_id, k + a, m + b, d + 1 FROM w, {CROSS} WHERE d < 5 AND k + a {INSIDE})"
SQL["local_masks"] = ctes(MEMBER, STRONG, AROUND, "close AS (SELECT *, 10 * log10(power / (max(power) OVER (PARTITION BY signal_id, cluster_id) + 1e-12) + 1e-12) > -20 AS loud FROM (SELECT DISTINCT signal_id, cluster_id, k, m FROM w) JOIN g USING (signal_id, k, m))", "few AS (SELECT signal_id, cluster_id, count(*) FILTER (loud) < (SELECT count(*) FROM own o WHERE o.signal_id = n.signal_id AND o.cluster_id = n.cluster_id) AS few FROM close n GROUP BY 1, 2)") + "SELECT signal_id, cluster_id, CAST(k AS INT) AS k, CAST(m AS INT) AS m FROM close JOIN few USING (signal_id, cluster_id) WHERE loud OR few"
_wide = lambda x: f"(SELECT DISTINCT signal_id, cluster_id, k + a AS k, m + b AS m FROM {x} x, {CROSS} WHERE k + a {INSIDE})"
_thin = lambda x: f"(SELECT signal_id, cluster_id, k + a AS k, m + b AS m FROM {x} x, {CROSS} GROUP BY 1, 2, 3, 4 HAVING count(*) = 5)"
SQL["smoothed_masks"] = ctes(MEMBER, STRONG) + f"SELECT signal_id, cluster_id, CAST(k AS INT) AS k, CAST(m AS INT) AS m FROM {_wide(_thin(_thin(_wide('own'))))} o"
SQL["acoustic_analysis"] = ctes(MEMBER, "t AS (SELECT signal_id, cluster_id, count(*) AS n_points, avg(freq_hz * 2000) AS f, avg(time_s) AS centroid_time, 80 - 10 * log10(sum(power) / 1e4 + 1e-10) AS lost FROM mem GROUP BY 1, 2)", "s(ord, name, lo, hi, fund, harm) AS (VALUES " + CLASSES + ")", "x AS (SELECT signal_id, cluster_id, ord, name, greatest(0.0, 1 - abs(f - fund) / fund) + 0.2 * len(list_filter(harm, lambda q: abs(f - q) < 0.1 * q)) AS score FROM t JOIN s ON f BETWEEN lo AND hi)", "y AS (SELECT *, row_number() OVER (PARTITION BY signal_id, cluster_id ORDER BY score DESC, ord) AS r FROM x WHERE score > 0)") + "SELECT t.signal_id, t.cluster_id, n_points, round(f, 4) + 0.0 AS centroid_freq, round(centroid_time, 4) + 0.0 AS centroid_time, coalesce(name, 'unknown') AS aircraft_type, round(least(1.0, coalesce(score, 0.0)), 4) + 0.0 AS confidence, round(CASE WHEN lost <= 0 THEN 50.0 ELSE greatest(10.0, least(20000.0, 100 * power(10.0, lost / 20))) END, 4) + 0.0 AS distance_m FROM t LEFT JOIN y ON t.signal_id = y.signal_id AND t.cluster_id = y.cluster_id AND r = 1"
SQL["extended_pipeline"] = ctes(GRID, detection(EXTENDED, value="sqrt(power)"), clusters("sqrt(power((a.k - b.k) * 4.0, 2) + power((a.m - b.m) * 10.0, 2)) <= 20.0", 3, 3)) + "SELECT signal_id, cluster_id, count(*) AS n_points, round(sum(power), 4) + 0.0 AS energy, round(avg(time_s), 4) + 0.0 AS centroid_time, round(avg(freq_hz), 4) + 0.0 AS centroid_freq FROM lab JOIN g USING (signal_id, k, m) WHERE cluster_id >= 0 GROUP BY 1, 2"
HIGUCHI = "d AS (SELECT signal_id, cnt, k, i % k AS m, abs(x - lag(x) OVER (PARTITION BY signal_id, k, i % k ORDER BY i)) AS d FROM usr JOIN n USING (signal_id), (SELECT unnest(range(1, 11)) AS k) WHERE cnt >= 20), l AS (SELECT signal_id, k, sum(d) * (cnt - 1) / (k * count(*) * k) AS l FROM d GROUP BY signal_id, k, m, cnt HAVING count(*) >= 2), b AS (SELECT signal_id, k, sum(l) / k AS lk FROM l GROUP BY 1, 2 HAVING sum(l) > 0), a AS (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY k) AS pos FROM b), s AS (SELECT signal_id, count(*) AS c, -regr_slope(ln(lk), ln(pos)) AS s FROM a GROUP BY 1)"
SQL["sql_functions"] = ctes("usr AS (SELECT vec_id AS signal_id, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)", hurst("usr", "signal_id", 20), "n AS (SELECT signal_id, count(*) AS cnt FROM usr GROUP BY 1)", HIGUCHI) + "SELECT signal_id AS vec_id, round(hurst, 4) + 0.0 AS hurst, round(CASE WHEN c >= 3 THEN greatest(1.0, least(2.0, s)) ELSE 1.5 END, 4) + 0.0 AS higuchi, round(signal_id * 3e8 / (2 * 9.39e9), 6) AS velocity, round(10 * log10(signal_id + 1e-12), 6) AS db FROM h JOIN n USING (signal_id) LEFT JOIN s USING (signal_id)"


def density(hop: int, taper_: str) -> str:
    """dens (signal_id, k, m, d): frames of 64 magnitudes without padding, each less its mean, one-sided density."""
    return f"""tap AS (SELECT i, {taper_} AS w FROM (SELECT unnest(range(64)) AS i)),
fr AS (SELECT signal_id, m, n - {hop} * m AS i, abs(re) AS x FROM sig, (SELECT unnest(range((SELECT (max(n) + 1 - 64) // {hop} + 1 FROM sig))) AS m) WHERE n >= {hop} * m AND n < {hop} * m + 64),
mid AS (SELECT signal_id, m, fr.i, (x - avg(x) OVER (PARTITION BY signal_id, m)) * w AS v FROM fr JOIN tap ON tap.i = fr.i),
dens AS (SELECT signal_id, k, m, (power(sum(v * cos(2 * pi() * k * i / 64)), 2) + power(sum(v * sin(2 * pi() * k * i / 64)), 2)) / (SELECT sum(w * w) FROM tap) * (CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END) AS d FROM mid, (SELECT unnest(range(33)) AS k) GROUP BY 1, 2, 3)"""


SQL["welch_psd"] = ctes(SIG, density(32, "0.5 - 0.5 * cos(2 * pi() * i / 64.0)")) + "SELECT signal_id, CAST(k AS INT) AS k, round(k / 64.0, 4) + 0.0 AS freq_hz, round(avg(d), 4) + 0.0 AS density FROM dens GROUP BY dens.signal_id, dens.k"
SQL["spectrogram_density"] = ctes(SIG, density(16, "CASE WHEN least(i, 64 - i) < 8 THEN 0.5 * (1 - cos(pi() * least(i, 64 - i) / 8.0)) ELSE 1.0 END")) + "SELECT signal_id, CAST(k AS INT) AS k, CAST(m AS INT) AS m, round(k / 64.0, 4) + 0.0 AS freq_hz, round(d, 4) + 0.0 AS density FROM dens"


def cut_up(source: str, length: int, step: int) -> str:
    """seg (signal_id, n, re, im): segments of a signal as signals of their own, named by signal and number."""
    return f"seg AS (SELECT signal_id || ':' || f AS signal_id, n - {step} * f AS n, re, im FROM {source}, (SELECT unnest(range((SELECT (max(n) + 1 - {length}) // {step} + 1 FROM {source}))) AS f) WHERE n >= {step} * f AND n < {step} * f + {length})"


_own = "split_part(signal_id, ':', 1)"
SQL["sea_statistics"] = ctes(IQ_SIG, cut_up("iq", 240, 240), transform("seg", -16, L, 31, digits=None), detection(LOOSE, bins=L, frames=31), clusters(steps(ANISO), ANISO.min_samples),
    "c AS (SELECT signal_id, cluster_id, sum(power) AS energy, avg(freq_hz) AS f FROM lab JOIN g USING (signal_id, k, m) WHERE cluster_id >= 0 GROUP BY 1, 2)",
    "o AS (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY energy DESC, cluster_id) AS r FROM c)",
    "j AS (SELECT s.signal_id, count(o.cluster_id) AS nc, coalesce(sum(energy), 0.0) AS e, max(f) FILTER (r = 1) AS f FROM (SELECT DISTINCT signal_id FROM seg) s LEFT JOIN o ON o.signal_id = s.signal_id GROUP BY 1)",
) + f"SELECT {_own} AS signal_id, count(*) AS n_segments, round(avg(nc), 3) + 0.0 AS mean_components, round(stddev_pop(nc), 3) + 0.0 AS std_components, round(sum(e), 3) + 0.0 AS total_energy, count(*) FILTER (nc > 0) AS detection_segments, count(f) AS n_detections_with_doppler, round(avg(f), 3) + 0.0 AS mean_doppler_freq_hz, round(avg(f * 3e8 / (2 * 9.39e9)), 3) + 0.0 AS mean_velocity_mps, round(100.0 * count(*) FILTER (nc > 0) / count(*), 3) + 0.0 AS detection_percent FROM j GROUP BY 1"
_column = "(VALUES (-2, 0), (-1, 0), (0, 0), (1, 0), (2, 0)) s(a, b)"
SQL["frame_statistics"] = ctes(SIG, cut_up("sig", 240, 120), transform("seg", 0, K, 31, digits=None), detection(LOOSE, "hit", frames=31),
    "off AS (SELECT signal_id, k, m FROM hit WHERE k / 32.0 >= 0.25)",
    f"det AS (SELECT DISTINCT signal_id, k + a AS k, m + b AS m FROM off x, {_column} WHERE k + a BETWEEN 0 AND {K - 1} AND m + b BETWEEN 0 AND 30)", clusters(steps(ANISO), ANISO.min_samples),
    "new AS (SELECT signal_id, count(*) AS a FROM det d WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.signal_id = d.signal_id AND h.k = d.k AND h.m = d.m) GROUP BY 1)",
    "c AS (SELECT signal_id, count(*) AS p, count(DISTINCT CASE WHEN cluster_id >= 0 THEN cluster_id END) AS c FROM lab GROUP BY 1)",
) + f"SELECT {_own} AS signal_id, CAST(split_part(signal_id, ':', 2) AS INT) AS frame_idx, round(CAST(split_part(signal_id, ':', 2) AS INT) * 120.0, 6) AS t_start, round(CAST(split_part(signal_id, ':', 2) AS INT) * 120.0 + 240, 6) AS t_end, coalesce(p, 0) AS n_pixels, coalesce(c, 0) AS n_clusters, coalesce(a, 0) AS n_added FROM (SELECT DISTINCT signal_id FROM seg) LEFT JOIN c USING (signal_id) LEFT JOIN new USING (signal_id)"

_points = """pt AS (SELECT signal_id, row_number() OVER (PARTITION BY signal_id ORDER BY k, m) AS i, CAST(k AS BIGINT) * 2147483648 + m AS id, k, m, k * 400.0 / 100.0 AS x, m * 0.5 / 0.05 AS y FROM det),
far AS (SELECT a.signal_id, a.i AS i, b.i AS j, a.id AS a, b.id AS b, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS d FROM pt a JOIN pt b ON a.signal_id = b.signal_id)"""
# Prim's algorithm: best holds the least edge of each point to those that are done
SQL["spanning_tree"] = ctes(DET, _points, "core AS (SELECT signal_id, i, list_sort(list(d))[least(3, count(*))] AS c FROM far GROUP BY 1, 2)",
    "edge AS (SELECT f.signal_id, f.i, list({'w': greatest(d, p.c, q.c), 'u': least(a, b), 'v': greatest(a, b)} ORDER BY f.j) AS of_i FROM far f JOIN core p ON p.signal_id = f.signal_id AND p.i = f.i JOIN core q ON q.signal_id = f.signal_id AND q.i = f.j GROUP BY 1, 2)",
    """prim AS (SELECT signal_id, of_i AS best, [1] AS done, CAST(NULL AS STRUCT(w DOUBLE, u BIGINT, v BIGINT)) AS e FROM edge WHERE i = 1
  UNION ALL SELECT p.signal_id, list_transform(range(1, len(best) + 1), lambda j: CASE WHEN of_i[j] < best[j] THEN of_i[j] ELSE best[j] END), list_append(done, CAST(next AS INT)), best[next]
  FROM (SELECT *, list_sort(list_transform(list_filter(range(1, len(best) + 1), lambda j: NOT list_contains(done, j)), lambda j: {'e': best[j], 'j': j}))[1].j AS next FROM prim WHERE len(done) < len(best)) p JOIN edge d ON d.signal_id = p.signal_id AND d.i = next)""",
) + "SELECT signal_id, e.u AS u, e.v AS v, round(e.w, 6) + 0.0 AS w FROM prim WHERE e IS NOT NULL"
SQL["agglomerative"] = ctes(DET, _points, "near AS (SELECT signal_id, i, arg_min(j, {'d': d, 'j': j}) AS j, min(d) AS d FROM far WHERE j > i GROUP BY 1, 2)", "o AS (SELECT signal_id, i, j, row_number() OVER (PARTITION BY signal_id ORDER BY d, i) AS o FROM near)",
    """lab AS (SELECT signal_id, CAST(0 AS BIGINT) AS o, range(1, count(*) + 1) AS l, count(*) AS c FROM pt GROUP BY 1
  UNION ALL SELECT lab.signal_id, o.o, CASE WHEN c > 4 AND l[i] <> l[j] THEN list_transform(l, lambda x: CASE WHEN x = l[j] THEN l[i] ELSE x END) ELSE l END, CASE WHEN c > 4 AND l[i] <> l[j] THEN c - 1 ELSE c END FROM lab JOIN o ON o.signal_id = lab.signal_id AND o.o = lab.o + 1)""",
    "fin AS (SELECT signal_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS l FROM lab QUALIFY row_number() OVER (PARTITION BY signal_id ORDER BY o DESC) = 1)",
) + "SELECT signal_id, k, m, CAST(dense_rank() OVER (PARTITION BY signal_id ORDER BY l) - 1 AS INT) AS cluster_id FROM fin JOIN pt USING (signal_id, i)"

# peaks are moved as the operator moves them; a triangle stands if no other peak lies in its circumcircle
_moved = """, num AS (SELECT signal_id, k, m, row_number() OVER (PARTITION BY signal_id ORDER BY k, m) - 1 AS pid, sqrt(power) AS magnitude FROM b JOIN bar_of USING (signal_id) WHERE power = q AND sqrt(power) > bar),
pt AS (SELECT signal_id, pid, k, m, magnitude, k * 100.0 / 100.0 + 1e-6 * (pid * 7919 % 10007) / 10007 AS x, m * 0.05 / 0.05 + 1e-6 * (pid * 104729 % 10009) / 10009 AS y FROM num),
tri AS (SELECT a.signal_id, a.pid AS v0, b.pid AS v1, c.pid AS v2, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, c.x AS cx, c.y AS cy, sign((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) AS turn FROM pt a JOIN pt b ON a.signal_id = b.signal_id AND a.pid < b.pid JOIN pt c ON b.signal_id = c.signal_id AND b.pid < c.pid
  WHERE abs((b.k - a.k) * (c.m - a.m) - (b.m - a.m) * (c.k - a.k)) > 0),
bad AS (SELECT DISTINCT t.signal_id, v0, v1, v2 FROM tri t JOIN pt d ON d.signal_id = t.signal_id AND d.pid NOT IN (v0, v1, v2)
  WHERE turn * ((power(ax - d.x, 2) + power(ay - d.y, 2)) * ((bx - d.x) * (cy - d.y) - (by_ - d.y) * (cx - d.x)) + (power(bx - d.x, 2) + power(by_ - d.y, 2)) * ((cx - d.x) * (ay - d.y) - (cy - d.y) * (ax - d.x)) + (power(cx - d.x, 2) + power(cy - d.y, 2)) * ((ax - d.x) * (by_ - d.y) - (ay - d.y) * (bx - d.x))) > 0),
net AS (SELECT signal_id, v0, v1, v2, row_number() OVER (PARTITION BY signal_id ORDER BY v0, v1, v2) - 1 AS tid FROM tri ANTI JOIN bad USING (signal_id, v0, v1, v2))"""
_peaks_of = _peaks.rstrip().removesuffix(",") + ", bar_of AS (SELECT signal_id, quantile_cont(sqrt(power), 0.9) AS bar FROM g GROUP BY 1)" + _moved
SQL["delaunay"] = _peaks_of + " SELECT signal_id, tid, CAST(v0 AS INT) AS v0, CAST(v1 AS INT) AS v1, CAST(v2 AS INT) AS v2 FROM net"
SQL["triangle_components"] = _peaks_of + """,
corner AS (SELECT signal_id, tid, unnest([v0, v1, v2]) AS pid FROM net), mean AS (SELECT signal_id, tid, avg(magnitude) AS mean FROM corner JOIN pt USING (signal_id, pid) GROUP BY 1, 2),
side AS (SELECT signal_id, tid, unnest([[v0, v1], [v1, v2], [v0, v2]]) AS e FROM net), pair AS (SELECT signal_id, min(tid) AS a, max(tid) AS b FROM side GROUP BY signal_id, e HAVING count(*) = 2),
lk AS (SELECT p.signal_id, a, b FROM pair p JOIN mean x ON x.signal_id = p.signal_id AND x.tid = a JOIN mean y ON y.signal_id = p.signal_id AND y.tid = b WHERE abs(x.mean - y.mean) / greatest(x.mean, y.mean) < 0.25),
link AS (SELECT * FROM lk UNION SELECT signal_id, b, a FROM lk), reach AS (SELECT signal_id, tid AS a, tid AS b FROM net UNION SELECT r.signal_id, r.a, l.b FROM reach r JOIN link l ON l.signal_id = r.signal_id AND l.a = r.b),
root AS (SELECT signal_id, a AS tid, min(b) AS root FROM reach GROUP BY 1, 2), cnt AS (SELECT signal_id, root, count(*) AS n FROM root GROUP BY 1, 2),
own AS (SELECT DISTINCT signal_id, root, pid FROM root JOIN corner USING (signal_id, tid)),
sums AS (SELECT signal_id, root, count(*) AS n_points, sum(magnitude * magnitude) AS energy, avg(k * 100.0) AS centroid_freq, avg(m * 0.05) AS centroid_time FROM own JOIN pt USING (signal_id, pid) GROUP BY 1, 2)
SELECT signal_id, n_points, round(energy, 4) + 0.0 AS energy, round(centroid_freq, 4) + 0.0 AS centroid_freq, round(centroid_time, 4) + 0.0 AS centroid_time, n AS n_triangles, CAST(row_number() OVER (PARTITION BY signal_id ORDER BY energy DESC, root) - 1 AS INT) AS component_id FROM sums JOIN cnt USING (signal_id, root)"""
SQL["stream_history"] = SQL["accumulated_history"]
SQL["stream_exponents"] = ctes(GRID, f"ser AS (SELECT signal_id, band, m, avg(ln(power + 1e-12)) AS x FROM g, (SELECT unnest(range(0, {K}, {BOOST.stride})) AS band) WHERE abs(k - band) <= {_half} GROUP BY 1, 2, 3)", f"win AS (SELECT signal_id, band, t0, m - t0 AS i, x FROM ser, (SELECT unnest(range(0, {M - _tw + 1}, {_ts})) AS t0) WHERE m >= t0 AND m < t0 + {_tw})", hurst("win", "signal_id, band, t0", max(8, _tw // 4))) + "SELECT signal_id, CAST(band AS INT) AS band, CAST(t0 AS INT) AS t0, round(hurst, 6) + 0.0 AS hurst FROM h"

# K clutter: the inverse of the regularised gamma function, a power series, by bisection
_k = Cfar("goca", 1, 2, 0.2)
_fit = """a AS (SELECT signal_id, count(*) AS c, quantile_cont(power, 0.95) AS q FROM g WHERE power > 1e-12 GROUP BY 1 HAVING count(*) >= 1000),
b AS (SELECT signal_id, var_pop(power) / (avg(power) * avg(power)) AS ratio FROM g JOIN a USING (signal_id) WHERE power > 1e-10 AND power <= q GROUP BY 1),
sh AS (SELECT DISTINCT g.signal_id, coalesce(greatest(0.5, least(100.0, 1 / (2 * ratio - 1))), 2.0) AS s FROM g LEFT JOIN b USING (signal_id)),
bis AS (SELECT signal_id, s, 0.0::DOUBLE AS lo, 1000.0::DOUBLE AS hi, 0 AS i FROM sh
  UNION ALL SELECT signal_id, s, CASE WHEN p < 0.8 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN p < 0.8 THEN hi ELSE (lo + hi) / 2 END, i + 1
  FROM (SELECT *, list_sum(list_transform(range(2500), lambda n: exp((s + n) * ln((lo + hi) / 2) - (lo + hi) / 2 - lgamma(s + n + 1)))) AS p FROM bis WHERE i < 70)),
fac AS (SELECT signal_id, greatest((lo + hi) / 2 / s, 0.01) AS factor FROM bis WHERE i = 70)"""
_hit = detection(_k).replace(multiplier(_k), "factor").replace("FROM det_n WHERE", "FROM det_n JOIN fac USING (signal_id) WHERE")
SQL["cfar_goca_k"] = ctes(GRID, _fit, _hit) + f"SELECT signal_id, k, m, power, {rounded('noise', 8)}, {rounded('threshold', 5)} FROM det"
