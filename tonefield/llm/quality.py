"""A quality score: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import held_out, stored, with_texts

NAMES = ("bytes", "words", "lines", "word_length", "word_spread", "lower", "upper", "digit", "marks", "odd", "not_ascii", "space", "distinct", "top_word", "repeated_pairs", "repeated_lines", "line_words", "short_words", "shouting", "marked_words", "sentences", "same_neighbour")
#: Random features, their scale and the ridge.
FEATURES, WIDTH, RIDGE = 128, 4.0, 1e-3
#: Score bins for the calibration.
BINS = 1024
MARKS, ODD = b".,;:'\"()-?", b"!#$%&*+/<=>@[\\]^_`{|}~"


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text, in the order of NAMES; a null text counts as empty."""
    text = text or ""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    n, w = max(1, int(raw.sum())), max(1, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    seen = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), float(size.mean()), float(size.std()),
        raw[97:123].sum() / n, raw[65:91].sum() / n, raw[48:58].sum() / n, raw[list(MARKS)].sum() / n, raw[list(ODD)].sum() / n, raw[128:].sum() / n, raw[[32, 9, 10, 11, 12, 13]].sum() / n,
        len(seen) / w, max(seen.values(), default=0) / w, 1 - pairs / max(1, len(words) - 1) if len(words) > 1 else 0.0,
        1 - len(set(lines)) / max(1, len(lines)) if lines else 0.0, np.log1p(len(words) / max(1, len(lines))), float((size <= 3).mean()),
        sum(c for x, c in seen.items() if len(x) > 1 and x.isupper()) / w, sum(c for x, c in seen.items() if not x[-1].isalnum() and x[-1] not in ".,;:?") / w,
        len(re.findall(r"[.?!](?:\s|$)", text)) / w, sum(map(str.__eq__, words, words[1:])) / w,
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every row of docs (doc_id, text)."""

    return with_texts(docs, ["doc_id"], lambda texts: {"x": [np.nan_to_num(np.asarray(statistics(t), float)) for t in texts]}, {"x": pa.list_(pa.float64())})


class Model:
    """Standardised statistics -> cosines at random frequencies -> ridge weights -> isotonic steps."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.frequency = rng.normal(0, 1 / WIDTH, (len(mean), FEATURES))
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.knots, self.levels = np.array([0.0]), np.array([0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.frequency + self.phase), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.levels), 0, 1)


def isotonic(at: np.ndarray, mean: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the nondecreasing levels nearest to mean, weighted by n, at the ascending places at."""
    pools: list[list[float]] = []  # place times weight, level times weight, weight
    for a, m, w in zip(at, mean, n, strict=True):
        pools.append([a * w, m * w, w])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def stacked(part: pd.DataFrame) -> np.ndarray:
    return np.stack(part["x"].to_numpy()) if len(part) else np.zeros((0, len(NAMES)))


def fit(rows: DataFrame) -> Model | None:
    """Learns from rows (x, y), y between 0 and 1; None where there are none. Every row counts.

    Each partition sums its own normal equations; the sums are added by partial aggregation, and only
    FEATURES + 1 rows reach the driver. The calibration sees the rows' raw scores in BINS bins.
    """
    n = len(NAMES)
    by = rows.agg(F.count("*").alias("n"), *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(n)], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(n)]).first()
    if not by["n"]:
        return None
    model = Model(np.array([by[f"m{i}"] for i in range(n)]), np.array([by[f"s{i}"] for i in range(n)]))

    def equations(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for p in parts:
            z = model.features(stacked(p))
            total += z.T @ np.column_stack([z, p["y"].to_numpy(float)])
        yield pd.DataFrame({"i": np.arange(FEATURES + 1), "v": list(total)})

    sums = rows.mapInPandas(equations, "i int, v array<double>").groupBy("i").agg(*[F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(FEATURES + 2)]).orderBy("i").collect()
    a = np.array([[r[f"v{j}"] for j in range(FEATURES + 2)] for r in sums])
    model.weights = np.linalg.solve(a[:, :-1] + RIDGE * by["n"] / FEATURES * np.eye(FEATURES + 1), a[:, -1])

    def binned(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            raw = model.raw(stacked(p))
            yield pd.DataFrame({"bin": np.clip((raw + 1) * BINS / 3, 0, BINS - 1).astype(int), "raw": raw, "y": p["y"].to_numpy(float)})

    bins = rows.mapInPandas(binned, "bin int, raw double, y double").groupBy("bin").agg(F.avg("raw").alias("raw"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    at, mean, w = (np.array([r[k] for r in bins], float) for k in ("raw", "y", "n"))
    model.knots, model.levels = isotonic(at, mean, w)
    return model


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs (doc_id, text); labels has doc_id, quality.

    Labels of held-out ids are never read; an id with several labels counts by their mean, null labels not
    at all. A null text counts as empty and is scored like any text. Without labels every score is 0.5.
    Repeated rows score alike; an empty table gives an empty result.
    """
    stats = stored(document_statistics(docs), "statistics")
    y = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg("quality").alias("y"))
    rows = stored(stats.join(y, "doc_id").select("x", "y"), "labelled")
    model = fit(rows)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").to_pylist()
            score = model.score(np.array(x)) if model and x else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    out = stats.mapInArrow(of, f"doc_id {dict(stats.dtypes)['doc_id']}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
