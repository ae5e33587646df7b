"""Language identification by the nearest of several clustered centroids of TF-IDF n-gram vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import held_out, of_texts, stored, with_texts

#: Dimensions of the hashed n-gram space.
DIMS = 4096
#: Bytes that are looked at together, so that a very long text needs no more memory than this.
PIECE = 1 << 20
#: Classes of texts by the binary logarithm of the number of different runs; a short text is far from any centroid.
CLASSES = 14
#: A class's cutoff is FACTOR x the QUANTILE of its sample's cosines, which BINS counters hold, if it has ENOUGH rows.
QUANTILE, FACTOR, BINS, ENOUGH = 0.02, 0.75, 1000, 30
#: ASCII bytes that are no letters become a space; bytes of other characters stay.
FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def counts(text: str) -> np.ndarray:
    """How often each hashed run of one to three bytes occurs in the whole lower-cased text."""
    out = np.zeros(DIMS, np.int64)
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(FOLD) + b" ", np.uint8)
    for at in range(0, len(data), PIECE):
        b = data[at : at + PIECE + 2].astype(np.uint32)
        n = min(PIECE, len(data) - at)
        out[:256] += np.bincount(b[:n], minlength=256)
        two = (b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA6B))[:n]
        three = (b[:-2] * np.uint32(0x27D4EB2F) + b[1:-1] * np.uint32(0x9E3779B1) + b[2:] * np.uint32(0x165667B1))[:n] if len(b) > 2 else b[:0]
        for h in (two, three):
            out[256:] += np.bincount((h ^ (h >> 15)) % np.uint32(DIMS - 256), minlength=DIMS - 256)
    return out


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    """Rows of unit length: log counts weighted by idf."""
    x = np.log1p(np.stack([counts(t) for t in texts])).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    langs: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    cutoff: np.ndarray  # of each centroid and class of size: a document whose cosine is below is rejected

    def nearest(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's nearest centroid, its cosine, and whether that is below the cutoff."""
        v = vectors(texts, self.idf)
        sim = v @ self.centroids.T
        best = sim.argmax(1)
        return best, sim.max(1), sim.max(1) < self.cutoff[best, classes(v)]


def classes(v: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum((v > 0).sum(1), 1)).astype(np.int64)


def cutoffs(histogram: np.ndarray) -> np.ndarray:
    """The cutoff of each class, from the counts of its cosines (class, bin).

    A class with few rows takes the cutoff of the next smaller one that has enough; those below all such, where
    cosines fall with the root of the size, a cutoff that falls so too. With no class that has enough, all are one.
    """
    n = histogram.sum(1)
    low = FACTOR * (histogram.cumsum(1) > QUANTILE * n[:, None]).argmax(1) / BINS
    full = np.flatnonzero(n >= min(ENOUGH, n.max(initial=0)))
    if not n.any():
        return np.zeros(len(n))
    return np.array([low[full[full <= k].max()] if k >= full[0] else low[full[0]] * 2.0 ** ((k - full[0]) / 2) for k in range(len(n))])


def fit(docs: DataFrame, per_language: int = 3000, clusters: int = 3, rounds: int = 4) -> Model | None:
    """Learns from text and lang of docs; None where no row has both.

    Document frequencies are counted over all rows. The centroids come from spherical k-means over a bounded
    sample, per_language rows a language on average, chosen by hash; a language has `clusters` centroids.
    The cutoffs of a language come from a low quantile of its sample documents' cosines, for each class of size.
    """
    docs = of_texts(docs).where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")

    def frequency(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(DIMS, np.int64)
        for part in parts:
            for t in part["text"]:
                df += counts(t) > 0
        yield pd.DataFrame({"dim": np.arange(DIMS), "n": df})

    dims = docs.select("text").mapInPandas(frequency, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    if not sizes:
        return None
    df = np.zeros(DIMS)
    df[[r["dim"] for r in dims]] = [r["n"] for r in dims]
    idf = (np.log((1 + sum(sizes.values())) / (1 + df)) + 0.1).astype(np.float32)

    rate = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, per_language / n)])[F.col("lang")]
    # by id and text, so that a text that repeats is drawn as often as others
    u = F.xxhash64("doc_id", "text", F.lit(7))
    sample = docs.withColumn("u", u).where((F.col("u") / F.lit(2.0**64) + 0.5) < rate)

    def vectorised(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), 256):
                p = part.iloc[at : at + 256]
                yield pd.DataFrame({"lang": p["lang"], "u": p["u"], "v": [v.tobytes() for v in vectors(list(p["text"]), idf)]})

    sample = stored(sample.mapInPandas(vectorised, "lang string, u long, v binary"), "language-sample")
    start = sample.groupBy("lang", F.pmod("u", F.lit(clusters)).alias("k")).agg(F.min_by("v", "u").alias("v")).orderBy("lang", "k").collect()
    langs, c = [r["lang"] for r in start], np.stack([np.frombuffer(r["v"], np.float32) for r in start])
    own = {x: np.array([i for i, y in enumerate(langs) if y == x]) for x in set(langs)}
    for _ in range(rounds):

        def assigned(parts: Iterator[pd.DataFrame], c=c) -> Iterator[pd.DataFrame]:
            sums, n = np.zeros(c.shape), np.zeros(len(c), np.int64)
            for part in parts:
                v = np.stack([np.frombuffer(b, np.float32) for b in part["v"]]) if len(part) else np.zeros((0, DIMS), np.float32)
                for lang, rows in part.groupby("lang", sort=False).indices.items():
                    sim = v[rows] @ c[own[lang]].T
                    to = own[lang][sim.argmax(1)]
                    np.add.at(sums, to, v[rows])
                    np.add.at(n, to, 1)
            yield pd.DataFrame({"c": np.arange(len(c)), "n": n, "v": list(sums)})

        parts = sample.mapInPandas(assigned, "c int, n long, v array<double>").where("n > 0")
        dim = parts.select("c", F.posexplode("v").alias("d", "x")).groupBy("c", "d").agg(F.sum("x").alias("x"))
        for r in dim.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("d", "x"))).alias("v")).collect():
            v = np.array([x["x"] for x in r["v"]])
            c[r["c"]] = v / max(np.linalg.norm(v), 1e-12)

    def cosines(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for lang, rows in part.groupby("lang", sort=False).indices.items():
                v = np.stack([np.frombuffer(b, np.float32) for b in part["v"].iloc[rows]])
                yield pd.DataFrame({"lang": lang, "k": classes(v), "bin": np.clip((v @ c[own[lang]].T).max(1) * BINS, 0, BINS - 1).astype(int)})

    seen = {x: np.zeros((CLASSES, BINS), np.int64) for x in own}
    for r in sample.mapInPandas(cosines, "lang string, k int, bin int").groupBy("lang", "k", "bin").count().toLocalIterator():
        seen[r["lang"]][r["k"], r["bin"]] = r["count"]
    of = {x: cutoffs(h) for x, h in seen.items()}
    return Model(langs, c, idf, np.stack([of[x] for x in langs]))


GUESS = {"lang_pred": pa.string(), "score": pa.float64(), "rejected": pa.bool_()}


def guessed(texts: list[str | None], model: Model | None) -> dict:
    """The columns of GUESS for each text. A letter is a character of a letter category: no numeral, mark or symbol."""
    known = [i for i, t in enumerate(texts) if model and t and any(map(str.isalpha, t))]
    lang, score, out = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    if known:
        best, sim, out[known] = model.nearest([texts[i] for i in known])
        score[known] = np.clip(sim, 0, 1)
        for i, b in zip(known, best, strict=True):
            lang[i] = model.langs[b]
    return {"lang_pred": lang, "score": score, "rejected": out}


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score and rejected for each row of docs (doc_id, text).

    lang_pred is the language of the nearest centroid by cosine, `score` that cosine; of equal cosines the
    first by language decides. A text that is null or has no letter is `und` with score 0, and so is every
    text where nothing could be learned. rejected: `und`, or further from its centroid than the cutoff.
    Repeated rows are predicted alike; an empty table gives an empty result.
    """

    return with_texts(docs, ["doc_id"], lambda texts: guessed(texts, model), GUESS)


def learned(docs: DataFrame) -> Model | None:
    """The model of the rows that may be learned from."""
    return fit(docs.where(~held_out(F.col("doc_id"))))


def identified(docs: DataFrame) -> DataFrame:
    """docs without the rows that the model of their own learning part rejects; all columns pass unchanged."""
    model = learned(docs)
    judged = with_texts(docs, docs.columns, lambda texts: {"__rejected": guessed(texts, model)["rejected"]}, {"__rejected": pa.bool_()})
    return judged.where(~F.col("__rejected")).drop("__rejected")
