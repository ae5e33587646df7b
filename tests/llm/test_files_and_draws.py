"""Files of token ids, the draw towards a target and whitening, against plain versions, with the rows that break things."""

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonefield.llm import importance, token_files, whitening

DOC = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    long = " ".join("".join(rng.choice("abcdeé'0") for _ in range(rng.randint(1, 8))) for _ in range(60_000))
    rows = [(i, " ".join(rng.choice(["Word", "und", "l'été", "x9", "中文", "don't", "<|endoftext|>", "A-b"]) for _ in range(rng.randint(0, 90)))) for i in range(300)]
    rows += [(7, long), (None, "no id at all " * 9), (None, None), (900, None), (901, ""), (902, " \t\n"), rows[3], rows[3], (3, "the same id, another text " * 6)]
    return spark.createDataFrame(rows, DOC).select("*", *[F.lit("clash").alias(c) for c in ("mark", "rid", "buckets", "n_words", "score", "rank", "path", "above")]).repartition(5).cache()


def test_packing_is_exact():
    rng = np.random.default_rng(0)
    for trial in range(120):
        lengths = rng.integers(0 if trial % 3 == 0 else 1, rng.choice([2, 5, 400]), rng.integers(1, 12))
        n = int(lengths.sum())
        wide = np.array([int(rng.integers(1, 2**63)) * 2 + 1 >> (64 - int(b)) for b in rng.choice([1, 2, 8, 16, 30, 31, 60, 61, 64], n)], np.uint64)
        ids = wide if trial % 2 else (rng.integers(0, 49408, n) * (rng.random(n) < rng.choice([0, 0.01, 0.5, 1]))).astype(np.uint64)
        words, escapes, data = token_files.packed(ids, lengths)
        blocks = np.zeros(len(lengths), token_files.BLOCK_ROW)
        blocks["words"], blocks["ids"], blocks["escapes"] = words, lengths, escapes
        assert [len(x) for x in data] == (8 * (words + escapes)).tolist()
        assert (token_files.unpacked(b"".join(data), blocks) == ids).all()
        assert escapes.sum() == (ids >= 1 << 60).sum()
    # as many ids a word as the selectors allow
    assert token_files.packed(np.full(240, 1, np.uint64), np.array([240]))[0][0] == 4 and token_files.packed(np.zeros(241, np.uint64), np.array([241]))[0][0] == 3


def test_short_cut_gives_the_ids_of_the_library():
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(token_files.vocabulary()), token_files.Encoder(token_files.vocabulary())
    rng = random.Random(1)
    assert own.known
    for letters in ("aZåÅÿ×÷Àß é'  \t\n\x0b\x1c\x85 ́　İΣς<|中'sS9½!\x00‍😀", "aZ éÅ'sS9!.,\n"):
        for _ in range(3000):
            text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
            assert plain.encode(text, add_special_tokens=False).ids == own.ids(text).tolist(), repr(text)


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(token_files.vocabulary())
    files = token_files.written(docs.select("doc_id", "text"), token_files.new_path(spark, "test-ids"))
    out = sorted(token_files.read(files, with_ids=True).collect(), key=lambda r: r["start"])
    want = Counter((r["doc_id"], tuple(plain.encode(r["text"] or "", add_special_tokens=False).ids) + (2,)) for r in docs.collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in out) == want
    assert [r["start"] for r in out] == [0, *np.cumsum([r["n_tokens"] for r in out])[:-1]]
    assert all(r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in out)
    order = [math.inf if r["doc_id"] is None else r["doc_id"] for r in out]
    assert order == sorted(order) and max(r["n_tokens"] for r in out) > 3 * token_files.BLOCK
    again = token_files.token_files(spark, docs).orderBy("start").collect()
    assert [r["ids_crc32"] for r in again] == [r["ids_crc32"] for r in out]
    assert token_files.token_files(spark, docs.limit(0)).count() == 0


def brute_draw(rows, target, longest=1, percent=10):
    def found(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    own = [(d, *found(t)) for d, t in rows]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in found(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    out = []
    for d, n, f in own:
        h = int(sha256(f"2024:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f)) // len(f) if f else 0
        out.append((d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], math.inf if x[0] is None else x[0]))
    return out, fit[: percent * len(fit) // 100]


@pytest.mark.parametrize("longest,percent", [(1, 10), (3, 60)])
def test_draw(spark, docs, longest, percent):
    target = ["Word und l'été", None, "中文 a b x9 don't"]
    rows, drawn = brute_draw([(r["doc_id"], r["text"]) for r in docs.collect()], target, longest, percent)
    out = importance.resampled(docs, spark.createDataFrame([(x,) for x in target], "text string"), longest=longest, percent=percent).collect()
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in out) == Counter((d, n, w, s) for d, _, n, w, s in rows)
    got = sorted((r for r in out if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, len(drawn) + 1)) and len(drawn) > 10
    assert [(r["doc_id"], r["score"]) for r in got] == [(d, s) for d, _, _, _, s in drawn]


def test_draw_of_ties_and_nothing(spark):
    words = "one two three four " * 6
    # one id holds most rows, and all of its rows tie
    rows = [(5, words)] * 400 + [(i, words) for i in range(10, 60)]
    df = spark.createDataFrame(rows, DOC).repartition(7)
    target = spark.createDataFrame([(words,)], "text string")
    out = importance.resampled(df, target, percent=97).collect()
    ranks = sorted(r["rank"] for r in out if r["rank"] is not None)
    assert ranks == list(range(1, 97 * 450 // 100 + 1))
    five = sorted(r["rank"] for r in out if r["doc_id"] == 5 and r["rank"])
    assert five == list(range(five[0], five[0] + len(five)))
    assert importance.resampled(df.limit(0), target).count() == 0
    assert {r["rank"] for r in importance.resampled(df.where("doc_id < 12"), target.limit(0), percent=100).collect()} == set(range(1, 403))
    assert importance.sampled(df, target).columns == df.columns


def plain_whitening(x, k):
    fit = np.unique(x, axis=0)
    n = len(fit)
    c = (n * fit - fit.sum(0)) / n
    v = c.T @ c / n
    e, q = np.linalg.eigh(v)
    return n, fit.sum(0), e[::-1][:k], q[:, ::-1][:, :k], np.trace(v)


def test_whitening(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 40)) @ np.diag(np.geomspace(4, 0.5, 40)) + 3
    rows = [(i, r.tolist()) for i, r in enumerate(x)] + [(0, x[5].tolist())] * 30 + [(None, x[6].tolist()), (800, None), (801, []), (802, [1.0] * 39), (803, [None] + [1.0] * 39), (804, [math.nan] * 40), (805, [math.inf] + [0.0] * 39)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *[F.lit(1).alias(c) for c in ("x", "cell", "component", "deviation")])
    out = whitening.whitened(df).toPandas()
    assert len(out) == 731 * 16 and out["vec_id"].isna().sum() == 16
    fixed = lambda v: np.floor(64 * np.array(v)).astype(np.int64) + 1_000_000
    n, s, e, q, trace = plain_whitening(fixed(x), 16)
    assert (out["n"] == n).all() and n == 700 and out["identity_error"].max() < 1e-9
    one = out[out["vec_id"] == 9].sort_values("component")
    assert int(one["deviation"].iloc[0]) == sum(int(n * a - b) ** 2 for a, b in zip(fixed(x[9]), s))
    assert np.allclose(one["explained"], e / trace, rtol=1e-9)
    assert np.allclose(np.abs(one["whitened"]), np.abs((fixed(x[9]) - s / n) @ q / np.sqrt(e)), atol=1e-8)
    few = whitening.whitened(df.where("vec_id = 9"))
    assert few.count() == 0 and whitening.whitened(df.limit(0)).count() == 0
    # two vectors vary in one direction only
    two = whitening.whitened(df.where("vec_id IN (1, 2)")).collect()
    assert len(two) == 2 and all(abs(abs(r["whitened"]) - 1) < 1e-9 and abs(r["explained"] - 1) < 1e-9 for r in two)


@pytest.mark.parametrize("d,rank,block", [(300, 300, 8), (300, 20, 16), (60, 5, 7), (5, 5, 16), (200, 200, 3)])
def test_lanczos(d, rank, block):
    rng = np.random.default_rng(d)
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    e = np.zeros(d)
    e[:rank] = np.sort(rng.exponential(size=rank))[::-1]
    e[1:3] = e[1]  # a repeated value
    a = q @ np.diag(e) @ q.T
    values, vectors, passes = whitening.lanczos(lambda b: a @ b, d, 16, block)
    k = min(16, d)
    assert np.allclose(values, np.sort(e)[::-1][:k], atol=1e-10) and np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-12)
    assert np.abs(a @ vectors - vectors * values).max() < 1e-10
