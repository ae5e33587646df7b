"""Exact copies, near copies, passages and neighbours against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonefield.llm import ann, exact_dedup, ngram_join, substring

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return [rng.choice("abcdefghij") + rng.choice("klmnopq") + rng.choice("rstuv") for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    rows = []
    for _ in range(12):
        base = words(rng, rng.randint(30, 90))
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "zz" + str(rng.randrange(9))
            rows.append(" ".join(w))
    rows += [None, "", " \t\n", "one", "ONE ", "two words", "Two  words", "x " * 4000]
    rows += [rows[0], rows[0] + " ", rows[3].upper()]
    return [(i, t, None, None, None) for i, t in enumerate(rows)] + [(5, rows[5], None, None, None), (None, rows[0], None, None, None)]


def brute_groups(rows):
    groups = {}
    for k, (i, t, *_) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, k, i))
    return {k: (min(g)[4], len(g)) for g in groups.values() for *_, k, _ in g}


@pytest.mark.parametrize("hash_fn", [F.xxhash64, lambda c: F.length(c) % 3])
def test_exact_groups(spark, corpus, hash_fn):
    out = exact_dedup.exact_groups(spark.createDataFrame(corpus, DOC), bucket_capacity=4, hash_fn=hash_fn).collect()
    want = brute_groups(corpus)
    assert len(out) == len(corpus)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["keep_id"], r["group_size"]) for r in out) == sorted((i is None, i or 0, *want[k]) for k, (i, *_) in enumerate(corpus))
    assert sum(r["kept"] for r in out) == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, *_ in corpus})


def test_exact_empty_and_columns(spark, corpus):
    df = spark.createDataFrame(corpus, DOC).withColumn("h", F.lit(1)).withColumn("best", F.lit("x"))
    assert exact_dedup.exact_groups(df.limit(0)).count() == 0
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns and kept.count() == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, *_ in corpus})


def brute_components(rows, width, percent):
    sets = []
    for _, t, *_ in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[max(top(a), top(b))] = min(top(a), top(b))
    ids = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            ids[top(k)] = min(ids.get(top(k), i), i)
    return sorted((-1 if i is None else i, len(sets[k]), i if not sets[k] and i is None else (i if not sets[k] else ids.get(top(k)))) for k, (i, *_) in enumerate(rows))


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (2, 60)])
def test_near_copies(spark, corpus, width, percent):
    out = ngram_join.near_copies(spark.createDataFrame(corpus, DOC), width, percent).collect()
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], r["component_id"]) for r in out)
    assert got == brute_components(corpus, width, percent)


def test_near_copies_of_nothing(spark):
    assert ngram_join.near_copies(spark.createDataFrame([], DOC)).count() == 0


def test_one_of_each(spark, corpus):
    df = spark.createDataFrame([r for r in corpus if r[0] is not None], DOC).dropDuplicates(["doc_id"])
    left = {r["doc_id"] for r in ngram_join.one_of_each(df, 3, 90).collect()}
    rows = [tuple(r) for r in df.collect()]
    assert left == {i for i, n, c in brute_components(rows, 3, 90) if i == c or n == 0}


def test_sketches_of_linking_sets_share_enough():
    for p in (60, 80, 90, 95):
        for a in range(1, 260):
            for b in range(a, min(260, a * 100 // p + 1)):
                both = -(-(p * (a + b)) // (100 + p))
                real = max(1, both - max(a - ngram_join.sketch_size(a, p), b - ngram_join.sketch_size(b, p)))
                assert ngram_join.sure(a, p) <= real and ngram_join.sure(b, p) <= real


def test_rows_that_repeat_an_id_are_told_apart(spark):
    w, v = "one text of some words", "another one with other words in it"
    df = spark.createDataFrame([(1, w), (2, w), (2, v), (3, v), (4, None), (4, ""), (None, v)], "doc_id long, text string").withColumn("root", F.lit(0))
    left = sorted((r["doc_id"], r["text"]) for r in ngram_join.one_of_each(df).collect() if r["text"])
    assert left == [(1, w), (2, v)] and ngram_join.one_of_each(df).count() == 4
    df = spark.createDataFrame([(1, "a b"), (1, "ab "), (1, "ab "), (2, "c"), (2, None), (2, ""), (None, "c")], "doc_id long, text string").withColumn("mark", F.lit("x"))
    left = exact_dedup.drop_copies(df)
    assert left.columns == df.columns and sorted((r["doc_id"], re.sub(" ", "", r["text"] or "")) for r in left.collect()) == [(1, "ab"), (2, ""), (2, "c")]


def test_directory_doubles_until_no_bucket_is_overfull(spark):
    # keys that share their leading 50 bits, and others that do not
    keys = spark.range(500).select(F.col("id").alias("h")).union(spark.range(500).select(F.xxhash64("id")))
    tables = exact_dedup.directory(keys, 1000, 10)
    assert len(tables) > 1 and tables[-1][0] > 54
    owned = exact_dedup.looked_up(keys, tables)
    assert owned.count() == 1000 and owned.groupBy("bucket", "local_depth").count().agg(F.max("count")).first()[0] <= 10


def test_passages(spark):
    rng = random.Random(9)
    shared, rows = words(rng, 70), []
    rows.append((1, " ".join(words(rng, 120))))
    for i in (3, 5, 8):
        p = list(shared)
        if i == 8:
            p[20] = p[41] = "changed"
        rows.append((i, " ".join(words(rng, 40) + p + words(rng, 40))))
    rows += [(9, " ".join(shared[:30] + words(rng, 60))), (10, None), (11, ""), (12, "few words"), (5, rows[2][1]), (None, rows[1][1])]
    out = {r["doc_id"]: r for r in substring.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(out) == {5, 8}
    for r in out.values():
        assert r["sources"] == [3] and abs(r["start"] - 40) <= 3 and abs(r["end"] - 110) <= 3 and r["similarity"] >= 0.9
    assert substring.passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def changed(rng, w, share, mixed):
    """w with a share of its words substituted, or in equal parts substituted, left out and followed by another."""
    out, at = [], set(rng.sample(range(len(w)), round(share * len(w))))
    for i, x in enumerate(w):
        kind = rng.randrange(3) if mixed else 0
        out += [x] if i not in at else [["new" + str(rng.randrange(999))], [], [x, "more" + str(rng.randrange(999))]][kind]
    return out


@pytest.mark.parametrize(("n", "share", "mixed"), [(60, 0.1, False), (60, 0.15, False), (60, 0.1, True), (60, 0.15, True), (100, 0.15, True), (100, None, False)])
def test_changed_passages_are_found(spark, n, share, mixed):
    rng, rows = random.Random(21), []
    for i in range(100):
        p = words(rng, n)
        q = changed(rng, p, share, mixed) if share else [x if k % 6 else "new" + str(k) for k, x in enumerate(p)]
        rows += [(i, " ".join(words(rng, 30) + p + words(rng, 30))), (1000 + i, " ".join(words(rng, 50) + q + words(rng, 50)))]
    out = substring.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    hit = {r["doc_id"] for r in out if r["sources"] == [r["doc_id"] - 1000] and abs(r["start"] - 50) <= 8 and r["similarity"] >= 0.8}
    assert len(hit) >= 95, len(hit)
    assert all(r["doc_id"] >= 1000 for r in out)


def test_one_pair_alone_and_a_pair_over_several_batches(spark):
    rng = random.Random(31)
    shared = words(rng, 60)
    rows = [(2**53 + 1, " ".join(words(rng, 20) + shared)), (2**53 + 3, " ".join(shared + words(rng, 20)))]
    out = substring.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["sources"], r["start"]) for r in out] == [(2**53 + 3, [2**53 + 1], 0)]
    # long texts that repeat a line, so that one pair has more matches than a batch has rows
    line = words(rng, 9)
    long = " ".join((line + words(rng, 9)) * 1500)
    df = spark.createDataFrame([(1, long), (2, long)], "doc_id long, text string").withColumn("h", F.lit(1)).withColumn("pos", F.lit(1))
    out = substring.passages(df).collect()
    assert [(r["doc_id"], r["sources"]) for r in out] == [(2, [1])] and out[0]["n_words"] >= 26_900


def test_passage_that_very_many_share(spark):
    rng, rows = random.Random(41), []
    shared = words(rng, 60)
    for i in range(60):
        p = changed(rng, shared, 0.1, True) if i % 3 == 2 else shared
        rows.append((i, " ".join(words(rng, 25) + p + words(rng, 25))))
    rows += [(100 + i, " ".join(words(rng, 110))) for i in range(20)]
    for parts in (1, 7):
        out = {r["doc_id"]: r for r in substring.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()}
        assert set(range(1, 60)) - set(out) <= {i for i in range(60) if i % 3 == 2} and len(out) >= 57 and max(out) < 100
        assert all(abs(r["start"] - 25) <= 8 for r in out.values())


def test_changed_passage_that_hundreds_share_and_the_exact_setting(spark):
    rng, rows = random.Random(43), []
    shared = words(rng, 60)
    for i in range(200):
        rows.append((i, " ".join(words(rng, 25) + (changed(rng, shared, 0.1, True) if i else shared) + words(rng, 25))))
    rows += [(1000 + i, " ".join(words(rng, 110))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    some = {r["doc_id"] for r in substring.passages(df).collect()}
    exact = {r["doc_id"] for r in substring.passages(df, 1, substring.EXACT).collect()}
    assert max(some | exact) < 200 and 0 not in some | exact
    assert len(exact) >= 197 and len(some & exact) >= 0.95 * len(exact), (len(some), len(exact), len(some & exact))


def test_every_match_in_parts_of_a_seed(spark, monkeypatch):
    monkeypatch.setattr(substring, "PART", 7)
    rows = [(i, "one two three four") for i in range(40)] + [(100, "one two three four and one two three four"), (101, "nothing like any other")]
    packs = substring.seeds(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 1, substring.EXACT)
    out = substring.every_match(packs)
    assert "part" in out._jdf.queryExecution().optimizedPlan().toString()
    want = {(i, j, 0, 0) for i in range(40) for j in range(i)} | {(100, j, p, 0) for j in range(40) for p in (0, 5)}
    got = [tuple(r) for r in out.select("doc", "source", "pos", "at").collect()]
    assert len(got) == len(want) and set(got) == want
    # the exact search takes that way, not one task that makes all pairs of a seed
    monkeypatch.setattr(substring, "level", None)
    assert substring.passages(spark.createDataFrame(rows, "doc_id long, text string"), 1, substring.EXACT).count() == 0


def test_every_run_as_a_seed_finds_no_less(spark):
    rng, rows = random.Random(23), []
    for i in range(40):
        p = words(rng, 60)
        rows += [(i, " ".join(words(rng, 30) + p)), (1000 + i, " ".join(changed(rng, p, 0.1, True) + words(rng, 50)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    some, every = ({r["doc_id"] for r in substring.passages(df, keep).collect()} for keep in (substring.KEEP, 1))
    assert len(every) >= 38 and len(some) >= 38 and all(i >= 1000 for i in some | every)


def test_passage_quoted_piecemeal_before(spark):
    rng = random.Random(22)
    shared, rows = words(rng, 60), []
    # each sentence of the passage was quoted before, in many documents of their own
    for k in range(12):
        rows += [(20 * k + i, " ".join(words(rng, 30) + shared[5 * k : 5 * k + 5] + words(rng, 30))) for i in range(12)]
    rows += [(i, " ".join(words(rng, 40) + shared + words(rng, 40))) for i in (1000, 2000)]
    # a source that has a line of the passage a second time, before it
    again = words(rng, 60)
    rows += [(3000, " ".join(again[20:40] + words(rng, 40) + again)), (4000, " ".join(words(rng, 40) + again))]
    out = {r["doc_id"]: r for r in substring.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(out) == {2000, 4000}
    assert out[2000]["sources"] == [1000] and out[2000]["n_words"] >= 60 and out[4000]["sources"] == [3000] and out[4000]["n_words"] >= 60


def test_long_pieces_of_different_sources_stay_apart():
    assert substring.joined([(1, 0, 60, 48), (2, 70, 130, 48)]) == [(0, 60, 48, {1}), (70, 130, 48, {2})]
    assert substring.joined([(1, 0, 30, 30), (2, 35, 65, 30)]) == [(0, 65, 60, {1, 2})]


def test_chains_against_all_pairs(monkeypatch):
    monkeypatch.setattr(substring, "CUT", 1000)
    rng = np.random.default_rng(2)
    for _ in range(40):
        n = int(rng.integers(2, 25))
        pos, at = rng.integers(0, 120, n), rng.integers(0, 120, n)
        score = np.full(n, substring.GAIN)
        for j in np.lexsort((-at, pos)):
            for i in range(n):
                if pos[i] < pos[j] and at[i] < at[j]:
                    score[j] = max(score[j], substring.GAIN + score[i] - substring.GAP_COST * (pos[j] - pos[i] + at[j] - at[i]))
        best = max((substring.GAIN * len(c) - substring.GAP_COST * (pos[c[-1]] - pos[c[0]] + at[c[-1]] - at[c[0]]) for c in substring.chains(pos, at)), default=substring.GAIN)
        assert best == pytest.approx(score.max())


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 16))
    x[700:] = x[0] + rng.normal(scale=1e-3, size=(200, 16))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] + [1.0] * 15), (2003, [None] + [1.0] * 15), (2004, [1.0]), (None, [1.0] * 16)]
    df = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    out = ann.search(df, df.where("vec_id % 50 = 0")).toPandas()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 900, 50):
        s = unit @ unit[q]
        s[q] = -9
        mine = out[out.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == [1, 2, 3, 4, 5] and np.allclose(mine["score"], s[mine["vec_id"]])
        hit += len(set(np.argsort(-s)[:5]) & set(mine["vec_id"]))
    assert hit >= 0.95 * 90
    few = df.where("vec_id < 3")
    assert ann.search(few, few.where("vec_id = 0")).count() == 2
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
