"""Mixing, languages, tokens, archives, quality and personal data."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonefield.llm import langid, mixing, pii, quality, sentencepiece_codec, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.choice([0, 1, 5, 40, 300]), None, rng.choice(["a", "a", "a", "b", "c", None]), 0) for i in range(600)]
    rows += [rows[0], rows[0], (None, "some words", None, "b", 0), (601, None, None, "b", 0)]
    df = spark.createDataFrame(rows, DOC).withColumn("a", F.lit(1))
    out = mixing.mix(df, fan_in=8).toPandas()
    again = mixing.mix(df, fan_in=8).toPandas()
    key = ["doc_id", "uid"]
    assert out.sort_values(key)["taken"].tolist() == again.sort_values(key)["taken"].tolist()
    assert len(out) == len(rows) and (out["taken"] <= 3 * out["size"]).all() and (out["taken"] % out["size"].clip(lower=1) == 0).all()
    size = {}
    for _, t, _, s, _ in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, target, open_ = sum(size.values()), {}, set(order)
    while True:  # share, stop at the cap, share again
        rest = total - sum(target.values())
        over = {s for s in open_ if rest * weight[s] / sum(weight[x] for x in open_) > 3 * size[s]}
        if not over:
            target |= {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
            break
        target |= {s: 3.0 * size[s] for s in over}
        open_ -= over
    for s in order:
        mine = out[out["source"].isna()] if s is None else out[out["source"] == s]
        assert mine["target"].iloc[0] == pytest.approx(target[s]) and mine["source_size"].iloc[0] == size[s]
        longest = max((len((t or "").split()) for _, t, _, x, _ in rows if x == s), default=0)
        assert abs(mine["taken"].sum() - target[s]) < longest + 1e-6
    assert mixing.mix(df.limit(0)).count() == 0
    docs = mixing.mixed_documents(df)
    assert docs.columns == df.columns


def test_language(spark):
    rng = random.Random(5)
    kinds = {"xx": "the and of that with ing ed".split(), "yy": "der die und nicht ein ung".split()}
    rows = [(i, " ".join(rng.choice(kinds[k]) + rng.choice(["", "er", "en"]) for _ in range(40)), k, None, 0) for i in range(300) for k in ["xx" if i % 2 else "yy"]]
    rows += [(1000, None, None, None, 0), (1001, "", None, None, 0), (1002, "123 !!", None, None, 0), (1003, "the and " * 30000, None, None, 0)]
    df = spark.createDataFrame(rows, DOC).withColumn("score", F.lit(1))
    out = {r["doc_id"]: r for r in langid.predict(df, langid.learned(df)).collect()}
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 and out[i]["rejected"] for i in (1000, 1001, 1002))
    assert out[1003]["lang_pred"] == "xx"
    assert np.mean([out[i]["lang_pred"] == k for i, _, k, *_ in rows[:300]]) > 0.98
    assert not any(out[i]["rejected"] for i in range(300))
    kept = langid.identified(df)
    assert kept.columns == df.columns and kept.count() == 301
    assert langid.predict(df.limit(0), None).count() == 0 and langid.learned(df.limit(0)) is None
    assert {r["lang_pred"] for r in langid.predict(df, None).collect()} == {"und"}


def test_pieces_are_the_librarys(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    codec = sentencepiece_codec.Codec(sentencepiece_codec.Pieces())
    rng = random.Random(1)
    texts = ["", " ", "  two  spaces ", "tab\tline\n", "héé 你好 😀", "a" * 500, "<s> </s> <0x41>", "x" + " " * 40 + "y"]
    texts += ["".join(rng.choice("aabcdeefghilmnorstu  é.,0你") for _ in range(rng.randint(1, 120))) for _ in range(800)]
    texts += ["".join(rng.choice("abcdefghilmnorstu") for _ in range(3000)) for _ in range(5)]
    for t in texts:
        ids = codec.encode(t)
        assert ids == lib.encode(t) and codec.decode(ids) == t
    for t in texts:  # every chunk went through the stream, which commits pieces in several steps where a chunk is long
        for chunk in sentencepiece_codec.CHUNK.findall("▁" + t.replace(" ", "▁")):
            steps = list(codec.stream(chunk))
            assert "".join(x for pieces in steps for x in pieces) == chunk
            assert len(chunk) < 200 or len(steps) > len(chunk) / 64
            assert codec.known[chunk] == np.array([i for pieces in steps for x in pieces for i in codec.ids(x)], np.int32).tobytes()
    rows = [(i, t) for i, t in enumerate(texts[:20])] + [(50, None), (50, None), (51, "▁")]
    out = {r["doc_id"]: r for r in sentencepiece_codec.encoded(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[50]["ids"] is None and out[50]["n_tokens"] == 0 and out[51]["round_trip"] is False and out[0]["ids"] == []
    assert all(out[i]["round_trip"] for i in range(20))
    back = sentencepiece_codec.decoded(spark.createDataFrame([(1, codec.encode("ab c")), (2, None)], "doc_id long, ids array<int>")).collect()
    assert {r["doc_id"]: r["text"] for r in back} == {1: "ab c", 2: None}
    assert sentencepiece_codec.encoded(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pieces_are_searched_once(monkeypatch):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    codec = sentencepiece_codec.Codec(sentencepiece_codec.Pieces())
    searched, stream = [], codec.stream
    monkeypatch.setattr(codec, "stream", lambda text: searched.append(text) or stream(text))
    for t in ("word%%% other&&&", "other%%% word&&&", "other. word.\nThe", "word,%%% x"):
        assert codec.encode(t) == lib.encode(t)
    # what no piece joins is searched apart, so a word with another mark behind it is not searched again
    assert len(searched) == len(set(searched)) and sorted(x for x in searched if "o" in x) == ["▁other", "▁word"]
    # what is asked for again and again outlasts what is not
    monkeypatch.setattr(sentencepiece_codec, "REMEMBERED", 20 * (sentencepiece_codec.ENTRY + 30))
    searched.clear()
    for i in range(200):
        assert codec.encode(f"often u{i}v") == lib.encode(f"often u{i}v")
    assert searched.count("▁often") == 1


def test_chunks_of_many_texts_are_searched_together(monkeypatch):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    pieces = sentencepiece_codec.Pieces()
    codec = sentencepiece_codec.Codec(pieces)
    searched, stream = [], codec.stream
    monkeypatch.setattr(codec, "stream", lambda text: searched.append(text) or stream(text))
    rng = random.Random(7)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(rng.randint(1, n)))
    texts = [" ".join(word(rng.choice(["aehinorst", "aehinorstdlcumAEÉéüñß", "ab,.-\n%0123", "一你好𠀀😀▁e \x00"]), 14) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += ["", " ", "▁", "  a  ", "\n\n", "😀" * 100, "a" * 32, "a" * 31 + " b", "%" * 90]
    got = list(codec.arrays(texts))
    assert [x.tolist() for x in got] == [lib.encode(t) for t in texts]
    # only what is longer than the window goes through it alone
    assert all(len(x) > 2 * pieces.longest for x in searched)
    searched.clear()
    long = "".join(rng.choice("abcdefghilmnorstu") for _ in range(300))
    assert [x.tolist() for x in codec.arrays([f"word {long} word", "word"])] == [lib.encode(f"word {long} word"), lib.encode("word")]
    assert searched == ["▁" + long]
    # texts that go apart, chunks and pairs that are forgotten again and again
    monkeypatch.setattr(sentencepiece_codec, "TOGETHER", 500)
    monkeypatch.setattr(sentencepiece_codec, "REMEMBERED", 20 * (sentencepiece_codec.ENTRY + 30))
    forgetful = sentencepiece_codec.Codec(pieces)
    forgetful.together.pairs = sentencepiece_codec.Lookup(6)
    assert all(np.array_equal(a, b) for a, b in zip(forgetful.arrays(texts), got, strict=True))
    assert forgetful.together.pairs.n <= 32 and len(forgetful.known) + len(forgetful.known.older) < 1000


def test_archives(spark):
    rng = random.Random(2)
    html = ["<p>" + " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(0, 200))) + "</p>" for _ in range(60)]
    rows = [(i, f"http://e.x/{i}?q=é\r\nX: 1", h) for i, h in enumerate(html)]
    rows += [(100, None, html[3]), (99, "u", html[3]), (101, "u", None), (102, "u", ""), (103, "u", "z" * 2_000_000), (3, "u", html[3]), (None, "u", html[5]), (None, "u", "alone")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n", F.lit(0))
    out = warc.archived(spark, df).toPandas()
    assert len(out) == len(rows)
    for r in out.itertuples():
        same = sorted(i for i, _, h in rows if i is not None and warc.digest((h or "").encode()) == r.payload_digest)
        first = same[0] if same else None
        page = None if np.isnan(r.page_id) else int(r.page_id)
        assert page == first or r.record_type == "revisit"
        assert (np.isnan(r.refers_to) if r.record_type == "response" else r.refers_to == first)
        if r.record_type == "response" and page is not None:
            assert r.html == (next(h for i, _, h in rows if i == page) or "")
    # each payload is held once, also where its first page is there twice
    held = out[(out["record_type"] == "response") & out["page_id"].notna()]
    assert held["payload_digest"].is_unique and set(held["payload_digest"]) == {warc.digest((h or "").encode()) for i, _, h in rows if i is not None}
    assert warc.archived(spark, df.limit(0)).count() == 0


def test_isotonic():
    at, levels = quality.isotonic(np.arange(6.0), np.array([0.1, 0.5, 0.2, 0.4, 0.9, 0.8]), np.array([1, 1, 3, 1, 1, 1.0]))
    assert (np.diff(levels) > 0).all() and levels[0] == pytest.approx(0.1) and levels[-1] == pytest.approx(0.85)
    assert np.interp(2, at, levels) <= 0.4


def test_quality(spark):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice(["this", "is", "plain", "prose", "about", "things"]) + rng.choice(["", "s", ","]) for _ in range(rng.randint(20, 60))) + "."
    bad = lambda: rng.choice(["SHOUT!! NOW!! ", "a| b| c| ", "x%%% y$$$ "]) * rng.randint(5, 30)
    rows = [(i, good() if i % 3 else bad(), None, None, 0) for i in range(500)] + [(900, None, None, None, 0), (901, "", None, None, 0), (901, "", None, None, 0)]
    df = spark.createDataFrame(rows, DOC)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(500)] + [(1, None, 0), (None, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.scored(df, labels).toPandas()
    assert len(out) == len(rows) and out["score"].between(0, 1).all()
    held = out[out["held_out"] & (out["doc_id"] < 500)]
    assert (held["predicted"] == (held["doc_id"] % 3 > 0)).mean() > 0.97
    assert set(quality.scored(df.limit(3), labels.limit(0)).toPandas()["score"]) == {0.5}
    assert quality.scored(df.limit(0), labels).count() == 0


def brute_base(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(x) for x in re.sub("[^0-9]", "", m[0])][::-1]
        if 12 <= len(d) <= 19 and sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans():
    rng = random.Random(8)
    for _ in range(6000):
        t = "".join(rng.choice(["a", "@", ".", "1", "25", "-", " ", "+", "(", "é", "@b.c", "4111 1111 1111 1111", "1.2.3.4", "_"]) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(t) == brute_base(t), t


def test_personal_data(spark):
    rng = random.Random(1)
    filler = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    rows = [(i, filler(30)) for i in range(200)]
    rows += [(300 + i, f"{filler(12)} contact Zanzibar office mary@corp.example today {filler(12)}") for i in range(5)]
    rows += [(400, None), (401, ""), (402, "1.2.3.4 and +1 (555) 010-9999"), (402, "1.2.3.4 and +1 (555) 010-9999")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rid", F.lit(1))
    out = pii.personal_data(df).collect()
    assert len(out) == len(rows)
    text = dict(rows)
    for r in out:
        base = brute_base(text[r["doc_id"]] or "")
        assert r["base_sha256"] == pii.digest(base)
        assert [r[f"n_{x}"] for x in pii.KINDS[:4]] == [sum(k == i for _, k, _ in base) for i in range(4)]
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        terms = {text[r["doc_id"]][int(a) : int(b)] for k, a, b in spans if k == "term"}
        assert len(spans) == len(base) + len(terms)
        assert terms == ({"contact", "Zanzibar", "office", "today"} if 300 <= r["doc_id"] < 305 else set())
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(df.dropDuplicates(["doc_id"])).collect()}
    assert "mary@corp.example" not in clean[300] and "Zanzibar" not in clean[300] and "[email]" in clean[300] and clean[0] == text[0]
    assert pii.personal_data(df.limit(0)).count() == 0


def test_personal_data_of_the_table_is_what_the_patterns_say(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = {r["doc_id"]: r for r in pii.personal_data(docs).collect()}
    some = 0
    for d in docs.select("doc_id", "text").collect():
        base, r = brute_base(d["text"] or ""), out[d["doc_id"]]
        n = [sum(k == i for _, k, _ in base) for i in range(4)]
        assert [r[f"n_{x}"] for x in pii.KINDS[:4]] == n and r["base_sha256"] == pii.digest(base)
        some += sum(n) > 1
    assert some > 10


def test_disclosing_terms_are_spanned_throughout(spark):
    rng = random.Random(3)
    filler = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    rows = [(i, filler(30)) for i in range(200)]
    # a name of three letters, a word behind padding, and both again 40 words later
    rows += [(300 + i, f"{filler(12)} Lee {'-' * 500} Zanzibar mary@corp.example {'|' + ' ' * 600} Harbour {filler(40)} Zanzibar and Lee at Harbour") for i in range(5)]
    # a text that holds the entity with the terms far from it only
    rows += [(400, f"mary@corp.example {filler(40)} Zanzibar"), (401, f"mary@corp.example {filler(40)}")]
    # a text that does not name the entity, but holds a term that only texts with it have
    rows += [(500 + i, f"{filler(12)} anna@sea.example Lighthouse {filler(12)}") for i in range(8)] + [(402, f"{filler(20)} Lighthouse {filler(20)}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(df).collect()}
    for i in (300, 301, 302, 303, 304, 400):
        assert "[email]" in clean[i] and not any(x in clean[i] for x in ("Lee", "Zanzibar", "Harbour", "mary"))
    assert "Lighthouse" not in clean[402] and clean[402].split()[:20] == dict(rows)[402].split()[:20]
    assert clean[0] == dict(rows)[0] and clean[401] == dict(rows)[401].replace("mary@corp.example", "[email]")


def test_other_languages_and_junk_are_rejected(spark):
    rng = random.Random(6)
    kinds = {"xx": "the and of that with ing ed".split(), "yy": "der die und nicht ein ung".split()}
    rows = [(i, " ".join(rng.choice(kinds[k]) + rng.choice(["", "er", "en"]) for _ in range(60)), k, None, 0) for i in range(600) for k in ["xx" if i % 2 else "yy"]]
    # rows of the sample that are junk, labelled as a language
    rows += [(1000 + i, w, "xx", None, 0) for i, w in enumerate(["q", "zzz 9", "\u4e00\u4e8c " * 30])]
    df = spark.createDataFrame(rows, DOC)
    letters = {"latin": "abcdefghijklmnopqrstuvwxyz", "hex": "0123456789abcdef", "han": "".join(chr(0x4E00 + i) for i in range(2000)), "cyrillic": "\u0430\u0431\u0432\u0433\u0434\u0435\u0436\u0437\u0438\u043a\u043b\u043c\u043d\u043e\u043f\u0440"}
    other = [(2000 + 50 * n + i, " ".join("".join(rng.choice(a) for _ in range(rng.randint(3, 9))) for _ in range(60))) for n, a in enumerate(letters.values()) for i in range(50)]
    model = langid.learned(df)
    out = {r["doc_id"]: r["rejected"] for r in langid.predict(spark.createDataFrame(other, "doc_id long, text string").union(df.select("doc_id", "text")), model).collect()}
    assert np.mean([out[i] for i, _ in other]) >= 0.98
    assert np.mean([out[i] for i in range(600)]) <= 0.01


def test_other_kinds_of_models_are_refused(tmp_path, monkeypatch):
    import sentencepiece

    assert sentencepiece_codec.model_kind(b"") == 1 and sentencepiece_codec.model_kind(b"\x12\x04\x12\x00\x18\x02") == 2
    # a field of that number that holds bytes is another field
    assert sentencepiece_codec.model_kind(b"\x12\x04\x1a\x00\x18\x02") == 2
    unigram = type("Unigram", (), {"__init__": lambda self, model_file: None, "serialized_model_proto": lambda self: b"\x12\x02\x18\x01"})
    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", unigram)
    with pytest.raises(ValueError, match="BPE"):
        sentencepiece_codec.Pieces()


BIG = 2**53 + 1


def test_ids_stay_exact(spark):
    """Ids beyond 2^53, beside a null one, through every operator that runs Python."""
    text = [("plain words of a text that says something " * 3 + str(i)) for i in range(4)]
    rows = [(BIG, text[0], "en"), (BIG + 2, text[1], "en"), (None, text[2], "en"), (7, "½ ² ① Ⅷ", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = sorted([BIG, BIG + 2, 7, -1])
    ids = lambda out: sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in out.select("doc_id").collect())
    found = langid.predict(df, langid.learned(df))
    assert ids(found) == want and {r["doc_id"]: r["lang_pred"] for r in found.collect()}[7] == "und"
    assert ids(langid.identified(df)) == sorted([BIG, BIG + 2, -1])
    assert ids(sentencepiece_codec.encoded(df)) == want
    assert ids(sentencepiece_codec.decoded(sentencepiece_codec.encoded(df))) == want
    labels = spark.createDataFrame([(BIG, 1), (BIG + 2, 0)], "doc_id long, quality int")
    assert ids(quality.scored(df, labels)) == want
    assert ids(pii.personal_data(df)) == want and ids(pii.sanitised(df)) == want
    assert ids(mixing.mix(df.withColumn("source", F.lit(None).cast("string")))) == want


def test_payloads_of_large_ids_are_archived_once(spark):
    rows = [(BIG, "u", "<p>same</p>"), (BIG + 2, "u", "<p>same</p>"), (None, "u", "<p>same</p>"), (5, "u", "<p>own</p>")]
    out = {r["page_id"]: r for r in warc.archived(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert set(out) == {BIG, BIG + 2, None, 5}
    assert out[BIG]["record_type"] == "response" and out[BIG]["html"] == "<p>same</p>" and out[BIG]["refers_to"] is None
    assert all(out[i]["record_type"] == "revisit" and out[i]["refers_to"] == BIG for i in (BIG + 2, None))


def test_rows_that_repeat_meet_the_target(spark):
    """A source that is one row a thousand times comes within one document of its target, and its rows stay rows."""
    rows = [("r", "w " * 10, "b", i) for i in range(1000)] + [(f"x{i}", "w " * 20, "a", 0) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string, n int").repartition(6)
    out = mixing.mix(df).toPandas()
    assert len(out) == 1500
    for s, part in out.assign(s=out["doc_id"].str[0]).groupby("s"):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) < (10 if s == "r" else 20)
        assert part["copies"].max() - part["copies"].min() <= 1
    mixed = mixing.mixed_documents(df)
    n = mixed.groupBy("source", "n").count().toPandas()
    assert n[n["source"] == "b"]["count"].sum() * 10 == out[out["doc_id"] == "r"]["taken"].sum()
    # each row is taken once or twice, none instead of another
    assert set(n[n["source"] == "b"]["count"]) == {1, 2} and len(n[n["source"] == "b"]) == 1000


def test_mixed_documents_take_each_source_apart(spark):
    rows = [(1, "w " * 10, "a"), (1, "w " * 10, "b"), (2, "w " * 30, "a"), (3, "x", None), (3, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copies", F.lit("x"))
    want = {(r["doc_id"], r["source"]): r["copies"] for r in mixing.mix(df).collect() if r["size"]}
    got = {(r["doc_id"], r["source"]): r["count"] for r in mixing.mixed_documents(df).where("text IS NOT NULL").groupBy("doc_id", "source").count().collect()}
    assert got == {k: n for k, n in want.items() if n}
    assert mixing.mixed_documents(df).columns == df.columns
