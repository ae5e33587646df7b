"""Personal data: patterns find protected entities, corpus co-occurrence finds the terms that disclose them."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import TEXTS, of_texts, stored, with_texts

KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a run of digits that failed fails from each of its digits, so only its first is tried
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TERM = re.compile(r"[^\W_]{2,}")

#: Documents in which an entity and a term must meet before the term can disclose it.
SUPPORT = 3
#: Share of the entity's information that a term may reveal.
DISCLOSURE = 0.8
#: The share beyond which a term goes from texts that do not name the entity as well.
ELSEWHERE = 0.95
#: First letters that stand for a term when it is generalised.
STEM = 3
#: Bits of the filter of candidate terms; it only spares work, the exact join follows.
FILTER_BITS = 1 << 23
#: Terms that a task counts before it passes its counts on.
FLUSH = 500_000


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @: what precedes it is one run of local characters."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def luhn(digits: str) -> bool:
    odd = sum(int(x) for x in digits[-1::-2])
    even = sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])
    return (odd + even) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end), ordered, of every pattern that holds in the whole text."""
    out = [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(x.isdigit() for x in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def key(kind: str, value: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind}:{value}".encode("utf-8", "replace")) - (1 << 63)


def entities(text: str, spans: list[tuple[int, int, int]]) -> set[int]:
    """What the base spans of a text name: each value, and the domain of an email, which is an entity of its own."""
    out = set()
    for start, kind, end in spans:
        value = text[start:end].lower() if kind == 0 else re.sub(r"[^0-9.]" if kind == 1 else "[^0-9]", "", text[start:end])
        out.add(key(KINDS[kind], value))
        if kind == 0:
            out.add(key("domain", value.rpartition("@")[2]))
    return out


def free_terms(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, term), ordered, of the terms of the whole text, none of which lies in an entity."""
    out, k, covered = [], 0, 0
    for m in TERM.finditer(text):
        while k < len(spans) and spans[k][0] < m.end():
            covered = max(covered, spans[k][2])
            k += 1
        if covered <= m.start():
            out.append((m.start(), m.end(), m[0].lower()))
    return out


def words(text: str) -> set[str]:
    return set(map(str.lower, set(TERM.findall(text))))


def stem_key(word: str) -> int:
    """A word no longer than its stem would stay whole, so it counts as its own stem, which tells what it tells."""
    return key("stem", word[:STEM]) if len(word) > STEM else key("term", word)


def protected(docs: DataFrame) -> DataFrame:
    """(entities, terms) of each row that has base spans: what it names, and every term of its whole text with its stem."""

    def of(texts: list[str | None]) -> dict:
        base = [base_spans(t) if t else [] for t in texts]
        own = [sorted(entities(t, x)) if x else None for t, x in zip(texts, base, strict=True)]
        terms = [[{"term": key("term", w), "stem": stem_key(w)} for w in {w for _, _, w in free_terms(t, x)}] if x else None for t, x in zip(texts, base, strict=True)]
        return {"entities": own, "terms": terms}

    pair = pa.struct([("term", pa.int64()), ("stem", pa.int64())])
    return with_texts(docs, [], of, {"entities": pa.list_(pa.int64()), "terms": pa.list_(pair)}).where("entities IS NOT NULL")


def filter_bits(cells: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, set where the longs h of cells, modulo their number, are."""
    words = cells.select(F.pmod("h", F.lit(FILTER_BITS)).alias("c")).groupBy(F.floor(F.col("c") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(c % 64 AS INT))")).alias("b"))
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    for r in words.toLocalIterator():
        bits[r["w"]] = r["b"] & 0xFFFFFFFFFFFFFFFF
    return bits


def term_counts(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(h, n): in how many rows of docs each candidate (h) occurs, counted over all whole texts.

    Tasks skip what a filter of FILTER_BITS bits, built from the candidates, shows to be none; its size is
    fixed, however many candidates there are.
    """
    bits = filter_bits(candidates)

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def passed(h: int) -> bool:
            c = h % FILTER_BITS
            return bool(int(bits[c >> 6]) >> (c & 63) & 1)

        known: dict[str, int] = {}
        n: Counter = Counter()
        frame = lambda n: pd.DataFrame({"h": list(n), "n": list(n.values())}).astype("int64")
        for p in parts:
            for t in p["text"]:
                if isinstance(t, str):
                    own = words(t)
                    for kind, some in (("term", own), ("stem", {w[:STEM] for w in own})):
                        for w in some:
                            name = kind[0] + w
                            h = known.get(name)
                            if h is None:
                                h = key(kind, w)
                                known[name] = h = h if passed(h) else 0
                            if h:
                                n[h] += 1
                if len(known) > FLUSH:
                    known.clear()
                if len(n) > FLUSH:
                    yield frame(n)
                    n.clear()
        yield frame(n)

    return of_texts(docs).select("text").mapInPandas(of, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def disclosing(docs: DataFrame) -> DataFrame:
    """(h, entity, action, everywhere): the terms that disclose an entity of the corpus by more than DISCLOSURE, or ELSEWHERE.

    A term t discloses an entity e by PMI(t; e) / IC(e), where IC(e) = -log2 p(e); all probabilities are shares of
    documents. It is 1 if whoever reads t knows e. Terms that meet e in fewer than SUPPORT documents say nothing.
    `generalise` if the term's stem stays under the threshold, else `remove`.
    """
    n_docs = docs.count()
    rows = stored(protected(docs).withColumn("rid", F.monotonically_increasing_id()), "protected")
    n_entity = stored(rows.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= SUPPORT), "entities")
    # only entities that recur can meet a term often enough
    named = rows.select("rid", F.explode("entities").alias("entity")).join(n_entity.select("entity"), "entity")
    pairs = named.join(rows.select("rid", "terms"), "rid").select("entity", F.explode("terms").alias("x"))
    joint = pairs.groupBy("entity", "x.term", "x.stem").agg(F.count("*").alias("n_te")).where(F.col("n_te") >= SUPPORT)
    # a text has each of its terms once, but a stem for each term that begins so
    by_stem = named.join(rows.select("rid", F.array_distinct("terms.stem").alias("stems")), "rid").select("entity", F.explode("stems").alias("stem"))
    by_stem = by_stem.groupBy("entity", "stem").agg(F.count("*").alias("n_se")).where(F.col("n_se") >= SUPPORT)
    # in how many of these rows a term is bounds from below in how many of all; the common words need no further count
    here = rows.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("n_here")).where(F.col("n_here") >= SUPPORT)
    may = F.col("n_here") < F.col("n_te") * F.pow(F.lit(float(n_docs)) / F.col("n_e"), F.lit(1 - DISCLOSURE)) + 1
    joint = stored(joint.join(n_entity, "entity").join(here, "term").where(may).join(by_stem, ["entity", "stem"]).drop("n_here"), "joint")
    counts = stored(term_counts(docs, joint.select(F.explode(F.array("term", "stem")).alias("h")).distinct()), "term-counts")
    of = lambda c: counts.select(F.col("h").alias(c), F.col("n").alias(f"n_{c}"))
    bits = F.greatest(F.log2(F.lit(float(n_docs)) / F.col("n_e")), F.lit(1e-9))
    tells = lambda both, alone: F.log2(F.col(both) * F.lit(float(n_docs)) / (F.col(alone) * F.col("n_e"))) / bits
    told = joint.join(of("term"), "term").join(of("stem"), "stem").withColumn("share", tells("n_te", "n_term")).where(F.col("share") > DISCLOSURE)
    return told.select(F.col("term").alias("h"), "entity", F.when(tells("n_se", "n_stem") > DISCLOSURE, "remove").otherwise("generalise").alias("action"), (F.col("share") > ELSEWHERE).alias("everywhere"))


SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
PLACE = pa.struct([("h", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])


def spanned(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of every row of docs with __base, its base spans, and __all, all its spans and their actions.

    Each text is looked through for every disclosing term. A filter of fixed size shows what may be one; the
    join with the terms by their hash then decides.
    """
    told = stored(disclosing(docs), "disclosing")
    bits = filter_bits(told.select("h"))
    some = bool(bits.any())

    def of(texts: list[str | None]) -> dict:
        base = [base_spans(t) if t else [] for t in texts]
        places: list[list[dict]] = []
        for t, x in zip(texts, base, strict=True):
            here = []
            if t and some:
                own = list(words(t))
                h = np.array([key("term", w) for w in own], np.int64)
                c = h % FILTER_BITS
                may = {own[i]: int(h[i]) for i in np.flatnonzero(bits[c >> 6] >> (c & 63).astype(np.uint64) & np.uint64(1))}
                here = [{"h": may[w], "start": a, "end": b} for a, b, w in free_terms(t, x) if w in may] if may else []
            places.append(here)
        own = [sorted(entities(t, x)) if x else [] for t, x in zip(texts, base, strict=True)]
        return {"__base": [[{"start": a, "kind": k, "end": b} for a, k, b in x] for x in base], "__own": own, "__places": places}

    rows = stored(with_texts(docs, keep, of, {"__base": pa.list_(SPAN), "__own": pa.list_(pa.int64()), "__places": pa.list_(PLACE)}).withColumn("__rid", F.monotonically_increasing_id()), "spanned")
    places = rows.select("__rid", "__own", F.explode("__places").alias("x")).select("__rid", "__own", "x.*")
    anywhere = places.join(told.where("everywhere").groupBy("h").agg(F.max("action").alias("action")), "h").drop("__own")
    named = places.where(F.size("__own") > 0).join(told, "h").where(F.array_contains("__own", F.col("entity"))).select(*anywhere.columns)
    # of several entities the one for which the term has to go decides: 'remove' is the greater
    more = anywhere.union(named).groupBy("__rid", "start", "end").agg(F.max("action").alias("action"))
    more = more.groupBy("__rid").agg(F.collect_list(F.struct("start", F.lit(4).alias("kind"), "end", "action")).alias("__more"))
    base = F.transform("__base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit("remove").alias("action")))
    spans = F.array_sort(F.concat(base, F.coalesce("__more", F.array().cast("array<struct<start:int,kind:int,end:int,action:string>>"))))
    return rows.join(more, "__rid", "left").withColumn("__all", spans).select(*keep, "__base", "__all")


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, counts of the base kinds, base_sha256, spans, and the spans as an array.

    Base spans follow the patterns. Words of two letters or digits and more that disclose an entity over the
    corpus, as `disclosing` has it, are spans of kind `term` wherever they stand in a text that names it, and in all
    other texts too if they tell nearly all: whoever reads them there can tell. A null text counts as empty; repeated rows count as documents of their
    own, with a null id too; an empty table gives an empty result; texts are read whole, however long; other
    columns play no part.
    """
    out = spanned(docs, ["doc_id"])
    name = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")
    of_kind = lambda k: lambda s: s["kind"] == k  # noqa: E731  a second parameter of a filter would be the index
    counts = [F.size(F.filter("__base", of_kind(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    return out.select("doc_id", *counts, F.sha2(joined(F.col("__base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("__all")).alias("spans"), F.col("__all").alias("span_list"))


def sanitised(docs: DataFrame) -> DataFrame:
    """docs with the spans of personal_data taken out of text: base kinds become [kind], terms their stem or nothing."""
    columns = docs.columns

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                part = b.slice(at, TEXTS)
                texts = pa.array([cleaned(t, s) for t, s in zip(part.column("text").to_pylist(), part.column("__all").to_pylist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([texts if c == "text" else part.column(c) for c in columns], columns)

    return spanned(docs, columns).select(*columns, "__all").mapInArrow(of, docs.schema)


def cleaned(text: str | None, spans) -> str | None:
    if not isinstance(text, str):
        return text
    out, at = [], 0
    for s in spans:
        if s["end"] <= at:
            continue
        out.append(text[at : max(at, s["start"])])
        at = s["end"]
        if s["kind"] < 4:
            out.append(f"[{KINDS[s['kind']]}]")
        elif s["action"] == "generalise":
            out.append(text[s["start"] : s["start"] + STEM] + "*")
    return "".join([*out, text[at:]])


def digest(spans: list[tuple[int, int, int]]) -> str:
    """base_sha256 of base spans, as a plain restatement for tests."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
