"""The queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import ann, exact_dedup, importance, langid, mixing, ngram_join, pii, quality, sentencepiece_codec, substring, token_files, warc, whitening
from .shared import held_out, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), langid.learned(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, percent=90)


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann.usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return ann.search(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archived(spark, table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("span_list")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS x
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(x) = 0 THEN [] WHEN len(x) < 3 THEN [array_to_string(x, ' ')]
    ELSE list_distinct(list_transform(range(1, len(x) - 1), lambda i: concat_ws(' ', x[i], x[i + 1], x[i + 2]))) END AS g
  FROM w),
t AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, m.c AS component_id,
  count(*) OVER (PARTITION BY CASE WHEN len(s.g) > 0 THEN list_sort(s.g) ELSE [CAST(s.doc_id AS VARCHAR)] END) AS class_size
FROM s JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = s.doc_id
"""

OP5_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
             regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id ASC NULLS LAST)
"""

OP8_SQL = r"""
WITH RECURSIVE p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT h, min(page_id) AS f, sha1(h) AS x FROM p GROUP BY h),
b AS (SELECT x, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
        (instr('0123456789abcdef', substr(x, 1 + i * 5 // 4, 1)) - 1) * 16 + instr('0123456789abcdef0', substr(x || '0', 2 + i * 5 // 4, 1)) - 1 AS INT)
        // CAST(pow(2, 3 - i * 5 % 4) AS INT) % 32, 1), '' ORDER BY i) AS digest
      FROM (SELECT DISTINCT x FROM d), range(32) t(i) GROUP BY x)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = f THEN NULL ELSE f END AS refers_to
FROM p JOIN d USING (h) JOIN b USING (x)
"""

OP12_SQL = r"""
WITH table_bits AS (
  SELECT list(x ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS x FROM range(256) r(i))),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS w FROM d),
bw AS (SELECT unnest(w) AS w FROM b),
hex_of AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
bytes_of AS (
  SELECT w, list_transform(range(length(x) // 2), lambda i: 16 * (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) + instr('0123456789ABCDEF', x[2 * i + 2]) - 1) AS y FROM hex_of),
h AS (SELECT w, xor(list_reduce(list_prepend(4294967295, y), lambda c, k: xor(c >> 8, t[1 + (xor(c, k) & 255)])), 4294967295) % 10000 AS h FROM bytes_of, table_bits),
s AS (SELECT h, count(*) AS s FROM dw JOIN h USING (w) GROUP BY h),
t AS (SELECT h, count(*) AS t FROM bw JOIN h USING (w) GROUP BY h),
g AS (
  SELECT h, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000) AS DOUBLE) / CAST((s + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000) AS DOUBLE))) AS BIGINT) AS g
  FROM s LEFT JOIN t USING (h)),
m AS (SELECT doc_id, count(*) AS n, CAST(floor(sum(g) / count(*)) AS BIGINT) AS weight FROM dw JOIN h USING (w) JOIN g USING (h) GROUP BY doc_id),
u AS (SELECT doc_id, CAST('0x' || substr(sha256('2024:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS u FROM documents),
z AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((u + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM u LEFT JOIN m USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM z WHERE n_features >= 20)
SELECT z.doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) * 10 // 100 FROM r) THEN rank END AS rank FROM z LEFT JOIN r USING (doc_id)
"""

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_language": op2_language,
    "op3_ngram_join": op3_ngram_join,
    "op4_nearest": op4_nearest,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_passages": op6_passages,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_warc": op8_warc,
    "op9_quality": op9_quality,
    "op10_pii": op10_pii,
    "op11_token_files": op11_token_files,
    "op12_importance": op12_importance,
    "op13_whitening": op13_whitening,
}
ORACLE_SQL = {"op8_warc": OP8_SQL, "op3_ngram_join": OP3_SQL, "op5_exact_dedup": OP5_SQL, "op12_importance": OP12_SQL}
