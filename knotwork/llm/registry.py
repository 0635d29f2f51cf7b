"""Queries of the corpus operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

import re
import secrets
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm import bpe_trie, jaccard, langid, licenses, mixing, pii, quality, token_counts, topk, vector_codes, vector_dedup, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Where spark.knotwork.pii.key is unset, as in tests. It protects nothing: it is in the sources.
TEST_KEY = "key of tests"


def pii_key(spark: SparkSession) -> str:
    """The secret key of pseudonyms, from the session's settings.

    Without one, local masters take a fixed key, for tests; on a cluster a key is drawn by chance, once per application: the same values
    get the same pseudonyms in all its queries, other pseudonyms in another application, and nobody can reverse them.
    """
    sc = spark.sparkContext
    if key := spark.conf.get("spark.knotwork.pii.key", None):
        return key
    if sc.master.startswith("local"):
        return TEST_KEY
    if not getattr(sc, "_knotwork_pii_key", None):
        sc._knotwork_pii_key = secrets.token_hex(32)
    return sc._knotwork_pii_key


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with pseudonyms, n_found."""
    x = pii.pseudonymised(_table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark), findings="found")
    return x.select("doc_id", "text", F.size("found").cast("long").alias("n_found"))


def op2_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    return vector_dedup.deduplicated(_table(spark, sf_dir, "embeddings"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe_trie.encoded(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return quality.classified(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score; queries are the ids divisible by 100."""
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    return jaccard.joined(_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as read back from the archives."""
    return warc.archive_round_trip(_table(spark, sf_dir, "pages")).drop("url", "payload")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    return langid.identified(_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, n_edits, n_tokens_edited, n_reencoded, for a script of edits drawn from each id."""
    edited = token_counts.edit_script(_table(spark, sf_dir, "documents"))
    return token_counts.counted(edited, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    return vector_codes.coded(_table(spark, sf_dir, "embeddings"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    return licenses.scanned(_table(spark, sf_dir, "documents")).drop("found")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error."""
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_vector_dedup": op2_vector_dedup,
    "op3_bpe": op3_bpe,
    "op4_quality": op4_quality,
    "op5_topk": op5_topk,
    "op6_jaccard": op6_jaccard,
    "op7_warc": op7_warc,
    "op8_langid": op8_langid,
    "op9_mixing": op9_mixing,
    "op10_token_counts": op10_token_counts,
    "op11_vector_codes": op11_vector_codes,
    "op12_licenses": op12_licenses,
    "op13_whitening": op13_whitening,
}


def _codes_sql(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, rounds: int = vector_codes.ROUNDS, scale: int = vector_codes.SCALE) -> str:
    """Lloyd rounds as a chain of tables, over all parts of all vectors instead of the distinct ones."""
    ctes = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, label, vec_id, list_transform(embedding, lambda c: CAST(floor({scale} * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), p AS MATERIALIZED (SELECT r, pos, x[pos * (len(x) // {parts}) + 1:(pos + 1) * (len(x) // {parts})] AS part FROM v, range({parts}) t(pos)),
b0 AS MATERIALIZED (SELECT pos, r - 1 AS e, part AS book FROM p WHERE r <= {entries})"""
    ]
    for i in range(rounds + 1):
        ctes.append(f"""a{i} AS MATERIALIZED (
  SELECT r, pos, part, min((d, e)) AS m FROM (
    SELECT r, p.pos, part, e, list_sum(list_transform(list_zip(part, book), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN b{i} b ON b.pos = p.pos) GROUP BY r, pos, part
)""")
        if i < rounds:
            ctes.append(f"""b{i + 1} AS MATERIALIZED (
  SELECT pos, e, coalesce(fresh, book) AS book FROM b{i} LEFT JOIN (
    SELECT pos, e, list(mean ORDER BY place) AS fresh FROM (
      SELECT pos, m[2] AS e, place, CAST(floor(CAST(sum(part[place]) AS DOUBLE) / count(*)) AS BIGINT) AS mean FROM (SELECT *, unnest(range(1, len(part) + 1)) AS place FROM a{i}) GROUP BY 1, 2, 3) GROUP BY pos, e) USING (pos, e)
)""")
    ctes.append(f"""c AS (SELECT r, string_agg(printf('%02x', m[2]), '' ORDER BY pos) AS code, CAST(sum(m[1]) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(book, ','), ',' ORDER BY pos, e)) AS codebooks_sha256 FROM b{rounds})""")
    return "WITH " + ",\n".join(ctes) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN v USING (r), h"


def _licenses_sql() -> str:
    """Base places by the definition, word by word; labels of other templates by votes."""
    words = lambda text: re.findall(licenses.WORD, text.lower())
    listed = lambda w: "[" + ", ".join(f"'{x}'" for x in w) + "]"
    base = ", ".join(f"('{label}', {listed(words(text))})" for text, label in licenses.PHRASES.items())
    others = ", ".join(f"({i}, '{label}', {listed(words(text))})" for i, (label, text) in enumerate(licenses.TEMPLATES))
    k, drift = licenses.GRAM, licenses.DRIFT
    return rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '{licenses.WORD}') AS w FROM documents
), phrase(label, p) AS (VALUES {base}), template(t, label, p) AS (VALUES {others}),
place AS (SELECT r, label, i FROM (SELECT r, w, label, p, unnest(range(0, len(w) - len(p) + 1)) AS i FROM d, phrase) WHERE w[i + 1:i + len(p)] = p),
b AS (SELECT r, CAST(count(*) AS BIGINT) AS n_base, CAST(min(i) AS BIGINT) AS first_word, CAST(max(i) AS BIGINT) AS last_word, list(DISTINCT label) AS labels FROM place GROUP BY r),
g AS (SELECT r, a, array_to_string(w[a + 1:a + {k}], ' ') AS gram FROM (SELECT r, w, unnest(range(0, len(w) - {k - 1})) AS a FROM d)),
h AS (SELECT t, label, n, i, array_to_string(p[i + 1:i + {k}], ' ') AS gram FROM (SELECT t, label, p, len(p) - {k - 1} AS n, unnest(range(0, len(p) - {k - 1})) AS i FROM template)),
dg AS (SELECT r, t, label, n, a - i AS diagonal, count(*) AS votes, min(a) AS f, max(a) AS l FROM g JOIN h USING (gram) GROUP BY r, t, label, n, a - i),
x AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o <= {drift} AND f - lag(l) OVER o <= {drift + k} AND lag(f) OVER o - l <= {drift + k} THEN 0 ELSE 1 END AS apart FROM dg WINDOW o AS (PARTITION BY r, t ORDER BY diagonal)),
y AS (SELECT *, sum(apart) OVER (PARTITION BY r, t ORDER BY diagonal) AS span FROM x),
z AS (SELECT r, label, least(1.0, CAST(sum(votes) AS DOUBLE) / n) AS cover FROM y GROUP BY r, t, label, n, span HAVING CAST(sum(votes) AS DOUBLE) / n >= {licenses.COVER} AND max(l) - min(f) < n + {drift}),
m AS (SELECT r, list(DISTINCT label) AS labels, max(cover) AS cover FROM z GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ',') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(cover, 0.0) END AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN m USING (r)"""




#: SQL where it can express the operator as a whole.
ORACLE: dict[str, str] = {
    "op2_vector_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), n AS (SELECT *, sqrt(list_sum(list_transform(x, lambda c: c * c))) AS norm FROM v),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id
  WHERE list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2])) / (a.norm * b.norm) >= 0.93
), reach(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, c FROM reach JOIN l ON l.a = id WHERE c < l.b),
c AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id), k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.id = vec_id LEFT JOIN k ON k.a = vec_id""",
    "op6_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
reach(id, low) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, low FROM reach JOIN l ON l.a = id WHERE low < l.b),
m AS (SELECT id, min(low) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM documents d JOIN m ON m.id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id""",
    "op5_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p),
k AS (SELECT payload_digest, max(page_id) AS kept FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN kept IS NOT NULL AND d.page_id IS DISTINCT FROM kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN kept IS NOT NULL AND d.page_id IS DISTINCT FROM kept THEN kept END AS refers_to
FROM d LEFT JOIN k USING (payload_digest)""",
    "op11_vector_codes": _codes_sql(),
    "op12_licenses": _licenses_sql(),
}
