"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.llm import bpe, ego_join, line_rules, mixing, quality_cnn, simhash, suffix_dedup, token_counts, toxicity, warc
from keyfold.llm.common import fold, read_table, ready

#: Target shares of the domains (languages) of documents.
DOMAIN_WEIGHTS = {"en": 0.55, "fr": 0.15, "de": 0.15, "es": 0.15}
LEAST_SCORE = 0.3
RANKS = "byte_bpe_50k.tiktoken"


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego_join.near_duplicates(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.95)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), "doc_id", "text", width=4, bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def _scored(documents: DataFrame, scores: DataFrame, held_out) -> DataFrame:
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"), *[c for c in scores.columns if c not in ("doc_id", "score")])


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = toxicity.fit(documents, "doc_id", "text", labels.withColumnRenamed("toxic", "label"), "label", lambda _: fold("id", 4) != 2)
    scores = toxicity.score(documents, "doc_id", "text", model)
    worst = F.expr("array_max(transform(offending, x -> struct(x.score as score, -x.start as first, x.`end` as last)))")
    scores = scores.select("doc_id", "score", "n_sentences", F.size("offending").alias("n_offending"), worst.alias("worst"))
    scores = scores.select("doc_id", "score", "n_sentences", "n_offending", (-F.col("worst.first")).alias("worst_start"), F.col("worst.last").alias("worst_end"))
    return _scored(documents, scores, fold("doc_id", 4) == 2)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"), "doc_id", "text").drop("kept")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archive(read_table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return warc.read_records(index, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def quality_model(spark: SparkSession, documents: DataFrame, sf_dir: str) -> quality_cnn.QualityModel:
    return quality_cnn.fit(documents, "doc_id", "text", read_table(spark, sf_dir, "labels"), "quality", lambda _: fold("id", 5) != 0)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    scores = quality_cnn.score(documents, "doc_id", "text", quality_model(spark, documents, sf_dir))
    return _scored(documents, scores, fold("doc_id", 5) == 0)


def mixed(spark: SparkSession, documents: DataFrame, sf_dir: str, least_rate: float) -> DataFrame:
    """Rates of ``documents`` for DOMAIN_WEIGHTS; the labelled table is the documents that ``labels`` covers."""
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_labelled")).distinct()
    labelled = documents.join(labels, F.col("doc_id") == F.col("_labelled"), "left_semi").select("text", F.col("lang").alias("domain"))
    return mixing.mix(documents, "doc_id", "text", labelled, "domain", DOMAIN_WEIGHTS, least_rate=least_rate)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark, read_table(spark, sf_dir, "documents"), sf_dir, 0.0).drop("text_hash")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.apply_rules(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read_table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def _with_path(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(ready(spark), sf_dir)


QUERIES = {
    q.__name__: _with_path(q)
    for q in (op1_embedding_dedup, op2_simhash, op3_token_counts, op4_toxicity, op5_suffix_dedup, op6_warc, op7_quality, op8_mixing, op9_quality_rules, op10_bpe)
}

SQL = {
    "op1_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT vec_id, e FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, least.component_id, v.vec_id = least.component_id AS kept
FROM v JOIN least ON least.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
""",
    "op6_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS leader FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > leader THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > leader THEN leader END AS refers_to, true AS intact
FROM f
""",
    "op9_quality_rules": rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), bad AS (
  SELECT doc_id, lines, list_filter(lines, lambda x: (length(x) - length(translate(x, '{line_rules.SYMBOLS}!', ''))) * {line_rules.CHARS_PER_MARK} > length(x)
    OR regexp_matches(x, '{line_rules.NAVIGATION}') OR regexp_matches(x, '{line_rules.BOILERPLATE}')) AS bad FROM l
), u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
x AS (
  SELECT doc_id, pos, word || ' ' || lead(word, 1) OVER s || ' ' || lead(word, 2) OVER s || ' ' || lead(word, 3) OVER s || ' ' || lead(word, 4) OVER s AS win
  FROM u WINDOW s AS (PARTITION BY doc_id ORDER BY pos)
), twice AS (SELECT doc_id, pos FROM x WHERE win IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
r AS (SELECT doc_id, count(DISTINCT pos + k) AS n FROM twice, range(5) AS g(k) GROUP BY doc_id),
o AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(t) - length(translate(t, '{line_rules.SYMBOLS}', '')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
    len(bad) AS n_lines_removed, length(regexp_replace(array_to_string(bad, ''), '[\x20\x09-\x0D]', '', 'g')) AS chars_removed
  FROM d JOIN bad USING (doc_id) LEFT JOIN r ON r.doc_id = d.doc_id
), f AS (SELECT *, n_words < {line_rules.LEAST_WORDS} OR 100 * n_repeat_words > {line_rules.MOST_REPEATED_PERCENT} * n_words AS base_failed FROM o)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND chars_removed * 100 <= word_chars * {line_rules.MOST_LOST_PERCENT} AS kept, n_lines_removed, chars_removed
FROM f
""",
}
