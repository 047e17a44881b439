"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabspark.functions.scratch import scratch_path
from tabspark.llm import (best_fit, embeddings, licenses, merkle, packing, pieces, pii, quality, quality_rules, resampling,
                          simhash, token_store, toxicity)
from tabspark.llm.common import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents, write the files, and take every figure from what they hold."""
    path = scratch_path(spark, "tokens")
    token_store.write_tokens(table(spark, sf_dir, "documents"), path, BYTE_BPE)
    return token_store.token_checksums(spark, path)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per piece, from the packed sequences of all documents."""
    return packing.piece_digests(packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, and its offending spans as start:end."""
    found = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    written = F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return found.select("doc_id", "held_out", "score", "predicted", F.array_join(written, ",").alias("toxic_spans"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again: counts, checksum of the ids, hash of the decoded text."""
    encoded = pieces.encode(table(spark, sf_dir, "documents"), PIECES)
    return pieces.digests(pieces.decode(encoded, PIECES))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.private_digests(pii.find_private(table(spark, sf_dir, "documents")))


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per piece, from the packed sequences of all documents."""
    return best_fit.piece_digests(best_fit.pack_best_fit(table(spark, sf_dir, "documents"), WORD_BPE))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents, checked against documents of which some lost their line breaks."""
    docs = table(spark, sf_dir, "documents")
    without = F.when(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0,
                     F.translate("text", "\n", "")).otherwise(F.col("text"))
    found = merkle.manifest(docs, altered={"text": without})
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five in a hundred documents, likelier the more they resemble the benchmark."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_token_store, op2_packing, op3_toxicity, op4_quality_rules, op5_license_scan, op6_sentencepiece, op7_simhash,
    op8_near_vectors, op9_quality_classifier, op10_private_data, op11_best_fit,
    op12_manifest, op13_resample)}


def _rules_sql() -> str:
    fails = []
    for r in quality_rules.RULES:
        by = "1" if r.denominator == "one" else r.denominator
        parts = [f"{by} = 0"]
        if r.low is not None:
            parts.append(f"{r.scale} * {r.numerator} < {r.low} * {by}")
        if r.high is not None:
            parts.append(f"{r.scale} * {r.numerator} > {r.high} * {by}")
        fails.append((f"fails_{r.name}", " OR ".join(parts)))
    stop = ", ".join(f"'{w}'" for w in quality_rules.spelled())
    word = r"[^\x20\x09-\x0D]"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, regexp_extract_all(text, '{word}+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines FROM d),
g AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM w, unnest(range(1, len(words) - 1)) AS t(i)),
twice AS (SELECT r, gram FROM g GROUP BY r, gram HAVING count(*) > 1),
covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM g JOIN twice USING (r, gram), (VALUES (0), (1), (2)) AS s(k) GROUP BY r),
s AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
    len(list_intersect(list_distinct(words), [{stop}]))::BIGINT AS n_stop_words,
    len(regexp_extract_all(text, '!'))::BIGINT AS n_exclamations, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines
  FROM w LEFT JOIN covered USING (r)),
j AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    {", ".join(f"({e}) AS {n}" for n, e in fails)} FROM s)
SELECT *, NOT (base_failed OR {" OR ".join(n for n, _ in fails)}) AS kept FROM j
"""


ORACLE = {"op4_quality_rules": _rules_sql(), "op5_license_scan": licenses.oracle(), "op12_manifest": merkle.oracle(),
          "op13_resample": resampling.oracle()}
