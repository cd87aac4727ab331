"""The queries of the ten operators, with production parameters, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import ann, fingerprint, linededup, mixing, neardup, packing, quality, secrets, tokencount, toxicity
from plumbline.llm.common import table


def op1_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found for every embedding whose id is divisible by 20."""
    return ann.search(table(spark, sf_dir, "embeddings"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents by a machine fitted on the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, whole documents being encoded once."""
    docs, path = table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    return tokencount.section_tokens(docs, path, public_tokenizers.PATTERN, rule="start")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, and their likeness to an edited text's and the next document's."""
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without lines that stood before, exactly at any length, or but for one edit, or up to five in lines of 100 characters."""
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), edits=linededup.EDITS, exact_least=1)
    return kept.select("doc_id", "lines.*", "text")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets are 80 % alike."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=4, similarity=0.8)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a 3:1:2 mix of one and a half times the corpus takes of each document."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, by patterns and by randomness tests."""
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents; the source stands for the host, the language for the path."""
    docs = table(spark, sf_dir, "documents")
    classifier = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, classifier, F.col("source"), F.col("lang"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS o
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM s0),
s2 AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((r - 1) % 3 + 1)::BIGINT] AS w FROM s1),
s3 AS (SELECT *, 2.0::DOUBLE * source_size / w AS ratio FROM s2),
s4 AS (SELECT *,
         (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
          - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY ratio, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY ratio, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lv
       FROM s3),
free AS (SELECT ratio, r, lv FROM s4 WHERE lv <= ratio ORDER BY ratio, r LIMIT 1),
s5 AS (SELECT s4.*, CASE WHEN free.r IS NOT NULL AND (s4.ratio > free.ratio OR (s4.ratio = free.ratio AND s4.r >= free.r))
                         THEN w * free.lv ELSE 2.0::DOUBLE * source_size END AS target
       FROM s4 LEFT JOIN free ON true),
seats AS (SELECT round(sum(target) / 16)::BIGINT AS seats FROM s5),
won AS (SELECT r, count(*) AS blocks FROM (
          SELECT r, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, r, k) AS place
          FROM s5, unnest(generate_series(1, (target / 16)::BIGINT + (SELECT count(*) FROM s5) + 2)) AS t(k)
          WHERE target > 0), seats WHERE place <= seats GROUP BY r),
s AS (SELECT s5.*, coalesce(blocks, 0) AS blocks, ceil(n / 2000.0)::BIGINT AS shards FROM s5 LEFT JOIN won USING (r)),
e AS (SELECT d.*, s.r, s.source_size, s.target, s.blocks, ('0x' || substr(o, 1, 8))::BIGINT % s.shards AS shard
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
h0 AS (SELECT r, shard, blocks, sum(size)::BIGINT AS n FROM e GROUP BY r, shard, blocks),
hwon AS (SELECT r, shard, count(*) AS quota FROM (
          SELECT r, shard, blocks, row_number() OVER (PARTITION BY r ORDER BY n / (2 * k - 1)::DOUBLE DESC, shard, k) AS place
          FROM h0, unnest(generate_series(1, blocks::BIGINT)) AS t(k) WHERE n > 0)
         WHERE place <= blocks GROUP BY r, shard),
h AS (SELECT h0.*, least(coalesce(quota, 0) * 16, 2 * n) AS wanted,
             CASE WHEN n > 0 THEN (('0x' || substr(md5('mix:' || h0.r || ':' || h0.shard), 1, 8))::BIGINT * 16) % n ELSE 0 END AS lo
      FROM h0 LEFT JOIN hwon USING (r, shard)),
f AS (SELECT e.*, h.n, h.wanted, h.lo,
             coalesce(sum(size) OVER (PARTITION BY e.r, e.shard ORDER BY o, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a
      FROM e JOIN h ON e.r = h.r AND e.shard = h.shard),
g AS (SELECT *, a + size AS b, CASE WHEN n > 0 THEN wanted // n ELSE 0 END AS whole FROM f),
i AS (SELECT *, lo + (wanted - whole * n) AS stop FROM g)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (whole * size + greatest(0, least(b, least(stop, n)) - greatest(a, lo)) + greatest(0, least(b, stop - n) - a))::BIGINT AS taken
FROM i
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_learned_partitions, op2_toxicity, op3_token_counts, op4_fingerprints, op5_line_dedup, op6_packing, op7_minhash, op8_mixing, op9_secrets, op10_quality]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op8_mixing": OP8_SQL}
