"""From raw documents to packed training sequences, in five stages.

Toxic documents go, lines that stood before go, near-duplicate documents go, sources are
mixed to target weights, and the mix is packed into token sequences. Each stage takes
(spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next one's ``docs``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import linededup, mixing, neardup, packing, toxicity
from plumbline.llm.common import shared_folder, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: without the documents that a machine fitted on the labels calls toxic; null and empty texts are scored as such, and no row of an empty table stays."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: without lines that stood before; a document that loses all its lines stays, empty, and a null text stays null."""
    kept = linededup.dedup_lines(docs, edits=1, exact_least=1).drop("lines")
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one document of each group whose five-word shingles are 80 % alike; null, empty and blank texts are alike to none, and rows without an id stay."""
    return neardup.without_near_duplicates(docs, words=5, similarity=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: sources mixed 3:1:2, to one and a half times their words in all, none over twice its own; null and empty texts have no words and are not taken."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: sequences of at most 2048 ids, with the ids of every piece; shards are smaller and kept words fewer than alone, as executors have run other stages."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), cache_words=100_000, shard_chars=8_000_000)


STAGES = [("toxicity", toxic), ("line dedup", line_dedup), ("MinHash near-dedup", near_duplicates), ("mixing sources to target weights", mix), ("packing", pack)]

#: SQL expresses neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; the last one's result, read from where it was written.

    Stages are written below the folder that the cluster shares for checkpoints, each run to
    a folder of its own; what a finished run left there may be removed when its result has been used.
    """
    folder, docs = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
