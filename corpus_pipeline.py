"""A training corpus from raw documents: five stages, each a job whose Parquet output is the next one's input.

Rows pass with all their columns up to the last stage; n_chars follows the text. Rows that repeat a doc_id go through as they are,
except that the near-duplicate stage keeps or drops all rows of a doc_id together.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitmill.llm import bpe, lang_id, mixing
from visitmill.llm.line_dedup import line_dedup
from visitmill.llm.ngram_join import ngram_join
from visitmill.llm.queries import RANKS, TARGETS, domains
from visitmill.llm.shared import scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told without doubt; those without a letter and those between two languages go."""
    told = lang_id.predict(docs, lang_id.fit(docs.select("text", "lang")))
    return told.filter((F.col("lang_pred") != "und") & ~F.col("ambiguous")).select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many of them repeat. A document that had no other lines stays, empty."""
    return line_dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of documents linked by similarity."""
    stays = ngram_join(docs).filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("__stays")).distinct()
    return docs.join(stays, F.col("doc_id").eqNullSafe(F.col("__stays")), "left_semi")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target shares of the judged domains ask for."""
    return mixing.mixed(docs, domains(spark.read.parquet(f"{sf_dir}/labels.parquet")), TARGETS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of what they decode to."""
    ranks = bpe.read_ranks(public_tokenizers.path(RANKS))
    encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    return bpe.decode(encoded, ranks).select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
                                             F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_copies),
    ("mixing", mix_sources),
    ("tokens", tokens),
]

#: Several stages learn from the data or iterate, which SQL cannot say; the tests compare with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch(spark)
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs
