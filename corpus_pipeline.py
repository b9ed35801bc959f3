"""The corpus pipeline: quality classifier, line dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its result is
written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.llm import bpe_codec, linededup, minhash, mixing, quality
from cellgrid.llm.common import kept, scratch, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the boosted trees accept, each row by itself.

    A null or empty text scores as one without words; a null id is scored, never learned from; without
    labelled documents all scores are one half, so all rows stay.
    """
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate lines; n_chars follows the text.

    A text that has no other line is left to the next stage, which keeps one of its copies: here all of
    them would be emptied. Null and empty texts stay as they are, a null source is no site, repeated
    rows are cut alike, and further columns keep their values, whatever they are called.
    """
    cleaned = linededup.dedup_lines(docs, spare_whole=True)
    cut = F.col(linededup.count_names(docs)[1])
    n_chars = F.when(cut > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return cleaned.select(*[n_chars if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the least id, and of rows that repeat it the least by hash.

    Null and empty texts are in no group and all stay.
    """
    return minhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the target weights of their sources take them.

    A null source is one source, the last; texts without a word (null and empty ones too) are taken 0
    times; of rows that repeat an id and size, as many as the budget takes.
    """
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and the digest of the bytes that they decode to; a null text counts as empty."""
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe_codec.round_trip(docs, ranks, pattern).select("doc_id", "n_tokens", "ids", "decoded_sha256")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("bpe_encode", encode),
]

#: The classifier can't be expressed in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):  # what a stage stages for itself goes when its result is written
            docs = kept(stage(spark, docs, sf_dir), name)
    return docs
