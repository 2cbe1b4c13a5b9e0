"""Corpus pipeline: language ID, line dedup, near-dedup, benchmark decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs.  All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import bpe, decontam, lang_id, line_dedup, near_dup
from weftgraph.llm._rows import checkpointed, documents

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or without a main language go; `lang` becomes what was found."""
    learn = ~F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return lang_id.keep(docs.select(*COLUMNS), lang_id.fit(docs, "text", "lang", learn))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines in repeated three-line windows go, and documents of which nothing is left."""
    out = line_dedup.dedup(docs, keep=("lang", "source")).where((F.col("n_lines") > F.col("n_removed")) | (F.col("n_removed") == 0))
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one row stays: that with the smallest doc_id."""
    return near_dup.keep(docs.select(*COLUMNS))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.keep(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document and their decoding, as digests."""
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language_id", language), ("line_dedup", lines), ("minhash_near_dedup", near_duplicates), ("decontamination", decontaminated), ("byte_level_bpe", tokens)]

#: Sampling, hashing and tokenizing are not expressible in SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every document that all stages keep; each stage but the last is a table in the shared folder.

    Null and empty texts go in the first stage, as they have no letters; an empty table gives no rows.
    """
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
