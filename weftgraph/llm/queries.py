"""One query per operator, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import bpe, decontam, exponion, lang_id, license_scan, line_dedup, media_jpeg, near_dup, simhash, substring, toxicity, warc, whitening
from weftgraph.llm._rows import documents


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base places and labels, and labels of the signature rules, of every document; null and empty texts have none."""
    return license_scan.scan(documents(spark, sf_dir)).drop("detections")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by a machine that learned from the labelled rows that are not held out; empty texts have a score too."""
    docs = documents(spark, sf_dir)
    machine = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~_in_part(4, 2))
    scored = toxicity.score(docs, machine)
    return scored.select("doc_id", _in_part(4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, digest of the ids and of their decoding for every document; null is empty."""
    import public_tokenizers

    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload digests and a feature of the RGB tensor of every document, read back from its stored picture; null is empty."""
    return media_jpeg.load(media_jpeg.store(documents(spark, sf_dir)))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record of every page, read back from the archives that were written; pages that repeat identifier and payload are all responses."""
    return warc.read(warc.write(warc.plan(spark.read.parquet(f"{sf_dir}/pages.parquet"))))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, removed words and a digest of what is kept of every document."""
    return substring.dedup(documents(spark, sf_dir)).drop("kept")


def _in_part(n: int, remainder: int):
    """Is crc32 of doc_id as text, modulo n, the remainder?  False for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % n == remainder, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language, score and number of spans of every document; `und` without letters."""
    docs = documents(spark, sf_dir)
    model = lang_id.fit(docs, "text", "lang", ~_in_part(3, 1))
    return lang_id.predict(docs, model).select("doc_id", _in_part(3, 1).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, removed lines and a digest of what is kept of every document."""
    return line_dedup.dedup(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and its size of every document; null and empty texts are one class."""
    return near_dup.classes(documents(spark, sf_dir))


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that it holds."""
    found = decontam.matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.explode("items").alias("i")).select("doc_id", "i.item_id", "i.start_word", "i.edits")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.classes(documents(spark, sf_dir))


def op12_exponion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance and sums of distances of every whole vector of 64 components."""
    return exponion.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight whitened components of every whole vector."""
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op8_license_scan": op8_license_scan, "op6_warc": op6_warc, "op9_toxicity": op9_toxicity, "op1_language_id": op1_language_id, "op4_decontam": op4_decontam, "op2_line_dedup": op2_line_dedup, "op5_near_dup": op5_near_dup, "op7_substring_dedup": op7_substring_dedup, "op3_progressive_jpeg": op3_progressive_jpeg, "op10_byte_bpe": op10_byte_bpe, "op11_simhash": op11_simhash, "op12_exponion": op12_exponion, "op13_whitening": op13_whitening}
ORACLES: dict[str, str] = {"op2_line_dedup": line_dedup.SQL, "op6_warc": warc.SQL, "op8_license_scan": license_scan.sql(), "op12_exponion": exponion.sql()}
