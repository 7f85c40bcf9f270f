"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import sql
from nearfield.llm.crf import identify
from nearfield.llm.fertility import fertility
from nearfield.llm.jaccard_join import jaccard_components
from nearfield.llm.line_dedup import line_counts
from nearfield.llm.mixing import poisson_mixture
from nearfield.llm.nnpu import toxicity
from nearfield.llm.pii import BASE, KINDS, personal_data
from nearfield.llm.sharding import extendible_shards
from nearfield.llm.tiling import contamination
from nearfield.llm.warc_archive import read_back, write_archive

#: Bytes of text in a shard.
SHARD_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(4) == 2, F.lit(False))
    return identify(docs, ~held_out).withColumnRenamed("id", "doc_id").select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "n_switches")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    least = F.array_min(F.transform("spans", lambda s: s["score"]))
    return found.select(F.col("id").alias("doc_id"), *[count(k) for k in KINDS[:BASE]], "base_sha256", joined.alias("spans"), least.alias("least_score"))


def op4_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(remainder(3) == 1, F.lit(False))
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_extendible_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = extendible_shards(table(spark, sf_dir, "documents"), SHARD_BYTES)
    return sharded.select("doc_id", "shard", "shard_depth", "shard_row_bytes")


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = read_back(write_archive(table(spark, sf_dir, "pages")))
    return back.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id").drop("which")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(table(spark, sf_dir, "documents"), shingle=3, threshold=(90, 100))
    return found.selectExpr("id as doc_id", "n_shingles", "component as component_id")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document: how many lines it has, how many are copies or near copies of earlier ones, and which are kept."""
    return line_counts(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_poisson_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = poisson_mixture(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "copy", "n_copies", "shuffle_key", F.md5("text").alias("text_md5"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_tokeniser_fertility, op2_crf_language_id, op3_pii, op4_nnpu_toxicity, op5_extendible_hashing, op6_warc_archive, op7_string_tiling, op8_ngram_jaccard_join, op9_line_dedup, op10_poisson_mixture)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op5_extendible_hashing": sql.extendible_hashing(SHARD_BYTES), "op6_warc_archive": sql.WARC, "op8_ngram_jaccard_join": sql.JACCARD, "op9_line_dedup": sql.LINES, "op10_poisson_mixture": sql.MIXTURE}
