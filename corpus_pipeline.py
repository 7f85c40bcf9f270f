"""A corpus pipeline of five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it works on
all rows of its predecessor. All but the last return the columns of
``documents``. Which rows a stage keeps is in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.fertility import fertility
from nearfield.llm.jaccard_join import jaccard_components
from nearfield.llm.mixing import poisson_mixture
from nearfield.llm.queries import SHARD_BYTES
from nearfield.llm.sharding import extendible_shards
from nearfield.llm.store import BLOCK, Scratch, repeated
from nearfield.llm.tiling import contamination

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _without(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """Rows of ``docs`` but those whose id and text (``gone_id``, a hash ``gone_which``) are in ``gone``; a null id is an id like any other."""
    gone = Scratch(docs.sparkSession, name).write(gone.select("gone_id", "gone_which").distinct(), name)
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_which"))
    return docs.select(COLUMNS).join(gone, same, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tokeniser rules keep.

    Each row is judged by its own text, rows without an id and rows that repeat
    one too; rows repeated whole go or stay together. Null and empty texts go.
    An empty table stays empty; other columns than those of documents are not
    read, whatever their names.
    """
    rows = docs.select(F.struct(*COLUMNS).alias("row"), "text", "lang")
    return fertility(rows, "row").where("kept").select("id.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each component of five-word shingles at similarity 0.8.

    Documents without an id stay, and rows that repeat an id are one document:
    they go or stay together. Null and empty texts are like nothing and stay. An
    empty table stays empty; other columns than those of documents are not
    read.
    """
    found = jaccard_components(docs, shingle=5, threshold=(80, 100)).where("component < id").select(F.col("id").alias("doc_id")).distinct()
    gone = Scratch(spark, "near").write(found, "copies")
    return docs.select(COLUMNS).join(gone, "doc_id", "left_anti")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't contain half of a benchmark item, in whatever order.

    Each row is judged by its own text, rows without an id and rows that repeat
    one too; rows repeated whole go or stay together. Null and empty texts stay,
    and so does all of an empty table or with an empty benchmark; other columns
    than those of documents are not read.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination(docs, benchmark).where("contaminated")
    return _without(docs, found.select(F.col("id").alias("gone_id"), F.col("which").alias("gone_which")), "leaks")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows as there are, on average, with every source at the same share: each document as often as drawn.

    Texts are not looked at, so null and empty ones are drawn like others. A
    null source is a source; rows that repeat an id draw the same count each,
    and rows without an id one count for all. An empty table stays empty; other
    columns than those of documents are left out.
    """
    return poisson_mixture(docs.select(COLUMNS)).select(COLUMNS)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, each with its shard of at most SHARD_BYTES bytes of text.

    The key is the whole row and, for rows repeated whole, a number from 0, so
    copies and rows of one id or without an id can be split; only a text above
    the limit makes a shard exceed it. Null and empty texts have no bytes. An
    empty table stays empty; other columns than those of documents are left
    out.
    """
    # equal rows are counted before they move and numbered after, so that no group of copies is one task's
    counted = Scratch(spark, "counted").write(docs.select(COLUMNS).groupBy(COLUMNS).agg(F.count("*").alias("times")), "rows")
    often = F.col("times") > BLOCK
    numbered = repeated(counted.where(~often), "times", "number").unionByName(repeated(counted.where(often), "times", "number", dealt=True)).drop("times")
    return extendible_shards(numbered, SHARD_BYTES, (*COLUMNS, "number")).drop("number")


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminated), ("mixing sources", mixed), ("sharding", sharded)]
#: Tokenisers and tiling can't be put in SQL; tests/llm holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``documents`` after all stages, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.write(docs, name.replace(" ", "-"))
    return docs
