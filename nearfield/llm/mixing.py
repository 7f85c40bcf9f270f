"""Mixing sources to target weights by Poisson replication.

A source's repetition rate is its target share of the mixture over its present
share. Each document draws its number of copies by inverting the Poisson
distribution of that mean at a point hashed from a seed and its id, so a run
can be repeated, and a task that is run again draws the same. Copies are
exploded and shuffled globally by a hash of seed, id and copy. Where a rate is
high, the copies of a document are dealt over tasks in blocks before that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.store import BLOCK, Scratch, repeated

POINTS = 52  # bits of the hashed point: exact in a double


def poisson_table(rate: float) -> tuple[int, list[float]]:
    """The least count of any likelihood and P(count <= k) from it on, until it is 1."""
    if rate <= 0:
        return 0, [1.0]
    spread = 12 * math.sqrt(rate) + 40
    low = max(0, int(rate - spread))
    table, total = [], 0.0
    k = low
    while k <= rate + spread:
        total += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
        table.append(min(total, 1.0))
        k += 1
    return low, table


def _tables(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        made = [poisson_table(r) for r in frame["rate"]]
        yield pd.DataFrame({"_mix_source": frame["_mix_source"], "rate": frame["rate"], "_mix_low": [a for a, _ in made], "_mix_table": [b for _, b in made]})


def poisson_mixture(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, id_column: str = "doc_id", source_column: str = "source", seed: str = "mix-1") -> DataFrame:
    """The rows of ``docs``, each as often as drawn, with ``copy`` (from 0), ``n_copies`` and ``shuffle_key``, in an order mixed over all sources.

    ``weights``: target share of each source, in any unit; by default every
    source has the same. Sources that are not named get none, and
    sources that the table doesn't have take no share. ``total``: the
    expected number of rows; by default as many as there are. A source's rate is
    ``total * share / rows of the source``. A null source is a source like any
    other, named by the empty text. Rows that repeat an id draw the same count;
    a null id draws as the empty text. An empty table gives none. Input columns
    of the names of the added ones are replaced.
    """
    spark = docs.sparkSession
    added = ("copy", "n_copies", "shuffle_key")
    docs = docs.drop(*added)
    source = F.coalesce(F.col(source_column).cast("string"), F.lit(""))
    counts = docs.groupBy(source.alias("_mix_source")).agg(F.count("*").alias("n"))
    if weights is None:
        weighted = counts.withColumn("w", F.lit(1.0))
    else:
        given = spark.createDataFrame([(k or "", float(v)) for k, v in weights.items()], "_mix_source string, w double")
        weighted = counts.join(given, "_mix_source", "left").fillna(0.0, ["w"])
    scratch = Scratch(spark, "mixture")
    weighted = scratch.write(weighted, "weights")
    sums = weighted.agg(F.sum("w").alias("w"), F.sum("n").alias("n")).first()
    share = F.col("w") / F.lit(float(sums["w"] or 1.0))
    rates = weighted.select("_mix_source", (share * F.lit(float(total if total is not None else sums["n"] or 0)) / F.col("n")).alias("rate"))
    tables = scratch.write(rates.mapInPandas(_tables, "_mix_source string, rate double, _mix_low long, _mix_table array<double>"), "tables")
    scratch.drop(weighted)
    name = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    point = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, POINTS // 4), 16, 10).cast("long") / F.lit(float(1 << POINTS))

    def drawn(tables: DataFrame) -> DataFrame:
        met = docs.withColumn("_mix_source", source).join(tables.drop("rate"), "_mix_source").withColumn("_mix_u", point)
        return met.withColumn("n_copies", F.col("_mix_low") + F.size(F.filter("_mix_table", lambda x: x <= F.col("_mix_u")))).where("n_copies > 0")

    often = F.col("rate") > BLOCK
    copies = repeated(drawn(tables.where(~often)), "n_copies", "copy")
    if tables.where(often).limit(1).count():
        copies = copies.unionByName(repeated(drawn(tables.where(often)), "n_copies", "copy", dealt=True))
    key = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:shuffle:"), name, F.lit(":"), F.col("copy").cast("string"))), 1, 15), 16, 10).cast("long")
    return copies.withColumn("shuffle_key", key).select(*docs.columns, *added).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
