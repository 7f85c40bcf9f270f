"""Shards of bounded bytes by extendible hashing.

A directory is indexed by the first bits of a document's hash. A bucket that
exceeds the byte limit, and only that one, splits on its next bit, until every
bucket fits. Here the splits are found at once: bytes are summed per fine prefix
(pre-aggregated before the shuffle), those sums roll up to every coarser
prefix, and a document's bucket is its shortest prefix whose bytes fit. Cells
that do not fit at the fine depth go on alone with more bits, and what they come
to is a short list a cell, so that documents are joined with the cells once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.store import Scratch

BITS = 60


def key_hash(*columns: str | Column) -> Column:
    """The first 60 bits of an MD5 over the columns' texts; a null counts as an empty text."""
    text = F.concat_ws("\x1f", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _prefix(h: Column, depth: Column | int) -> Column:
    return F.call_function("shiftright", h, (F.lit(BITS) - depth).cast("int")) if isinstance(depth, Column) else F.shiftright(h, BITS - depth)


def _leaves(rows: DataFrame, depth: int, least: int, limit: int) -> DataFrame:
    """For each cell at ``depth``: ``cell``, and ``local``, the least depth from ``least`` on at which its bucket fits (null: none)."""
    fine = rows.groupBy(_prefix(F.col("h"), depth).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"), F.min("h").alias("low"), F.max("h").alias("high"))
    up = fine.select("*", F.explode(F.sequence(F.lit(least), F.lit(depth))).alias("d")).withColumn("p", F.call_function("shiftright", F.col("cell"), (F.lit(depth) - F.col("d")).cast("int")))
    sums = up.groupBy("d", "p").agg(F.sum("n_bytes").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))
    fits = sums.where((F.col("total") <= limit) | (F.col("low") == F.col("high"))).select("d", "p")
    least_fit = up.select("cell", "d", "p").join(fits, ["d", "p"]).groupBy("cell").agg(F.min("d").alias("local"))
    return fine.select("cell").join(least_fit, "cell", "left")


def extendible_shards(docs: DataFrame, limit_bytes: int, key_columns: tuple[str, ...] = ("doc_id",), text_column: str = "text", spare_bits: int = 3) -> DataFrame:
    """``docs`` with ``shard`` (the bits of its bucket; empty for the root), ``shard_depth`` and ``shard_row_bytes``.

    Every shard's texts have at most ``limit_bytes`` bytes of UTF-8, unless all
    its rows have one key hash: a text above the limit, or rows that repeat a
    key, which stay together. Null texts have no bytes, null keys count as
    empty ones. All rows are kept, ties and repeated rows included; an empty
    table gives none. Input columns of the names of the added ones are
    replaced.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    added = ("shard", "shard_depth", "shard_row_bytes")
    docs = docs.drop(*added)
    keyed = docs.select("*", key_hash(*key_columns).alias("_shard_h"), F.coalesce(F.octet_length(text_column), F.lit(0)).cast("long").alias("shard_row_bytes"))
    rows = scratch.write(keyed.select(F.col("_shard_h").alias("h"), F.col("shard_row_bytes").alias("n_bytes")), "rows")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(BITS, max(0, (max(1, total // limit_bytes)).bit_length() + spare_bits))
    top, least, left, cells, finer = depth, 0, rows, [], []
    while True:
        cells.append(scratch.write(_leaves(left, depth, least, limit_bytes), f"cells{depth}"))
        if least:
            start = F.call_function("shiftleft", F.col("cell"), F.lit(BITS - depth))
            finer.append(cells[-1].where("local is not null").select(_prefix(start, top).alias("cell"), F.struct(start.alias("start"), "local").alias("leaf")))
        open_cells = cells[-1].where("local is null").select("cell")
        if depth >= BITS or not open_cells.limit(1).count():
            break
        left = left.withColumn("cell", _prefix(F.col("h"), depth)).join(open_cells, "cell", "left_semi").select("h", "n_bytes")
        least, depth = depth + 1, min(BITS, depth + 8)
    # a cell that is open holds what a shard does and a few more keys, so its list is short
    found = cells[0].withColumn("leaves", F.lit(None).cast("array<struct<start: bigint, local: int>>"))
    if finer:
        lists = reduce(DataFrame.union, finer).groupBy("cell").agg(F.sort_array(F.collect_list("leaf")).alias("more"))
        found = cells[0].join(lists, "cell", "left").withColumnRenamed("more", "leaves")
    # the table's size is known from its files, so a small one is broadcast and a large one is not
    found = scratch.write(found.select(F.col("cell").alias("_shard_cell"), F.col("local").alias("_shard_local"), F.col("leaves").alias("_shard_leaves")), "found")
    out = keyed.withColumn("_shard_cell", _prefix(F.col("_shard_h"), top)).join(found, "_shard_cell")
    below = F.element_at(F.filter("_shard_leaves", lambda x: x["start"] <= F.col("_shard_h")), -1)["local"]
    found = F.coalesce("_shard_local", below)
    names = [c for c in docs.columns]
    out = out.withColumn("shard_depth", found.cast("int"))
    bits = F.when(F.col("shard_depth") > 0, F.lpad(F.bin(F.call_function("shiftright", F.col("_shard_h"), (F.lit(BITS) - F.col("shard_depth")).cast("int"))), F.col("shard_depth"), F.lit("0"))).otherwise(F.lit(""))
    scratch.drop(rows, *cells)
    return out.withColumn("shard", bits).select(*names, *added)


def directory(shards: DataFrame, bits: int | None = None) -> DataFrame:
    """``entry, shard, shard_depth, n_rows, n_bytes``: the directory over the rows of ``extendible_shards``.

    Every sequence of ``bits`` bits, by default the depth of the deepest shard
    and at most 20, points to the shard that it begins with or that begins with
    it; shards of more bits than that have an entry each by their first bits. An
    empty table has an empty directory.
    """
    sums = shards.groupBy("shard", "shard_depth").agg(F.count("*").alias("n_rows"), F.sum("shard_row_bytes").alias("n_bytes"))
    if bits is None:
        bits = min(20, sums.agg(F.max("shard_depth")).first()[0] or 0)
    rest = F.greatest(F.lit(0), F.lit(bits) - F.col("shard_depth"))
    ends = F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), rest) - 1))
    return sums.withColumn("_end", ends).select(
        F.concat(F.substring("shard", 1, bits), F.when(rest > 0, F.lpad(F.bin("_end"), rest, F.lit("0"))).otherwise(F.lit(""))).alias("entry"), "shard", "shard_depth", "n_rows", "n_bytes"
    )
