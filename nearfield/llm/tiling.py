"""Benchmark decontamination by greedy string tiling.

Token seeds (runs of ``seed`` words) that a document shares with a benchmark
item are joined; each pair that shares enough of them is tiled: the longest
common runs of unmarked tokens are marked again and again, longest first,
starting from Karp-Rabin hashes of the seeds, until none of ``seed`` tokens is
left. The share of the item's tokens that are marked is its coverage. Tiles may
come in any order, so a passage whose sentences were moved is still covered.

Documents are read once: a bitmap of fixed size, made of the benchmark's seeds,
says which windows can match, whatever the size of the benchmark; the join that
follows is exact. Only documents with a seed are moved.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.store import Scratch, join_salted
from nearfield.llm.textops import LOWER, NON_WORD, Marks, hash_words, list_array, pieces, signed, slices, windows


def tile(item: np.ndarray, doc: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in document, length) of two token arrays, longest first; ties by start in item, then in document."""
    a, b = windows(item, seed), windows(doc, seed)
    if not len(a) or not len(b):
        return []
    order = np.argsort(a, kind="stable")
    hit = np.flatnonzero(np.isin(b, a))
    low, high = np.searchsorted(a[order], b[hit], "left"), np.searchsorted(a[order], b[hit], "right")
    n = high - low
    j = np.repeat(hit, n)
    i = order[np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))]
    # seeds that follow each other on a diagonal are one run
    by = np.lexsort((i, j - i))
    i, j = i[by], j[by]
    new = np.concatenate([[True], (np.diff(j - i) != 0) | (np.diff(i) != 1)])
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, len(i))) + seed - 1
    heap = [(-int(n), int(x), int(y)) for n, x, y in zip(length, i[at], j[at], strict=True)]
    heapq.heapify(heap)
    used_i, used_j = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    tiles = []
    while heap:
        n, x, y = heapq.heappop(heap)
        n = -n
        free = ~(used_i[x : x + n] | used_j[y : y + n])
        if free.all():
            if np.array_equal(item[x : x + n], doc[y : y + n]):
                used_i[x : x + n] = used_j[y : y + n] = True
                tiles.append((x, y, n))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], free.astype(np.int8), [0]])))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if e - s >= seed:
                heapq.heappush(heap, (-(e - s), x + s, y + s))
    return tiles


def _item_seeds(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        words, first = hash_words(batch.column("text"), NON_WORD, LOWER)
        parts = [words[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        keys, times = zip(*(np.unique(windows(p, seed), return_counts=True) for p in parts), strict=True)
        yield pa.record_batch({"item_id": batch.column("item_id"), "tokens": list_array([signed(p) for p in parts], pa.int64()), "seeds": list_array([signed(k) for k in keys], pa.int64()), "times": list_array(times, pa.int64())})


def _scan(batches: Iterator[pa.RecordBatch], seed: int, marks) -> Iterator[pa.RecordBatch]:
    """Documents with a window that may be a seed, with those windows and with their tokens."""
    known = marks.value
    for batch in slices(batches, "text"):
        words, first = hash_words(batch.column("text"), NON_WORD, LOWER)
        keys = windows(words, seed)
        hits = np.flatnonzero(known.has(keys))
        low, high = np.searchsorted(hits, first[:-1], "left"), np.searchsorted(hits, np.maximum(first[1:] - seed + 1, first[:-1]), "left")
        rows = np.flatnonzero(high > low)
        if len(rows):
            yield pa.record_batch(
                {
                    "id": batch.column("id").take(pa.array(rows)),
                    "which": batch.column("which").take(pa.array(rows)),
                    "seeds": list_array([signed(np.unique(keys[hits[low[r] : high[r]]])) for r in rows], pa.int64()),
                    "tokens": list_array([signed(words[first[r] : first[r + 1]]) for r in rows], pa.int64()),
                }
            )


def _tile(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "doc_tokens"):
        columns = {}
        for name in ("doc_tokens", "item_tokens"):
            column = batch.column(name)
            columns[name] = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
        (doc, doc_at), (item, item_at) = columns["doc_tokens"], columns["item_tokens"]
        covered, tiles = [], []
        for r in range(batch.num_rows):
            found = tile(item[item_at[r] : item_at[r + 1]], doc[doc_at[r] : doc_at[r + 1]], seed)
            covered.append(sum(n for _, _, n in found))
            tiles.append(len(found))
        yield pa.record_batch({"id": batch.column("id"), "which": batch.column("which"), "item_id": batch.column("item_id"), "item_tokens": pa.array(np.diff(item_at), pa.int64()), "covered": pa.array(covered, pa.int64()), "n_tiles": pa.array(tiles, pa.int64())})


def texts_of(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.col(text_column).cast("string")
    return docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("which"), text.alias("text"))


def tilings(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", seed: int = 5, percent: int = 50, bitmap_bits: int = 24) -> DataFrame:
    """``id, which, item_id, item_tokens, covered, n_tiles``: pairs of which tiles cover ``percent`` of the item's tokens or more.

    Tokens are runs of letters, digits and characters outside ASCII, A-Z
    lower-cased. ``which`` is a hash of the text (``xxhash64``), so that rows of
    one id, or without an id, are told apart; ids may be of any type, item ids
    are whole numbers. Items without an id or of fewer than ``seed`` tokens and
    null and empty texts match nothing. Rows repeated whole in either table give
    a pair once. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "tiling")
    items = benchmark.select(F.col(item_column).cast("long").alias("item_id"), F.col(item_text_column).cast("string").alias("text")).where("item_id is not null and text is not null")
    items = scratch.write(items.mapInArrow(partial(_item_seeds, seed=seed), "item_id long, tokens array<long>, seeds array<long>, times array<long>").where(F.size("tokens") >= seed).distinct(), "items")
    seeds = items.select("item_id", F.size("tokens").alias("n"), F.explode(F.arrays_zip("seeds", "times")).alias("s")).select("item_id", "n", F.col("s.seeds").alias("key"), F.col("s.times").alias("times"))
    marks = docs.sparkSession.sparkContext.broadcast(Marks.of(seeds.select("key"), "key", bitmap_bits))
    rows = texts_of(docs, id_column, text_column).where("text is not null")
    kind = rows.schema["id"].dataType.simpleString()
    hits = scratch.write(rows.mapInArrow(partial(_scan, seed=seed, marks=marks), f"id {kind}, which long, seeds array<long>, tokens array<long>"), "hits")
    shared = join_salted(hits.select("id", "which", F.explode("seeds").alias("key")), seeds, "key", scratch).groupBy("id", "which", "item_id", "n", "key").agg(F.max("times").alias("times")).groupBy("id", "which", "item_id", "n").agg(F.sum("times").alias("found"))
    # each place of the item where a seed found begins covers at most seed tokens, so fewer can't reach the bound
    pairs = shared.where(F.col("found") * seed * 100 >= F.col("n") * percent).select("id", "which", "item_id")
    texts = hits.select("id", "which", F.col("tokens").alias("doc_tokens")).dropDuplicates(["id", "which"])
    pairs = pairs.select(F.col("id").alias("pair_id"), F.col("which").alias("pair_which"), "item_id")
    both = pairs.join(texts, F.col("id").eqNullSafe(F.col("pair_id")) & (F.col("which") == F.col("pair_which"))).join(items.select("item_id", F.col("tokens").alias("item_tokens")), "item_id").select("id", "which", "item_id", "doc_tokens", "item_tokens")
    found = both.mapInArrow(partial(_tile, seed=seed), f"id {kind}, which long, item_id long, item_tokens long, covered long, n_tiles long")
    return found.where(F.col("covered") * 100 >= F.col("item_tokens") * percent)


def contamination(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", **how) -> DataFrame:
    """``id, contaminated, n_items, item_id, coverage``: one row for each row of ``docs``, judged by its own text.

    The item is that of the highest coverage, ties by the smallest id. Rows
    without an id and rows that repeat one have a row each; null and empty
    texts are not contaminated.
    """
    pairs = tilings(docs, benchmark, id_column, text_column, **how).withColumn("coverage", F.col("covered") / F.col("item_tokens"))
    best = pairs.groupBy(F.col("id").alias("best_id"), F.col("which").alias("best_which")).agg(F.countDistinct("item_id").alias("n_items"), F.max(F.struct("coverage", (-F.col("item_id")).alias("last"))).alias("best"))
    rows = texts_of(docs, id_column, text_column).drop("text")
    joined = rows.join(best, F.col("id").eqNullSafe(F.col("best_id")) & (F.col("which") == F.col("best_which")), "left")
    return joined.select("id", F.col("best").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), (-F.col("best.last")).alias("item_id"), F.coalesce("best.coverage", F.lit(0.0)).alias("coverage"), "which")
