"""Line dedup by a deletion-neighbourhood join.

A line is a sequence of its words; one of few words is a sequence of the
characters of its words with one space between them. An edit inserts, deletes
or replaces one item of the sequence. Of two lines one edit apart,

* if an item is replaced, both less the item of that place are equal;
* if one is inserted, the longer one less an item is the shorter one whole.

So a line emits the hashed key (rest, place) and the key (rest) for each item
deleted, and the key of itself, and equal keys meet. All lines of a key are one
edit from its earliest, so the join is a grouped minimum and no pairs of a
group are ever emitted.

Keys are emitted only where they can meet. A first pass takes each line less
one of ``BLOCKS`` blocks; two lines one edit apart agree outside the block of
the edit. Only lines that share such a key with a different line go on, and
only items inside the shared blocks are deleted. The keys that are shared are
a table; a bitmap of it thins out what is joined with the table.

Edits are verified on the items. Earliest means the smallest (id, text, line):
ids in their own order, then those that are null; rows that repeat an id are
told apart by a hash of their texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.store import Scratch, join_unique
from nearfield.llm.textops import POINT_BREAK, SPACES, Marks, U, hash_spans, list_array, mix, pieces, raw, signed, slices, word_spans

BLOCKS = 2
STEP = U(0x9E6C63D0876A9A47)
STEP_BACK = U(pow(0x9E6C63D0876A9A47, -1, 1 << 64))
#: Kinds of keys: an item replaced (of all lines of a key the earliest counts), an item deleted, a whole line.
REPLACED, DELETED, WHOLE = 0, 1, 2
#: Items of which a line's mark says the number; longer lines have this one.
MOST_ITEMS = (1 << 24) - 1


class Sequences:
    """Lines as sequences of hashed items, with prefix sums that hash any part of a line."""

    def __init__(self, items: np.ndarray, begin: np.ndarray, size: np.ndarray, short: np.ndarray):
        self.items, self.begin, self.size, self.short = items, begin, size, short
        longest = int(size.max(initial=0)) + 1
        with np.errstate(over="ignore"):
            self.power = np.multiply.accumulate(np.concatenate([[U(1)], np.full(longest, STEP)]))
            self.down = np.multiply.accumulate(np.concatenate([[U(1)], np.full(longest, STEP_BACK)]))
            # lines don't overlap, but what lies between them has no place
            place = np.zeros(len(items), np.int64)
            at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            place[at] = at - np.repeat(begin, size)
            self.place = place
            self.sums = np.concatenate([[U(0)], np.cumsum(items * self.power[place])])

    def less(self, line: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of lines without their items a to b."""
        with np.errstate(over="ignore"):
            at, n = self.begin[line], self.size[line]
            head = self.sums[at + a] - self.sums[at]
            tail = (self.sums[at + n] - self.sums[at + b]) * self.down[b - a]
            rest = ((n - (b - a)) * 2 + self.short[line]).astype(U)
            return mix(head + tail + rest * U(0xC2B2AE3D27D4EB4F))

    def whole(self) -> np.ndarray:
        n = np.zeros(len(self.begin), np.int64)
        return self.less(np.arange(len(self.begin)), n, n)

    def marks(self) -> np.ndarray:
        """What tells lines of one hash apart: 39 bits of another hash, and the number of items."""
        with np.errstate(over="ignore"):
            sums = np.concatenate([[U(0)], np.cumsum(mix(self.items ^ U(0x6A09E667F3BCC908)) * self.power[self.place])])
            other = mix(sums[self.begin + self.size] - sums[self.begin] + self.short.astype(U))
        return (other >> U(25) << U(24)) | np.minimum(self.size, MOST_ITEMS).astype(U)

    def spans(self, line: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Begin, end and number of each block: of the lines' own division, and of that of lines one item shorter."""
        for shorter in (0, 1):
            n = self.size[line] - shorter
            for k in range(BLOCKS):
                yield n * k // BLOCKS, n * (k + 1) // BLOCKS + shorter, n * BLOCKS + k

    def blocks(self, line: np.ndarray) -> np.ndarray:
        """Keys of lines less a block, one column for each of ``spans``."""
        with np.errstate(over="ignore"):
            return np.stack([mix(self.less(line, a, b) ^ (name + 1).astype(U)) for a, b, name in self.spans(line)], 1)


class Lines(Sequences):
    """The lines with a word of a batch of texts."""

    def __init__(self, column: pa.Array, least: int):
        buf, off = raw(column)
        starts, ends, first = word_spans(buf, off, SPACES)
        words = hash_spans(buf, starts, ends)
        # a word begins a line if there is a line end between it and the word before, or it begins a row
        breaks = np.concatenate([[0], np.cumsum(buf == 10)])
        new = np.ones(len(starts), bool)
        if len(starts):
            new[1:] = breaks[starts[1:]] > breaks[ends[:-1]]
            new[first[:-1][first[:-1] < len(starts)]] = True
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(starts)))
        self.row = np.searchsorted(first, begin, "right") - 1
        self.number = breaks[starts[begin]] - breaks[off[self.row]]
        short = size < least
        points, at, n = _characters(buf, starts, ends, begin[short], size[short])
        begin[short], size[short] = at + len(words), n
        super().__init__(np.concatenate([words, points]), begin, size, short)


def _characters(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed characters of lines, given by their words: the words' bytes with a space between them, and where lines begin and how long they are."""
    if not len(begin):
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    last = np.cumsum(size) - 1
    word = np.repeat(begin - (last + 1 - size), size) + np.arange(int(size.sum()))
    s, wide = starts[word], ends[word] - starts[word] + 1
    at = np.concatenate([[0], np.cumsum(wide)])
    place = np.repeat(s - at[:-1], wide) + np.arange(at[-1])
    data = buf[np.minimum(place, len(buf) - 1)]
    data[at[1:] - 1] = 32
    data[at[last + 1] - 1] = POINT_BREAK
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    stop = np.flatnonzero(points == POINT_BREAK)
    first = np.concatenate([[0], stop[:-1] + 1])
    return mix(points.astype(U) + U(1)), first, stop - first


def _blocks(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        lines = Lines(batch.column("text"), least)
        whole = lines.whole()
        # a line that repeats in a slice says nothing new
        _, at = np.unique(whole, return_index=True)
        if len(at):
            # the hash of a line joins its keys only to see whether two lines differ
            yield pa.record_batch({"key": signed(lines.blocks(at).ravel()), "line": signed(np.repeat(whole[at], 2 * BLOCKS))})


def _lines(batches: Iterator[pa.RecordBatch], least: int, marks) -> Iterator[pa.RecordBatch]:
    """All lines; with the items and the keys of the blocks of those that may have a neighbour, where they are first in a slice."""
    known = marks.value
    none = np.zeros(0, np.int64)
    for batch in slices(batches, "text"):
        lines = Lines(batch.column("text"), least)
        if not len(lines.begin):
            continue
        whole = lines.whole()
        _, at = np.unique(whole, return_index=True)
        keys = lines.blocks(at)
        hit = known.has(keys.ravel()).reshape(keys.shape).any(1)
        items, blocks = [none] * len(whole), [none] * len(whole)
        for i, k in zip(at[hit].tolist(), keys[hit], strict=True):
            items[i] = signed(lines.items[lines.begin[i] : lines.begin[i] + lines.size[i]])
            blocks[i] = signed(k)
        rows = pa.array(lines.row)
        yield pa.record_batch(
            {
                "id": batch.column("id").take(rows),
                "which": batch.column("which").take(rows),
                "number": lines.number.astype(np.int64),
                "hash": signed(whole),
                "mark": signed(lines.marks()),
                "short": lines.short,
                "items": list_array(items, pa.int64()),
                "blocks": list_array(blocks, pa.int64()),
            }
        )


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, kind, row) of the variants inside the shared blocks, and of the whole lines, of a batch."""
    size = batch.column("items").value_lengths().to_numpy()
    items = batch.column("items").flatten().to_numpy(zero_copy_only=False).view(U)
    lines = Sequences(items, np.cumsum(size) - size, size, batch.column("short").to_numpy(zero_copy_only=False))
    every = np.arange(len(size))
    shared = batch.column("shared").to_numpy()
    # places that a shared block covers, as differences
    inside = np.zeros(len(items) + 1, np.int64)
    for k, (a, b, _) in enumerate(lines.spans(every)):
        on = (shared >> k) & 1
        np.add.at(inside, lines.begin + a, on)
        np.add.at(inside, lines.begin + b, -on)
    at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    row = np.repeat(every, size)[at]
    place = at - lines.begin[row]
    rest = lines.less(row, place, place + 1)
    with np.errstate(over="ignore"):
        replaced = mix(rest + (place + 1).astype(U) * U(0xA24BAED4963EE407))
    key = np.concatenate([replaced, rest, lines.whole()])
    kind = np.repeat([REPLACED, DELETED, WHOLE], [len(at), len(at), len(size)])
    return key, kind, np.concatenate([row, row, every])


def _variants(batches: Iterator[pa.RecordBatch], marks=None) -> Iterator[pa.RecordBatch]:
    """The keys of lines; with ``marks``, of those only that are in it."""
    for batch in pieces(batches, "items"):
        key, kind, row = _keys(batch)
        if marks is not None:
            on = marks.value.has(key)
            key, kind, row = key[on], kind[on], row[on]
        rows = pa.array(row)
        yield pa.record_batch({"key": signed(key), "kind": kind.astype(np.int32), "first": batch.column("first").take(rows), "hash": batch.column("hash").take(rows), "mark": batch.column("mark").take(rows)})


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether two sequences are at most one edit apart: what they share at the beginning and at the end leaves one item at most."""
    for batch in batches:
        sides = [(batch.column(c).flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(batch.column(c).value_lengths().to_numpy())])) for c in ("items", "other_items")]
        (x, at_x), (y, at_y) = sides
        ok = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            a, b = x[at_x[i] : at_x[i + 1]], y[at_y[i] : at_y[i + 1]]
            n = min(len(a), len(b))
            if abs(len(a) - len(b)) > 1:
                continue
            differ = np.flatnonzero(a[:n] != b[:n])
            head = int(differ[0]) if len(differ) else n
            ok[i] = np.array_equal(a[head + (len(a) >= len(b)) :], b[head + (len(b) >= len(a)) :])
        yield pa.record_batch({"hash": batch.column("hash"), "mark": batch.column("mark"), "ok": ok})


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``id, which, text``: which text of its id a row has, by a hash."""
    text = F.col(text_column).cast("string")
    return docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("which"), text.alias("text"))


def duplicate_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_words: int = 4) -> DataFrame:
    """``id, which, number, exact, near``: one row for each line that has a word, with its number from 0 in its text.

    ``exact``: an earlier line has the same words (white space aside). ``near``:
    an earlier line of other words is one edit away, where an edit inserts,
    deletes or replaces one word if both lines have ``least_words`` words or
    more, and one character if both have fewer. So at most one word of
    ``least_words`` differs. Lines that are neither are the earliest and are
    kept.

    ``which`` is a hash of the whole text (``xxhash64``) and tells rows of one
    id apart; ids may be of any type that can be ordered, and null ids come
    last. Rows that repeat an id and a text give their lines each time, with the
    same verdict. Null and empty texts have no lines; an empty table gives
    none. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    kind = docs.schema[id_column].dataType.simpleString()
    rows = _rows(docs, id_column, text_column).where("text is not null")
    keys = rows.select("text").mapInArrow(partial(_blocks, least=least_words), "key long, line long")
    shared = scratch.write(keys.groupBy("key").agg(F.min("line").alias("low"), F.max("line").alias("high")).where("low < high").select("key"), "shared")
    marks = spark.sparkContext.broadcast(Marks.sized(shared, "key"))
    schema = f"id {kind}, which long, number long, hash long, mark long, short boolean, items array<long>, blocks array<long>"
    lines = scratch.write(rows.mapInArrow(partial(_lines, least=least_words, marks=marks), schema), "lines")

    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "which", "number")
    line = ["hash", "mark"]
    first = scratch.write(lines.groupBy(line).agg(F.min(place).alias("first"), F.count("*").alias("times")), "first")
    some = lines.where(F.size("items") > 0).groupBy(line).agg(F.first("short").alias("short"), F.first("items").alias("items"), F.first("blocks").alias("blocks"))
    some = scratch.write(some, "some")
    # the bitmap may let others pass: the table says which blocks are shared
    bits = some.select(*line, F.posexplode("blocks").alias("k", "key")).join(shared, "key", "left_semi").groupBy(line).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("k"))).alias("shared"))
    near = scratch.write(some.join(bits, line).join(first.drop("times"), line).select(*line, "first", "short", "items", "shared"), "near")

    wanted = f"key long, kind int, first {near.schema['first'].dataType.simpleString()}, hash long, mark long"
    least = lambda kinds: F.min(F.when(F.col("kind").isin(kinds), F.struct("first", *line)))
    groups = near.mapInArrow(_variants, wanted).groupBy("key").agg(least([REPLACED, WHOLE]).alias("base"), least([DELETED]).alias("longer"), F.count("*").alias("times"), F.count_if(F.col("kind") == REPLACED).alias("replaced"))
    groups = scratch.write(groups.where("replaced > 1 or base is not null and longer is not null").drop("replaced"), "groups")
    found = spark.sparkContext.broadcast(Marks.sized(groups, "key"))
    variants = scratch.write(near.mapInArrow(partial(_variants, marks=found), wanted), "variants")
    other = F.when(F.col("kind") == WHOLE, F.col("longer")).otherwise(F.col("base"))
    met = join_unique(variants, groups, ["key"], "times").withColumn("other", other).where(F.col("other.first") < F.col("first"))
    pairs = met.groupBy(line).agg(F.min("other").alias("other")).select(*line, F.col("other.hash").alias("other_hash"), F.col("other.mark").alias("other_mark"))
    items = near.select(*line, "items")
    others = near.select(F.col("hash").alias("other_hash"), F.col("mark").alias("other_mark"), F.col("items").alias("other_items"))
    # lines of one neighbour, a template's say, may be many: it has one row
    weighed = pairs.join(items, line)
    weighed = scratch.write(weighed, "pairs")
    count = weighed.groupBy("other_hash", "other_mark").agg(F.count("*").alias("times"))
    others = scratch.write(others.join(count, ["other_hash", "other_mark"]), "others")
    checked = join_unique(weighed, others, ["other_hash", "other_mark"], "times")
    neighbours = scratch.write(checked.select(*line, "items", "other_items").mapInArrow(_edit, "hash long, mark long, ok boolean").where("ok").select(line), "neighbours")

    verdict = scratch.write(first.join(neighbours.withColumn("near", F.lit(True)), line, "left").fillna(False, ["near"]), "verdict")
    scratch.drop(some, near, groups, variants, weighed, others, first, neighbours)
    placed = join_unique(lines.select("id", "which", "number", *line), verdict, line, "times")
    return placed.select("id", "which", "number", (F.col("first") < place).alias("exact"), "near")


def line_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **how) -> DataFrame:
    """``id, n_lines, n_exact, n_near, kept_places``: one row for each row of ``docs``.

    Lines with a word; those that are exact copies of earlier ones; those that
    are near copies and not exact ones; and the sum of the numbers, from 1, of
    those that are kept. All are 0 for null and empty texts. Rows without an id
    and repeated rows have a row each.
    """
    lines = duplicate_lines(docs, id_column, text_column, **how)
    ones = lambda c: F.sum(F.expr(c).cast("long"))
    names = ["n_lines", "n_exact", "n_near", "kept_places"]
    kept = F.sum(F.when(F.col("exact") | F.col("near"), 0).otherwise(F.col("number") + 1))
    counted = lines.groupBy("id", "which").agg(F.count("*").alias("n_lines"), ones("exact").alias("n_exact"), ones("near and not exact").alias("n_near"), kept.alias("kept_places"))
    every = _rows(docs, id_column, text_column).groupBy("id", "which").agg(F.count("*").alias("times"))
    both = every.select("*", *[F.lit(0).cast("long").alias(n) for n in names]).unionByName(counted.withColumn("times", F.lit(0).cast("long")))
    # rows that repeat an id and a text have the lines of all of them together
    each = both.groupBy("id", "which").agg(F.sum("times").alias("times"), *[F.sum(n).alias(n) for n in names])
    rows = each.select("id", *[F.expr(f"{n} div times").alias(n) for n in names], F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("row"))
    return rows.drop("row")


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **how) -> DataFrame:
    """``docs`` with its text less the lines that are not the earliest; lines without words stay.

    All rows and all columns of any names stay; a null text stays null, and rows
    that repeat an id are judged by their own texts. Rows that repeat an id and
    a text keep the same lines.
    """
    found = duplicate_lines(docs, id_column, text_column, **how).where("exact or near")
    gone = found.groupBy(F.col("id").alias("gone_id"), F.col("which").alias("gone_which")).agg(F.collect_set("number").alias("gone"))
    row = docs.select(F.struct("*").alias("row"))
    id_, text = F.col("row").getField(id_column), F.col("row").getField(text_column)
    joined = row.withColumn("which", F.xxhash64(text.cast("string"))).join(gone, F.col("which").eqNullSafe(F.col("gone_which")) & id_.eqNullSafe(F.col("gone_id")), "left")

    def left(gone: Column) -> Column:
        lines = F.split(text.cast("string"), "\n", -1)
        kept = F.filter(F.transform(lines, lambda x, i: F.when(F.array_contains(gone, i.cast("long")), F.lit(None)).otherwise(x)), lambda x: x.isNotNull())
        return F.when(gone.isNull(), text).otherwise(F.array_join(kept, "\n"))

    return joined.select(*[(left(F.col("gone")) if c == text_column else F.col("row").getField(c)).alias(c) for c in docs.columns])
