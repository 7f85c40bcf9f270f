"""Vectorised words, shingles and fixed-size filters over Arrow string columns.

Words are hashed straight from the UTF-8 bytes of a whole Arrow batch: a
polynomial over the bytes, taken as differences of prefix sums, so that no
Python object is made per word. Work goes in blocks of a quarter megabyte cut
at word ends, which bounds memory for texts of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
BLOCK = 1 << 18

#: ASCII white space: the separators of the words `[^\x20\x09-\x0D]+`.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Everything in ASCII that is no letter and no digit.
NON_WORD = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32


#: The character that ends a line; no word has it.
POINT_BREAK = 10


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(30))
        x = x * U(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U(27))
        x = x * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        _POWERS["up"], _POWERS["down"] = _powers(BASE, n), _powers(INVERSE, n)
    return _POWERS["up"], _POWERS["down"]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def word_spans(buf: np.ndarray, off: np.ndarray, gaps: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in the bytes, and the number of the first word of each row."""
    gap = gaps[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    before, after = np.ones(len(buf), bool), np.ones(len(buf), bool)
    before[1:], after[:-1] = gap[:-1], gap[1:]
    starts = np.flatnonzero(~gap & (before | edge[:-1]))
    ends = np.flatnonzero(~gap & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = SAME) -> np.ndarray:
    """64-bit hashes of byte spans, which are in order and don't overlap."""
    out = np.empty(len(starts), U)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            first = starts[i]
            j = max(i + 1, int(np.searchsorted(ends, first + BLOCK, "right")))
            part = fold[buf[first : ends[j - 1]]].astype(U) + U(1)
            up, down = _tables(len(part) + 1)
            total = np.zeros(len(part) + 1, U)
            np.cumsum(part * up[: len(part)], out=total[1:])
            a, b = starts[i:j] - first, ends[i:j] - first
            out[i:j] = (total[b] - total[a]) * down[a] + (b - a).astype(U) * U(0xD6E8FEB86659FD93)
            i = j
    return mix(out)


def hash_words(column: pa.Array, gaps: np.ndarray = SPACES, fold: np.ndarray = SAME) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the number of the first word of each row (one more entry than rows)."""
    buf, off = raw(column)
    starts, ends, first = word_spans(buf, off, gaps)
    return hash_spans(buf, starts, ends, fold), first


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        out = np.full(n, k, U)
        for i in range(k):
            out = out * U(0x5851F42D4C957F2D) + words[i : i + n]
    return mix(out)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles; fewer words are one shingle, none are none."""
    return np.unique(windows(words, min(k, len(words)))) if len(words) else np.zeros(0, U)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``most`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = raw(batch.column(column))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``most`` elements of a list column, one row at least."""
    for batch in batches:
        off = np.concatenate([[0], np.cumsum(batch.column(column).value_lengths().to_numpy(zero_copy_only=False))])
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    off = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=off[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat, kind))


class Marks:
    """A set of 64-bit keys as a bitmap of bounded size: never misses a member, may hold others.

    It thins out what is joined with the keys themselves, so that a full one
    costs time and no result. Its size has a bound, so it may be broadcast.
    """

    #: Bits of the largest bitmap, as a power of two: 32 MB.
    MOST_BITS = 28

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    @classmethod
    def sized(cls, keys: DataFrame, column: str) -> Marks:
        """Of a written table of keys, with 32 bits a key or more, as far as ``MOST_BITS`` goes."""
        return cls.of(keys, column, min(cls.MOST_BITS, max(16, (32 * keys.count()).bit_length())))

    @classmethod
    def of(cls, keys: DataFrame, column: str, bits: int = 25) -> Marks:
        """From a column of keys that were hashed already. At most 2^(bits-6) rows reach the driver."""
        place = F.shiftrightunsigned(F.col(column), 64 - bits)
        rows = (
            keys.select(F.shiftrightunsigned(F.col(column), 70 - bits).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int")).alias("bit"))
            .groupBy("at")
            .agg(F.bit_or("bit").alias("word"))
        )
        got = rows.toArrow()
        words = np.zeros(1 << (bits - 6), np.int64)
        words[got.column("at").to_numpy()] = got.column("word").to_numpy()
        return cls(words.view(U), bits)

    def has(self, keys: np.ndarray) -> np.ndarray:
        place = keys >> U(64 - self.bits)
        return ((self.words[(place >> U(6)).astype(np.int64)] >> (place & U(63))) & U(1)).astype(bool)
