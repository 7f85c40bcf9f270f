"""Quality rules from tokeniser fertility.

Public vocabularies, read from ``tokenizers`` (a folder, by default
``/opt/tokenizers``) and never trained or copied, measure each text: characters
per token and token entropy under every vocabulary, and the share of
byte-fallback tokens under the one that has them. A band per language, or per
script where the language has none, says what to reject.

The words of a batch are hashed, and each distinct word is tokenised once, alone
and with the space before it; what a word gives is kept in a cache of bounded
size. The broadcast vocabularies are fixed public files of under 1 MB each.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.store import ready
from nearfield.llm.textops import SPACES, U, hash_spans, mix, raw, slices, windows, word_spans

WINDOW = 8
#: Bytes of tokens that a worker keeps for a vocabulary in each of two generations, and what an entry takes beside its tokens.
CACHED, ENTRY = 12 << 20, 180
#: Tokens from which on a band holds as it stands.
SETTLED = 40
SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[list(b"#*$%&|<>")] = 1
#: A byte that begins a code point.
POINT = np.array([not 0x80 <= i < 0xC0 for i in range(256)])

SCRIPTS = ("none", "latin", "greek", "cyrillic", "hebrew", "arabic", "indic", "kana", "han", "hangul", "other")


def _script_table() -> np.ndarray:
    """Script by the first byte of a UTF-8 character."""
    out = np.zeros(256, np.int64)
    spans = {"latin": ((0x41, 0x5B), (0x61, 0x7B), (0xC3, 0xCA)), "greek": ((0xCD, 0xD0),), "cyrillic": ((0xD0, 0xD4),), "hebrew": ((0xD7, 0xD8),), "arabic": ((0xD8, 0xDC),), "indic": ((0xE0, 0xE1),), "kana": ((0xE3, 0xE4),), "han": ((0xE4, 0xEA),), "hangul": ((0xEA, 0xEE),), "other": ((0xCA, 0xCD), (0xD4, 0xD7), (0xDC, 0xE0), (0xE1, 0xE3), (0xEE, 0xF8))}
    for name, parts in spans.items():
        for a, b in parts:
            out[a:b] = SCRIPTS.index(name)
    return out


SCRIPT_OF = _script_table()


@dataclass(frozen=True)
class Band:
    """What a text may have.

    ``chars_per_token`` is the range under the first vocabulary and
    ``byte_share`` the most of its tokens that may be byte fallbacks. The token
    entropy of prose grows with its length until common words saturate it, so
    its floor is ``entropy[0] + entropy[1] * log2(tokens / 128)`` bits, at most
    ``entropy[2]`` and at most 0.9 of the entropy of tokens that never repeat.
    ``second`` is the range of characters per token under the second vocabulary,
    if there is one.

    The measures of a few tokens scatter with the inverse root of their number,
    so below ``SETTLED`` tokens every bound is wider, by the share
    ``sqrt(SETTLED / tokens) - 1``: no text goes without a verdict.
    """

    chars_per_token: tuple[float, float]
    byte_share: float
    entropy: tuple[float, float, float]
    second: tuple[float, float] = (0.1, 12.0)


#: By language or script. Wide: a rule rejects what is far from prose, not what is rare.
BANDS = {
    "latin": Band((1.45, 6.5), 0.02, (5.35, 0.3, 6.3), (1.4, 6.5)),
    "greek": Band((0.7, 4.0), 0.05, (4.0, 0.25, 5.0)),
    "cyrillic": Band((1.0, 5.0), 0.05, (4.5, 0.25, 5.5)),
    "hebrew": Band((0.5, 4.0), 0.10, (3.5, 0.25, 4.5)),
    "arabic": Band((0.5, 4.0), 0.10, (3.5, 0.25, 4.5)),
    "indic": Band((0.3, 4.0), 0.60, (3.0, 0.25, 4.0)),
    "kana": Band((0.4, 3.0), 0.40, (4.0, 0.25, 5.0)),
    "han": Band((0.35, 3.0), 0.70, (4.0, 0.25, 5.0)),
    "hangul": Band((0.3, 3.0), 0.80, (3.5, 0.25, 4.5)),
    "other": Band((0.2, 8.0), 1.00, (2.0, 0.2, 3.0)),
    "none": Band((0.2, 8.0), 1.00, (2.0, 0.2, 3.0)),
}


class Pieces:
    """A sentencepiece model with byte fallback."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.size)])

    def encode(self, words: list[str]) -> list[list[int]]:
        return self.model.encode(words, num_threads=1)


class Ranks:
    """A byte-level vocabulary: its "byte fallbacks" are tokens that end within a character."""

    def __init__(self, data: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        # fixed value: the split pattern that this public vocabulary is published with
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.model = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1
        self.is_byte = np.zeros(self.size, bool)
        for token, i in ranks.items():
            self.is_byte[i] = len(token) == 1 and token[0] >= 0x80

    def encode(self, words: list[str]) -> list[list[int]]:
        one = self.model.encode_ordinary
        return [one(" " + w) for w in words]


class Cache:
    """Tokens of words, packed in four bytes each, by the words' hashes: two generations of bounded bytes, the older is dropped when the newer is full."""

    def __init__(self, vocabulary):
        self.vocabulary, self.new, self.old, self.held = vocabulary, {}, {}, 0

    def tokens(self, keys: list[int], word) -> list[bytes]:
        """Packed tokens of each key; ``word(i)`` is the i-th word as a string."""
        out, missing = [], []
        new, old = self.new, self.old
        for i, key in enumerate(keys):
            got = new.get(key)
            if got is None:
                got = old.get(key)
                if got is None:
                    missing.append(i)
                else:
                    new[key] = got
                    self.held += ENTRY + len(got)
            out.append(got)
        if missing:
            for i, got in zip(missing, self.vocabulary.encode([word(i) for i in missing]), strict=True):
                out[i] = new[keys[i]] = struct.pack(f"<{len(got)}I", *got)
                self.held += ENTRY + len(out[i])
        if self.held > CACHED:
            self.new, self.old, self.held = {}, new, 0
        return out


_LOADED: dict[str, Cache] = {}


def _load(name: str, data: bytes) -> Cache:
    if name not in _LOADED:
        _LOADED[name] = Cache(Pieces(data) if name.endswith(".model") else Ranks(data))
    return _LOADED[name]


def repeated(words: np.ndarray, first: np.ndarray, k: int = WINDOW) -> np.ndarray:
    """For each row, the words in k-word windows that its text has twice or more."""
    n = np.diff(first)
    of = np.repeat(np.arange(len(n)), n)
    keys = windows(words, k)
    inside = of[: len(keys)] == of[k - 1 :][: len(keys)] if len(keys) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    keys = keys[at] ^ mix(of[at].astype(U) + U(1))
    order = np.sort(keys)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    covered = np.zeros(len(words) + 1, np.int64)
    if len(twice):
        place = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
        hit = at[twice[place] == keys]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + k, -1)
    total = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
    return total[first[1:]] - total[first[:-1]]


def duplicate_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def _entropy(tokens: np.ndarray, of: np.ndarray, rows: int) -> np.ndarray:
    """Entropy in bits of the tokens of each row."""
    keys = np.sort((of << 32) | tokens)
    if not len(keys):
        return np.zeros(rows)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    n = np.diff(np.append(at, len(keys)))
    row = keys[at] >> 32
    total = np.bincount(row, n, rows)
    part = np.bincount(row, n * np.log2(n), rows)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(total > 0, np.maximum(0, np.log2(total) - part / total), 0.0)


def measure(batches: Iterator[pa.RecordBatch], vocabularies) -> Iterator[pa.RecordBatch]:
    loaded = [(name.split(".")[0], _load(name, data)) for name, data in vocabularies.value.items()]
    for batch in slices(batches, "text", 1 << 19):
        buf, off = raw(batch.column("text"))
        starts, ends, first = word_spans(buf, off)
        words = hash_spans(buf, starts, ends)
        n_words, rows = np.diff(first), batch.num_rows

        def per_row(flags: np.ndarray, off: np.ndarray = off) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(flags)])
            return total[off[1:]] - total[off[:-1]]

        word_chars = per_row(POINT[buf] & ~SPACES[buf])
        script = np.bincount(np.repeat(np.arange(rows), np.diff(off)) * len(SCRIPTS) + SCRIPT_OF[buf], minlength=rows * len(SCRIPTS)).reshape(rows, -1)
        script[:, 0] = 0
        cols = {
            "id": batch.column("id"),
            "lang": batch.column("lang"),
            "n_words": n_words,
            "word_chars": word_chars,
            "n_symbols": per_row(SYMBOLS[buf]),
            "n_dup_lines": [duplicate_lines(t or "") for t in batch.column("text").to_pylist()],
            "n_repeat_words": repeated(words, first),
            "script": pa.array([SCRIPTS[i] for i in np.argmax(script, 1)]),
        }
        distinct, where, inverse = np.unique(words, return_index=True, return_inverse=True)
        keys = distinct.tolist()
        data = buf.tobytes()
        word = lambda i, d=data, s=starts[where], e=ends[where]: d[s[i] : e[i]].decode("utf-8", "replace")
        of_word = np.repeat(np.arange(rows), n_words)
        for name, cache in loaded:
            packed = cache.tokens(keys, word)
            size = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
            flat = np.frombuffer(b"".join(packed), "<u4").astype(np.int64)
            at = np.concatenate([[0], np.cumsum(size)])
            per_word = size[inverse]
            begin = np.repeat(at[:-1][inverse] - np.concatenate([[0], np.cumsum(per_word)[:-1]]), per_word) if len(inverse) else np.zeros(0, np.int64)
            tokens = flat[begin + np.arange(len(begin))]
            of = np.repeat(of_word, per_word)
            n = np.bincount(of, minlength=rows)
            with np.errstate(divide="ignore", invalid="ignore"):
                cols[f"{name}_tokens"] = n.astype(np.int64)
                cols[f"{name}_chars_per_token"] = np.where(n > 0, word_chars / n, 0.0)
                cols[f"{name}_byte_share"] = np.where(n > 0, np.bincount(of, cache.vocabulary.is_byte[tokens], rows) / n, 0.0)
            cols[f"{name}_entropy"] = _entropy(tokens, of, rows)
        yield pa.record_batch(cols)


def fertility(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str | None = "lang", tokenizers: str = "/opt/tokenizers", vocabularies: tuple[str, ...] = ("piece_bpe_32k.model", "byte_bpe_50k.tiktoken"), bands: dict[str, Band] | None = None, least_words: int = 20, most_repeated: int = 30) -> DataFrame:
    """One row of measures for each row: ``id``, counts, fertility per vocabulary, ``base_failed``, ``in_band``, ``kept``.

    Words are ``[^\\x20\\x09-\\x0D]+``. A text fails the base rules with fewer
    than ``least_words`` words or more than ``most_repeated`` percent of them in
    repeated eight-word windows. ``in_band`` holds the measures against the band
    of the row's language (if ``bands`` has it) or of its script; ``kept`` is
    both. Null and empty texts have no words and fail.
    Rows are measured alone: repeated rows and null ids give a row each, an
    empty table gives none, and other columns are not read. The language is
    null where the table has no such column.
    """
    ready(docs.sparkSession)
    spark = docs.sparkSession
    bands = BANDS | (bands or {})
    held = spark.sparkContext.broadcast({v: open(f"{tokenizers}/{v}", "rb").read() for v in vocabularies})  # noqa: SIM115
    has_lang = lang_column is not None and lang_column in docs.columns
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"), (F.col(lang_column).cast("string") if has_lang else F.lit(None).cast("string")).alias("lang"))
    names = [v.split(".")[0] for v in vocabularies]
    schema = f"id {docs.schema[id_column].dataType.simpleString()}, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, " + ", ".join(f"{n}_tokens long, {n}_chars_per_token double, {n}_byte_share double, {n}_entropy double" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return measure(batches, held)

    per_language = [x for x in bands if x not in SCRIPTS]
    measured = rows.mapInArrow(run, schema).withColumn("band", F.when(F.col("lang").isin(per_language), F.col("lang")).otherwise(F.col("script")) if per_language else F.col("script"))
    v = names[0]
    tokens = F.greatest(F.col(f"{v}_tokens"), F.lit(1))
    wider = F.greatest(F.lit(1.0), F.sqrt(SETTLED / tokens))

    def within(column: str, low: float, high: float) -> Column:
        return F.col(column).between(F.lit(low) / wider, F.lit(high) * wider)

    verdict = F.lit(True)
    for name, band in bands.items():
        floor = F.least(F.lit(band.entropy[2]), band.entropy[0] + band.entropy[1] * F.log2(tokens / 128), 0.9 * F.log2(tokens)) / wider
        inside = within(f"{v}_chars_per_token", *band.chars_per_token) & (F.col(f"{v}_byte_share") <= band.byte_share * wider) & (F.col(f"{v}_entropy") >= floor)
        if len(names) > 1:
            inside = inside & within(f"{names[1]}_chars_per_token", *band.second)
        verdict = F.when(F.col("band") == name, (F.col(f"{v}_tokens") == 0) | inside).otherwise(verdict)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("in_band", verdict).withColumn("kept", ~F.col("base_failed") & F.col("in_band")).drop("lang")
