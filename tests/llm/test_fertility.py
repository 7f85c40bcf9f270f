import math
import re
import struct
from collections import Counter, defaultdict

import pytest

from nearfield.llm import fertility as module
from nearfield.llm.fertility import Band, Cache, Pieces, fertility

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = "The quick brown fox jumps over the lazy dog while seven tired editors argue about commas, semicolons and whether anyone still reads the footnotes of a long report on river traffic in the north. "
TEXTS = [
    PROSE,
    PROSE * 3,
    "a\nb\na\n\n\na \nb\n x",
    "one two three four five six seven eight nine " * 2,
    "$$ %% ## " * 30,
    "naïve café — 東京 ☃ " * 5,
    "",
    None,
    " \t\n",
    "x" * 5000,
    " ".join(f"word{i}" for i in range(30000)),
    "non breaking spaces\x1cstay",
]


def brute(text):
    w = WORD.findall(text or "")
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_counts_and_measures(spark):
    rows = [(i, t, "en", 1) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], None, 2), (None, TEXTS[1], "en", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int")
    found = fertility(df).collect()
    assert len(found) == len(rows)
    model = Pieces(open("/opt/tokenizers/piece_bpe_32k.model", "rb").read())  # noqa: SIM115
    for r in found:
        text = TEXTS[1] if r["id"] is None else TEXTS[r["id"]]
        n, chars, symbols, dup, repeated = brute(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeated)
        assert r["base_failed"] == (n < 20 or 100 * repeated > 30 * n)
        assert r["kept"] == (not r["base_failed"] and r["in_band"])
        tokens = [t for w in WORD.findall(text or "") for t in model.encode([w])[0]]
        assert r["piece_bpe_32k_tokens"] == len(tokens)
        if tokens:
            share = Counter(tokens)
            assert r["piece_bpe_32k_chars_per_token"] == pytest.approx(chars / len(tokens))
            assert r["piece_bpe_32k_byte_share"] == pytest.approx(sum(bool(model.is_byte[t]) for t in tokens) / len(tokens))
            assert r["piece_bpe_32k_entropy"] == pytest.approx(-sum(c / len(tokens) * math.log2(c / len(tokens)) for c in share.values()), abs=1e-9)


def test_bands(spark):
    rows = [(0, PROSE, "en"), (1, "$$ %% ## @@ " * 30, "en"), (2, PROSE, "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["id"]: r["kept"] for r in fertility(df).collect()} == {0: True, 1: False, 2: True}
    strict = {"xx": Band((50, 60), 0.0, (0, 0, 0))}
    assert {r["id"]: r["in_band"] for r in fertility(df, bands=strict).collect()}[2] is False
    assert {r["id"]: r["in_band"] for r in fertility(df, bands=strict).collect()}[0] is True


def test_bands_of_short_texts(spark):
    words = "the of and to in for is on that by this with you it not or be are from at as your all have new more an was we will".split()
    df = spark.createDataFrame([(1, " ".join(f"{w} {w}" for w in words), "en"), (2, PROSE, "en")], "doc_id long, text string, lang string")
    found = {r["id"]: r for r in fertility(df).collect()}
    assert 40 <= found[1]["piece_bpe_32k_tokens"] < 80 and not found[1]["base_failed"]
    assert {i: r["kept"] for i, r in found.items()} == {1: False, 2: True}


def test_no_text_goes_without_a_verdict(spark):
    rows = [(1, "aa " * 21), (2, "the " * 24), (3, PROSE[:140])]
    found = {r["id"]: r for r in fertility(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r["in_band"] for i, r in found.items()} == {1: False, 2: False, 3: True}
    narrow = {"latin": Band((50, 60), 0.0, (0, 0, 0))}
    assert not any(r["in_band"] for r in fertility(spark.createDataFrame([(1, PROSE), (2, PROSE[:140])], "doc_id long, text string"), bands=narrow).collect())


def test_cache_of_a_large_vocabulary_is_bounded(monkeypatch):
    class Large:
        def encode(self, words):
            return [[len(w), 200_000] for w in words]

    monkeypatch.setattr(module, "CACHED", 2000)
    cache = Cache(Large())
    for i in range(200):
        packed = cache.tokens([i, i + 1], lambda j: "x" * (70_000 + j))
        assert [struct.unpack("<2I", p)[1] for p in packed] == [200_000] * 2
        assert sum(module.ENTRY + len(v) for v in cache.new.values()) <= 2000 + 2 * (module.ENTRY + 8)


def test_empty_and_no_language(spark):
    assert fertility(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert fertility(spark.createDataFrame([(1, PROSE)], "doc_id long, text string")).first()["kept"] is True
