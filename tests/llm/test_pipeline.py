"""The pipeline against a brute-force version, on a fixture and on the smallest tables."""

import importlib
import random
from collections import Counter

import pytest

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline  # noqa: E402
from nearfield.llm.fertility import fertility  # noqa: E402
from nearfield.llm.queries import SHARD_BYTES  # noqa: E402

jaccard, tiling, sharding = (importlib.import_module(f"test_{n}") for n in ("jaccard_join", "tiling", "sharding_mixing"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, tag):
    """Prose-like words: a few common ones, many rare ones."""
    common = ["the", "of", "and", "in", "to", "that"]
    return [rng.choice(common) if rng.random() < 0.35 else "".join(rng.choices("aeioustrnlmdp", k=rng.randrange(3, 9))) + (tag if rng.random() < 0.01 else "") for _ in range(n)]


def fixture(spark, folder):
    rng = random.Random(4)
    items = [(i, " ".join(words(rng, 30, "q"))) for i in range(8)]
    docs = [(i, words(rng, rng.randrange(40, 140), "d")) for i in range(90)]
    for i, w in docs[:10]:  # leaks, some in another order
        item = items[i % 8][1].split()
        w[20:20] = item[15:] + ["between"] + item[:15] if i % 2 else item
    rows = [(i, " ".join(w), "en", f"s{i % 3 if i % 5 else 0}") for i, w in docs]
    for i, w in docs[20:40]:  # copies, exact and near
        copy = w[:]
        if i % 2:
            copy[3] = "changed"
        rows.append((100 + i, " ".join(copy), "en", "s1"))
    rows += [(200 + i, "$$ %% ## @@ " * 40, "en", "s0") for i in range(5)] + [(300, None, None, None), (301, "", "en", "s0"), (302, "too short", "en", None)]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def brute(rows, items, rejected):
    left = [r for r in rows if r[0] not in rejected]
    part, _ = jaccard.brute([r[:2] for r in left], 5, 80, 100)
    left = [r for r in left if part[r[0]] == r[0]]

    def leaks(text):
        b = tiling.words(text)
        for _, item in items:
            a = tiling.words(item)
            if len(a) >= 5 and len(set(zip(*(a[i:] for i in range(5)))) & set(zip(*(b[i:] for i in range(5))))) and 100 * sum(n for _, _, n in tiling.brute_tile(a, b, 5)) >= 50 * len(a):
                return True
        return False

    left = [r for r in left if not leaks(r[1])]
    n = Counter(r[3] or "" for r in left)
    left = [r for r in left for _ in range(sharding.draws(len(left) / len(n) / n[r[3] or ""], r[0]))]
    return brute_shards([(*r, len(r[1] or "")) for r in left], SHARD_BYTES)


def brute_shards(rows, limit):
    """Keys are whole rows, and the number of a row among those equal to it."""
    seen, keys = Counter(), []
    for r in rows:
        keys.append(sharding.bits("\x1f".join("" if x is None else str(x) for x in (*r, seen[r]))))
        seen[r] += 1
    shards = sharding.split([(k, len((r[1] or "").encode())) for k, r in zip(keys, rows)], limit)
    return Counter((r[0], r[1], shards[k]) for k, r in zip(keys, rows))


def test_copies_split(spark, tmp_path, monkeypatch):
    """Copies of few documents and rows of one id keep to the limit, but for a text above it."""
    monkeypatch.setattr(corpus_pipeline, "SHARD_BYTES", 900)
    rows = [(1, "é" * 50, "en", "s", 50)] * 200 + [(2, f"t{i % 20}" * 30, None, "s", 5) for i in range(60)] + [(None, "none", None, None, None)] * 300
    rows += [(3, "x" * 2000, "en", "s", 2000), (4, None, None, None, None), (4, None, None, None, None), (5, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = corpus_pipeline.sharded(spark, docs, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["text"], r["shard"]) for r in found) == brute_shards(rows, 900)
    size = Counter()
    for r in found:
        size[r["shard"]] += r["shard_row_bytes"]
    assert [r["doc_id"] for r in found if size[r["shard"]] > 900] == [3]


def test_fixture(spark, tmp_path):
    rows, items = fixture(spark, tmp_path)
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "shard_depth", "shard_row_bytes"]
    rejected = {r["id"] for r in fertility(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect() if not r["kept"]}
    assert rejected >= {200, 201, 202, 203, 204, 300, 301, 302} and not rejected & set(range(90))
    got = Counter((r["doc_id"], r["text"], r["shard"]) for r in found.collect())
    assert got == brute(rows, items, rejected)
    assert not {i for i, _, _ in got} & set(range(10))


def test_stages_keep_the_columns(spark, tmp_path):
    fixture(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0


def test_odd_rows(spark, tmp_path):
    """Rows without an id, of one id, with null or empty texts, and with more columns of unlucky names."""
    rows, items = fixture(spark, tmp_path)
    good, junk, leak = rows[60][1], "$$ %% ## @@ " * 40, items[0][1] + " " + items[1][1]
    odd = [(None, good, "a"), (None, junk, "b"), (None, leak, "c"), (1, good, "d"), (1, junk, "e"), (1, leak, "f"), (2, None, "g"), (3, "", "h")]
    schema = SCHEMA + ", gone_id string, gone_which string, id string, which int, copy int, shard int, row string"
    docs = spark.createDataFrame([(i, t, None, "s", 0, tag, "x", "x", 1, 2, 3, tag) for i, t, tag in odd], schema)
    stages = dict(corpus_pipeline.STAGES)
    left = lambda name: Counter((r["doc_id"], r["text"]) for r in stages[name](spark, docs, str(tmp_path)).select("doc_id", "text").collect())
    assert left("quality rules") == Counter([(None, good), (None, leak), (1, good), (1, leak)])
    assert left("benchmark decontamination") == Counter((i, t) for i, t, _ in odd if t != leak)
    assert left("n-gram Jaccard join") == Counter((i, t) for i, t, _ in odd)
    assert left("sharding") == Counter((i, t) for i, t, _ in odd)
    assert sum(left("mixing sources").values()) >= 0
    for name in list(stages)[:-1]:
        assert stages[name](spark, docs, str(tmp_path)).columns == SCHEMA.replace(",", "").split()[::2], name


@pytest.mark.parametrize("copies", [2])
def test_repeated_rows(spark, tmp_path, copies):
    rows, _ = fixture(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    twice = docs.union(docs)
    for name, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, twice, str(tmp_path)).count() == copies * stage(spark, docs, str(tmp_path)).count(), name
