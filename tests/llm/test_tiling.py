import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.llm.tiling import contamination, tile, tilings

SCHEMA = "doc_id long, text string, item_id int"


def brute_tile(item, doc, seed):
    a, b, out = [False] * len(item), [False] * len(doc), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not a[i + n] and not b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < seed:
            return out
        out.append((i, j, n))
        for x in range(n):
            a[i + x] = b[j + x] = True


@pytest.mark.parametrize("seed", range(12))
def test_tiles_are_the_greedy_ones(seed):
    rng = random.Random(seed)
    item = np.array([rng.randrange(6) for _ in range(30)], np.uint64)
    doc = np.array([rng.randrange(6) for _ in range(20)] + item[10:25].tolist() + [rng.randrange(6) for _ in range(10)] + item[:12].tolist(), np.uint64)
    assert tile(item, doc, 3) == brute_tile(item.tolist(), doc.tolist(), 3)
    assert tile(item[:2], doc, 3) == [] and tile(item, doc[:0], 3) == []


def words(text):
    return [w for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", "".join(c.lower() if ord(c) < 128 else c for c in text or ""))]


def test_documents(spark):
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(3, 50)))) for i in range(12)] + [(90, None), (91, ""), (92, "é à ü ô ï"), (0, None)]
    docs = []
    for i in range(60):
        text = rng.choices(vocabulary, k=rng.randrange(0, 60))
        if i % 3 == 0:
            w = (rng.choice(items)[1] or "").split()
            half = len(w) // 2
            text[len(text) // 2 : len(text) // 2] = [x.upper() + "," for x in (w[half:] + ["gap"] + w[:half])]
        docs.append((i, " ".join(text)))
    docs += [(100, None), (101, ""), (102, "É" + " x" * 30000 + " é à ü ô ï"), (5, docs[5][1]), (None, items[0][1])]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for i, t in docs:
        for j, u in items:
            a, b = words(u), words(t)
            if len(a) < 5 or len(b) > 1000:
                continue
            covered = sum(n for _, _, n in brute_tile(a, b, 5))
            if covered * 100 >= 50 * len(a):
                want[(i, j)] = covered
    want[(102, 92)] = 5
    got = {(r["id"], r["item_id"]): r["covered"] for r in tilings(df, bench).collect()}
    assert got == want
    found = contamination(df, bench).collect()
    assert len(found) == len(docs)
    assert {r["id"] for r in found if r["contaminated"]} == {i for i, _ in want}
    assert all(r["n_items"] == sum(i == r["id"] for i, _ in want) for r in found)
    assert (None, 0) in want


@pytest.mark.parametrize("seed", [1, 2])
def test_few_words_repeated_often(spark, seed):
    """Seeds that items and documents repeat, and that most of them share."""
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choices("ab" if rng.random() < 0.5 else "abc", k=rng.randrange(n)))
    items, docs = [(i, text(30)) for i in range(10)], [(i, text(40)) for i in range(25)]
    docs += [(30, "x " + items[0][1]), (31, items[1][1] + " x " + items[1][1]), (3, items[2][1])]
    want = {}
    for i, t in docs:
        for j, u in items:
            a, b = words(u), words(t)
            covered = sum(n for _, _, n in brute_tile(a, b, 5)) if len(a) >= 5 else 0
            if covered and covered * 100 >= 50 * len(a):
                want[(i, t, j)] = covered
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], SCHEMA)
    got = tilings(df, spark.createDataFrame(items, "item_id long, text string"))
    keyed = df.select(F.xxhash64("text").alias("which"), "text").distinct()
    assert {(r["id"], r["text"], r["item_id"]): r["covered"] for r in got.join(keyed, "which").collect()} == want


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(9)) for x in "ab")
    bench = spark.createDataFrame([(1, a)], "item_id long, text string")
    df = spark.createDataFrame([("k", a), ("k", b), (None, a), (None, b), ("l", None)], "doc_id string, text string")
    assert sorted((r["id"] or "", r["contaminated"]) for r in contamination(df, bench).collect()) == [("", False), ("", True), ("k", False), ("k", True), ("l", False)]


def test_reordered_sentences_are_caught_and_clean_ones_left(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(9)) for x in "abc")
    bench = spark.createDataFrame([(1, f"{a}. {b}. {c}.")], "item_id long, text string")
    df = spark.createDataFrame([(1, f"x {c} y {a} z {b}", 0), (2, f"x {a[:11]} y", 0), (3, f"{a}", 0)], SCHEMA)
    assert {r["id"]: r["contaminated"] for r in contamination(df, bench).collect()} == {1: True, 2: False, 3: False}


def test_item_that_repeats_a_phrase(spark):
    bench = spark.createDataFrame([(1, "yes no " * 20)], "item_id long, text string")
    df = spark.createDataFrame([(1, "so " + "yes no " * 20 + "then", 0), (2, "yes no " * 4, 0)], SCHEMA)
    assert {r["id"]: r["coverage"] for r in contamination(df, bench).collect()} == {1: 1.0, 2: 0.0}


def test_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 0)], SCHEMA)
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(df, none).first()["contaminated"] is False
    assert contamination(df.limit(0), none).collect() == []
