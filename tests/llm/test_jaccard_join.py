import random

import pytest

from nearfield.llm.jaccard_join import jaccard_components

SCHEMA = "doc_id long, text string, n int, component string, other string"


def brute(rows, k, num, den):
    sets = {}
    for i, t in rows:
        if i is None:
            continue
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = low.encode().split()
        sets.setdefault(i, []).append({tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x in range(len(ids)):
        for y in range(x):
            for a in sets[ids[x]]:
                for b in sets[ids[y]]:
                    if a and b and den * len(a & b) >= num * len(a | b):
                        p, q = find(ids[x]), find(ids[y])
                        up[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}, sets


def held(spark, rows, k=3, threshold=(90, 100), **how):
    df = spark.createDataFrame([(i, t, 7, "x", None) for i, t in rows], SCHEMA)
    found = jaccard_components(df, shingle=k, threshold=threshold, **how).collect()
    want, sets = brute(rows, k, *threshold)
    assert len(found) == len(rows)
    for r in found:
        assert r["component"] == want.get(r["id"])
        assert r["id"] is None or r["n_shingles"] in {len(s) for s in sets[r["id"]]}


def texts(seed, n, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            base = rng.choice(out).split(" ")
            for _ in range(rng.choice((0, 1, 1, 2, 3, 5))):
                at = rng.randrange(len(base))
                base[at : at + 1] = rng.choice(([], [rng.choice(vocabulary)], [base[at], "new"])) or ["z"]
            out.append(" ".join(base))
        else:
            out.append(" ".join(rng.choices(vocabulary, k=rng.randrange(1, words))))
    return list(enumerate(out))


@pytest.mark.parametrize("k, threshold, frequent", [(3, (90, 100), 8), (5, (80, 100), 2), (3, (50, 100), 3)])
def test_against_all_pairs(spark, k, threshold, frequent):
    held(spark, texts(k, 150), k, threshold, frequent=frequent)


def test_large_group_with_shared_passage(spark):
    rng = random.Random(1)
    passage = " ".join(f"p{i}" for i in range(40))
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(120):
        mine = base[:]
        for _ in range(rng.randrange(4)):
            mine[rng.randrange(150)] = f"x{rng.randrange(9999)}"
        rows.append((i, " ".join(mine)))
    rows += [(1000 + i, passage + " " + " ".join(f"q{i}_{j}" for j in range(30))) for i in range(60)]
    held(spark, rows, frequent=4)


def test_odd_rows(spark):
    long = " ".join(f"t{i % 5000}" for i in range(30000))
    rows = [(5, "A b\tC"), (3, "a B\nc"), (4, "a b"), (2, "A B"), (7, None), (8, ""), (9, " \n\t"), (1, "one"), (5, "A b\tC"), (None, "a b c"), (10, long), (11, long + " end"), (12, "é É"), (13, "É É"), (4, "a b c")]
    held(spark, rows)


def test_empty(spark):
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).collect() == []
    held(spark, [(1, None), (2, "")])
