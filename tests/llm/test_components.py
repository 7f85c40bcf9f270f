import random

import pytest

from nearfield.llm.components import components
from nearfield.llm.store import Scratch


def plain(links):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in (x for x in links if x[0] != x[1]):
        p, q = find(a), find(b)
        up[max(p, q)] = min(p, q)
    return {x: find(x) for x in list(up)}


def graph(kind):
    rng = random.Random(kind)
    ids = rng.sample(range(-500, 5000), 300)
    return {
        "sparse": [tuple(rng.sample(ids, 2)) for _ in range(140)],
        "dense": [tuple(rng.sample(ids, 2)) for _ in range(600)],
        "path": list(zip(ids, ids[1:])),
        "star": [(ids[0], x) for x in ids[1:]] + [(x, x) for x in ids[:5]],
        "roots": [(10, 1), (10, 2), (11, 2), (11, 3), (12, 3), (12, 0), (20, 4), (21, 4), (21, 5)],
        "loops": [(7, 7), (7, 7), (3, 3)],
    }[kind]


@pytest.mark.parametrize("kind", ["sparse", "dense", "path", "star", "roots", "loops"])
def test_components(spark, kind):
    links = graph(kind)
    df = spark.createDataFrame(links, "a long, b long")
    found = components(df, Scratch(spark, "test")).collect()
    assert {r["id"]: r["component"] for r in found} == plain(links) and len(found) == len(plain(links))


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).collect() == []
