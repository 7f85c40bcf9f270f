import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from nearfield.llm.line_dedup import deduplicated, duplicate_lines, line_counts

SCHEMA = "doc_id long, text string, near boolean"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def brute(rows, least=4):
    """Verdicts of the lines of rows, by id (null last), text and number."""
    place = lambda i, t, n: (i is None, i or 0, t, n)
    lines = []
    for i, t in set(rows):
        for n, x in enumerate((t or "").split("\n")):
            w = re.findall(r"[^\x20\x09-\x0D]+", x)
            if w:
                lines.append((place(i, t, n), len(w) < least, tuple(" ".join(w) if len(w) < least else w)))
    firsts = {}
    for p, short, w in sorted(lines):
        firsts.setdefault((short, w), p)
    near = {k: any(k[0] == j[0] and firsts[j] < firsts[k] and one_edit(j[1], k[1]) for j in firsts) for k in firsts}
    return {p: (firsts[short, w] < p, near[short, w]) for p, short, w in lines}


def held(spark, rows, least=4):
    df = spark.createDataFrame([(i, t, False) for i, t in rows], SCHEMA)
    text = {r["which"]: r["text"] for r in df.select(F.xxhash64("text").alias("which"), "text").collect()}
    found = duplicate_lines(df, least_words=least).collect()
    want = brute(rows, least)
    got = {(r["id"] is None, r["id"] or 0, text[r["which"]], r["number"]): (r["exact"], r["near"]) for r in found}
    assert got == want
    counted = Counter((r["id"], r["n_lines"], r["n_exact"], r["n_near"], r["kept_places"]) for r in line_counts(df, least_words=least).collect())
    sums = Counter()
    for i, t in rows:
        mine = {p[3]: v for p, v in want.items() if p[:3] == (i is None, i or 0, t)}
        sums[(i, len(mine), sum(e for e, _ in mine.values()), sum(n and not e for e, n in mine.values()), sum(p + 1 for p, v in mine.items() if not any(v)))] += 1
    assert counted == sums
    return df


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    lines = []
    for _ in range(150):
        if lines and rng.random() < 0.7:
            w = rng.choice(lines).split()
            for _ in range(rng.choice((0, 1, 1, 2))):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice(([], [f"n{rng.randrange(50)}"], [w[at], f"m{rng.randrange(50)}"])) or ["z"]
            lines.append(" ".join(w))
        else:
            lines.append(" ".join(rng.choices([f"w{i}" for i in range(100)], k=rng.randrange(1, 20))))
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randrange(1, 8)))) for i in range(60)]
    held(spark, rows)


def test_template_with_many_variants(spark):
    held(spark, [(i, f"page {i % 150} of the very long report\nsame line in all of them") for i in range(200)])


def test_lines_of_few_words(spark):
    ten = " ".join(f"t{i}" for i in range(10))
    rows = [(1, "copyright 2019 the river company"), (2, "copyright 2020 the river company"), (3, ten), (4, ten[:-3]), (5, "menu for monday evening"), (6, "menu for sunday evening")]
    rows += [(7, "page one here"), (8, "page two here"), (9, "Page one here"), (10, "Ääkkönen"), (11, "Aäkkönen"), (12, "x"), (13, "y"), (14, "漢字"), (15, "漢字仮"), (16, "one two three"), (17, "one two three four")]
    df = held(spark, rows)
    assert {r["id"] for r in duplicate_lines(df).where("near").collect()} == {2, 4, 6, 9, 11, 13, 14, 15} - {14}


def test_planted_near_copies(spark):
    """Every line of a table, once more with one word changed, added or left out: all are found."""
    rng = random.Random(9)
    lines = [" ".join(f"{rng.randrange(5000)}w" for _ in range(rng.randrange(4, 60))) for _ in range(300)]
    rows = [(i, x) for i, x in enumerate(lines)]
    for i, x in enumerate(lines):
        w = x.split()
        at = rng.randrange(len(w))
        if i % 3 == 0:
            w[at] = "changed"
        elif i % 3 == 1:
            w.insert(at, "added")
        elif len(w) > 4:
            del w[at]
        rows.append((1000 + i, " ".join(w)))
    found = duplicate_lines(spark.createDataFrame([(i, t, False) for i, t in rows], SCHEMA)).where("exact or near").collect()
    assert {r["id"] for r in found} == set(range(1000, 1300))


def test_ids_of_text(spark):
    df = spark.createDataFrame([("b", "a b c d e"), ("a", "a b c d f"), (None, "a b c d e")], "doc_id string, text string")
    assert {r["id"]: (r["exact"], r["near"]) for r in duplicate_lines(df).collect()} == {"a": (False, False), "b": (False, True), None: (True, True)}


def test_odd_rows(spark):
    long = " ".join(f"t{i}" for i in range(20000))
    rows = [(1, None), (2, ""), (3, "\n\n \n"), (4, "a b c d e\r\nA b c d e"), (5, " a  b\tc d e \n\nx"), (6, long), (7, long + " more"), (8, "short"), (9, "short"), (None, "a b c d e"), (4, "a b c d e\r\nA b c d e")]
    held(spark, rows)


def test_text_that_is_left(spark):
    df = spark.createDataFrame([(1, "a b c d e\n\nkeep it", True), (2, "a b c d x\nown line", True), (3, None, True), (4, "a b c d e", True)], SCHEMA)
    assert {r["doc_id"]: r["text"] for r in deduplicated(df).collect()} == {1: "a b c d e\n\nkeep it", 2: "own line", 3: None, 4: ""}


def test_rows_of_one_id_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c d e", 1), (2, "unique words\nbar", 2), (2, "a b c d e\nother words", 3), (None, "foo bar baz\na b c d e", 4), (2, "unique words\nbar", 5)], "gone_id long, text string, which long")
    found = {r["which"]: r["text"] for r in deduplicated(df, "gone_id").collect()}
    assert found == {1: "a b c d e", 2: "unique words\nbar", 3: "other words", 4: "foo bar baz", 5: "unique words\nbar"}


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert duplicate_lines(none).collect() == [] and line_counts(none).collect() == [] and deduplicated(none).collect() == []
