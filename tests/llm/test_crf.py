import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from nearfield.llm.crf import FEATURE_BITS, GAPS, Model, Sample, features, identify, marginals
from nearfield.llm.textops import LOWER, U, hash_spans, mix, raw, word_spans

WORDS = {
    "en": "the and of that with which there their would about people through water house night light".split(),
    "de": "der und die nicht sich auch werden haben zwischen schließlich wasser haus nacht licht über straße".split(),
    "fr": "le et les dans pour avec être cette entre beaucoup toujours l'eau maison nuit lumière français".split(),
}


def rows(seed, n):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(rng.choice(WORDS[lang], int(rng.integers(5, 60)))), lang, "s") for i, lang in enumerate(rng.choice(list(WORDS), n))]


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    k, sizes = 3, (4, 1, 3)
    model = Model(list("abc"), np.zeros((1, k)), rng.normal(size=(k, k)), rng.normal(size=k))
    first = np.concatenate([[0], np.cumsum(sizes)])
    emit = rng.normal(size=(first[-1], k)) * 3
    p, pairs, log_z = marginals(emit, first, model)
    want, want_pairs, want_z = np.zeros_like(p), np.zeros((k, k)), 0.0
    for a, n in zip(first, sizes):
        total, mass, moves = 0.0, np.zeros((n, k)), np.zeros((k, k))
        for path in itertools.product(range(k), repeat=n):
            s = model.initial[path[0]] + sum(emit[a + t, y] for t, y in enumerate(path)) + sum(model.transition[x, y] for x, y in zip(path, path[1:]))
            e = np.exp(s)
            total += e
            for t, y in enumerate(path):
                mass[t, y] += e
            for x, y in zip(path, path[1:]):
                moves[x, y] += e
        want[a : a + n], want_z = mass / total, want_z + np.log(total)
        want_pairs += moves / total
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs) and np.isclose(log_z, want_z)
    assert np.allclose(marginals(np.zeros((0, k)), np.array([0, 0, 0]), model)[1], 0)


def test_training_descends_the_likelihood():
    """Derivatives against finite differences of the log-likelihood over all paths."""
    rng = np.random.default_rng(3)
    k, words, weights = 3, 5, 7
    sizes = rng.integers(1, 4, words)
    found, at = rng.integers(0, weights, sizes.sum()), np.concatenate([[0], np.cumsum(sizes)])
    begin = np.array([0, 4, 5, 9])
    flat, gold = rng.integers(0, words, 9), rng.integers(0, k, 9)
    sample = Sample(found, at, flat, gold, begin, k)
    w, move, start = rng.normal(size=(weights, k)), rng.normal(size=(k, k)), rng.normal(size=k)
    model = lambda move, start: Model(list("abc"), np.zeros((1, k)), move, start)

    def plain(w, move, start):
        emit = np.array([w[found[a:b]].sum(0) / np.sqrt(b - a) for a, b in zip(at, at[1:])])
        total = 0.0
        for a, b in zip(begin, begin[1:]):
            score = lambda path: start[path[0]] + sum(emit[flat[a + t], y] for t, y in enumerate(path)) + sum(move[x, y] for x, y in zip(path, path[1:]))  # noqa: B023, E731
            total += score(gold[a:b]) - np.log(sum(np.exp(score(path)) for path in itertools.product(range(k), repeat=b - a)))
        return total

    value, *by = sample.likelihood(w, model(move, start))
    assert np.isclose(value, plain(w, move, start))
    for n, g in enumerate(by):
        for i in np.ndindex(g.shape):
            sides = []
            for step in (1e-5, -1e-5):
                at_ = [w.copy(), move.copy(), start.copy()]
                at_[n][i] += step
                sides.append(plain(*at_))
            assert np.isclose(g[i], (sides[0] - sides[1]) / 2e-5, atol=1e-6)


def test_features_are_all_ngrams_of_the_whole_word():
    texts = ["a ab Straße", "x" * 40 + "y", "一" * 30 + " é", "thequickbrownfoxjumpsoverthelazydogagain", "", "thequickbrownfoxJUMPEDoverthelazydogagain"]
    buf, off = raw(pa.array(texts))
    starts, ends, _ = word_spans(buf, off, GAPS)
    keys = hash_spans(buf, starts, ends, LOWER)
    found, at = features(buf, starts, ends, keys)
    cut = lambda x: int(mix(np.array([x], U))[0] >> U(64 - FEATURE_BITS))
    for i, (s, e) in enumerate(zip(starts, ends)):
        w = [1, *(int(LOWER[b]) + 2 for b in buf[s:e]), 1]
        want = [int(keys[i] >> U(64 - FEATURE_BITS))]
        for g in (2, 3, 4):
            want += [cut((sum(x * 257 ** (g - 1 - k) for k, x in enumerate(w[j : j + g])) + (g << 50)) % 2**64) for j in range(len(w) - g + 1)]
        assert found[at[i] : at[i + 1]].tolist() == want
    assert set(found[at[-3] : at[-2]].tolist()) != set(found[at[-2] : at[-1]].tolist())


def test_long_texts_train_too(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(WORDS[lang], 3000)), lang) for i, lang in enumerate(["en", "de"] * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {(r["id"] % 2, r["lang_pred"]) for r in identify(df, F.lit(True), longest=500).collect()} == {(0, "en"), (1, "de")}


def test_held_out_accuracy_and_switches(spark):
    df = spark.createDataFrame(rows(1, 300), "doc_id long, text string, lang string, source string")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    found = identify(df, ~held).join(df.select(F.col("doc_id").alias("id"), "lang", held.alias("held")), "id").collect()
    tested = [r for r in found if r["held"]]
    assert len(found) == 300 and len(tested) > 40
    assert np.mean([r["lang"] == r["lang_pred"] for r in tested]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found)
    both = " ".join(WORDS["en"] + WORDS["de"][:6])
    mixed = df.limit(0).union(spark.createDataFrame([(5000, both, None, "s")], df.schema)).union(df)
    one = [r for r in identify(mixed, (F.col("doc_id") != 5000) & ~held).collect() if r["id"] == 5000][0]
    assert one["lang_pred"] == "en" and one["n_switches"] >= 1 and one["score"] < 0.95


def test_odd_rows(spark):
    odd = [(900, None, "en", ""), (901, "", "en", ""), (902, "123 +-* 4.5", "en", ""), (903, "… ½ ☃", "de", ""), (904, "the " * 40000, None, ""), (904, "the and of", None, ""), (None, "der und die", None, ""), (905, "東京", None, "")]
    df = spark.createDataFrame(rows(2, 90) + odd, "doc_id long, text string, lang string, lang_pred string")
    found = identify(df, F.lit(True)).collect()
    assert len(found) == 98
    by = {r["id"]: r for r in found}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (900, 901, 902, 903))
    assert by[904]["lang_pred"] == "en" and by[None]["lang_pred"] == "de" and by[905]["lang_pred"] in WORDS


def test_nothing_to_learn(spark):
    schema = "doc_id long, text string, lang string"
    assert identify(spark.createDataFrame([], schema), F.lit(True)).collect() == []
    assert identify(spark.createDataFrame([(1, "the", None)], schema), F.lit(True)).first()["lang_pred"] == "und"
    assert identify(spark.createDataFrame([(1, "the", "en"), (2, None, "en")], schema), F.lit(True)).where("id = 1").first()["lang_pred"] == "en"
