"""Toxicity from confirmed toxic examples and unlabelled text: non-negative PU learning.

A linear model over the words of a text is trained with the class-prior
corrected risk ``prior * R+(toxic) + max(0, R-(unlabelled) - prior * R-(toxic))``;
where the second part of a batch falls below zero, the step goes up that part
instead, which keeps a flexible model from calling the known examples the only
ones. Nobody's label of a harmless text is used as a negative.

Words are hashed to a table of fixed size. A word counts once per text, scaled
by the smoothed log-ratio of how often toxic and (prior-corrected) other texts
have it, so that few examples suffice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.crf import stretch
from nearfield.llm.store import ready
from nearfield.llm.textops import LOWER, NON_WORD, U, hash_words, slices

BITS = 20


@dataclass
class Model:
    keys: np.ndarray  # sorted hashes of the words that count
    weights: np.ndarray
    bias: float

    def scores(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probability for each text: each distinct known word counts once."""
        rows = len(first) - 1
        total = np.full(rows, self.bias)
        if len(self.keys) and len(words):
            place = np.minimum(np.searchsorted(self.keys, words), len(self.keys) - 1)
            known = self.keys[place] == words
            of = np.repeat(np.arange(rows), np.diff(first))[known]
            pairs = np.unique(of * len(self.keys) + place[known])
            total += np.bincount(pairs // len(self.keys), self.weights[pairs % len(self.keys)], rows)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _words(texts: list[str]) -> list[np.ndarray]:
    words, first = hash_words(pa.array(texts, pa.string()), NON_WORD, LOWER)
    return [np.unique(words[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


def _padded(rows: list[np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Column numbers of known words, flat, and the row of each."""
    cols, of = [], []
    for i, r in enumerate(rows):
        place = np.minimum(np.searchsorted(keys, r), len(keys) - 1)
        hit = place[keys[place] == r]
        cols.append(hit)
        of.append(np.full(len(hit), i))
    return np.concatenate(cols), np.concatenate(of)


def risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The logistic risk of scores of toxic and of unlabelled texts, and what the step descends.

    The positive part, the corrected negative part (that of the unlabelled texts
    less the toxic ones' share of it), and derivatives by the scores: of the sum
    of the parts, or, where the corrected part is below zero, of that part
    reversed.
    """
    n_pos, n_unl = max(1, len(zp)), max(1, len(zu))
    sp, su = 1 / (1 + np.exp(-np.clip(zp, -40, 40))), 1 / (1 + np.exp(-np.clip(zu, -40, 40)))
    # losses: positive -log s, negative -log(1 - s)
    positive = prior * -np.log(np.maximum(sp, 1e-12)).sum() / n_pos
    corrected = -np.log(np.maximum(1 - su, 1e-12)).sum() / n_unl - prior * (-np.log(np.maximum(1 - sp, 1e-12)).sum() / n_pos)
    if corrected >= 0:
        return positive, corrected, prior * (sp - 1) / n_pos - prior * sp / n_pos, su / n_unl
    return positive, corrected, prior * sp / n_pos, -su / n_unl


def train(toxic: list[str], unlabelled: list[str], prior: float, seed: int = 5, rounds: int = 60, least: int = 3, most_words: int = 20_000, evidence: float = 15.0, decay: float = 3e-4, rate: float = 0.05) -> Model:
    """A model from texts; ``prior`` is the share of toxic texts among the unlabelled."""
    nothing = Model(np.zeros(0, U), np.zeros(0), -2.0)
    if not toxic or not unlabelled:
        return nothing
    prior = float(np.clip(prior, 0.005, 0.6))
    pos, unl = _words(toxic), _words(unlabelled)
    all_pos, all_unl = np.concatenate(pos), np.concatenate(unl)
    keys, n = np.unique(np.concatenate([all_pos, all_unl]), return_counts=True)
    keys = keys[n >= least]
    if not len(keys):
        return nothing

    def share(found: np.ndarray, rows: int) -> np.ndarray:
        place = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
        return np.bincount(place[keys[place] == found], minlength=len(keys)) / rows

    p, u = share(all_pos, len(pos)), share(all_unl, len(unl))
    other = np.maximum((u - prior * p) / (1 - prior), 0)
    smooth = 2.0 / len(pos)
    ratio = np.log((p + smooth) / (other + smooth))
    # likelihood ratio of the toxic texts' share against the others' share: chance alone rarely passes
    q, r = np.clip(p, 1e-9, 1 - 1e-9), np.clip(other + 0.5 / len(unl), 1e-9, 1 - 1e-9)
    strength = 2 * len(pos) * (q * np.log(q / r) + (1 - q) * np.log((1 - q) / (1 - r)))
    top = np.argsort(-strength, kind="stable")[:most_words]
    top = np.sort(top[strength[top] >= evidence])
    if not len(top):
        return nothing
    keys, ratio = keys[top], ratio[top]

    px, po = _padded(pos, keys)
    ux, uo = _padded(unl, keys)
    w, bias = np.zeros(len(keys)), float(np.log(prior / (1 - prior)))
    state = [np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)]
    rng = np.random.default_rng(seed)
    folds = max(1, min(8, len(pos) // 64))
    step = 0
    p_fold, u_fold = rng.integers(0, folds, len(pos)), rng.integers(0, folds, len(unl))
    for _ in range(rounds):
        for f in range(folds):
            step += 1
            pi, ui = p_fold[po] == f, u_fold[uo] == f
            scaled = w * ratio
            zp = np.bincount(po[pi], scaled[px[pi]], len(pos)) + bias
            zu = np.bincount(uo[ui], scaled[ux[ui]], len(unl)) + bias
            inp, inu = p_fold == f, u_fold == f
            gp, gu = np.zeros(len(pos)), np.zeros(len(unl))
            _, _, gp[inp], gu[inu] = risk(zp[inp], zu[inu], prior)
            g = np.bincount(px[pi], gp[po[pi]], len(w)) + np.bincount(ux[ui], gu[uo[ui]], len(w))
            g = np.append(g * ratio + decay * prior * w, gp.sum() + gu.sum())
            state[0] += 0.1 * (g - state[0])
            state[1] += 0.01 * (g * g - state[1])
            move = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
            w -= move[:-1]
            bias -= float(move[-1])
    return Model(keys, w * ratio, bias)


def _score(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for batch in slices(batches, "text"):
        words, first = hash_words(batch.column("text"), NON_WORD, LOWER)
        yield pa.record_batch({"id": batch.column("id"), "score": model.scores(words, first)})


def sample(rows: DataFrame, most: int) -> list[str]:
    """At most ``most`` texts chosen by a hash of id and text; all if there are fewer. The driver gets three times as many at most."""
    n = rows.count()
    if not n:
        return []
    span = 1 << 30
    kept = rows.where(F.pmod(F.xxhash64("id", "text", F.lit(17)), F.lit(span)) < int(span * min(1.0, 1.1 * most / n))).select("text").limit(3 * most)
    texts = sorted(kept.toArrow()["text"].to_pylist())
    if len(texts) > most:
        texts = [texts[i] for i in sorted(np.random.default_rng(3).choice(len(texts), most, replace=False))]
    return texts


def toxicity(docs: DataFrame, labels: DataFrame, trainable: Column, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", most_toxic: int = 1500, most_unlabelled: int = 6000, longest: int = 20_000, prior: float | None = None) -> DataFrame:
    """``id, score``: for each row of ``docs`` the probability, from its whole text alone, that it is toxic.

    Learns from at most ``most_toxic`` texts labelled toxic, for which
    ``trainable`` (over the id column) holds, and at most ``most_unlabelled``
    texts without regard to labels; of a text of more than ``longest``
    characters, from that many at a hashed place.
    ``prior`` is the class prior; by default the share of toxic among the
    trainable labelled rows. Without toxic examples every score is the same.
    Null and empty texts get the score of a text without known words. Repeated
    rows and null ids give a row each; other columns are not read.
    """
    ready(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"), trainable.alias("ok"))
    marked = labels.where(trainable & F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("toxic")).where("toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    if prior is None:
        prior = marked.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    short = rows.where(F.length("text") > 0).withColumn("text", stretch("text", F.xxhash64("id", "text", F.lit(5)), longest))
    toxic = sample(short.where("ok").join(marked.where("toxic = 1").select("id"), "id", "left_semi").select("id", "text"), most_toxic)
    model = train(toxic, sample(short.select("id", "text"), most_unlabelled), prior)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _score(batches, shared)

    return rows.select("id", "text").mapInArrow(run, f"id {kind}, score double")
