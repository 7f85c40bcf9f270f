"""Language labels for the words of code-switched text: a linear-chain CRF.

Each word is scored for each language by the weights of its features: affixes,
character n-grams and the word itself (the lexicon), hashed into a table of
fixed size. Learned transitions say how languages follow each other, and
forward-backward gives each word's distribution given its whole text. A text's
language has the largest share of that mass.

Training sees only whole documents' labels, so sequences are spliced from
stretches of documents of different languages: within a stretch the language
is that of its document, and the seams teach the transitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.store import ready
from nearfield.llm.textops import LOWER, NON_WORD, U, hash_spans, mix, raw, slices, word_spans

#: Letters only: digits separate words too.
GAPS = NON_WORD.copy()
GAPS[48:58] = True
ASCII_LETTER = ~GAPS & (np.arange(256) < 128)
FEATURE_BITS = 17
#: Bytes of the n-grams.
GRAMS = (2, 3, 4)
#: Bytes of words that are described at a time, one word at least.
DESCRIBED = 1 << 16


def features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of words, flat, and where each word's begin.

    Of a word between two marks, over all its bytes after lower-casing: the
    word (lexicon), prefixes and suffixes of 1 to 3 bytes (with the marks), and
    n-grams of 2 to 4 bytes.
    """
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    width = ends - starts + 2
    begin = np.cumsum(width) - width
    of = np.repeat(np.arange(n), width)
    place = np.arange(len(of)) - begin[of]
    marked = (place == 0) | (place == width[of] - 1)
    flat = np.where(marked, U(1), LOWER[buf[np.where(marked, 0, starts[of] + place - 1)]].astype(U) + U(2))
    count = 1 + sum(np.maximum(0, width - g + 1) for g in GRAMS)
    at = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(at[-1], np.int64)
    out[at[:-1]] = (words >> U(64 - FEATURE_BITS)).astype(np.int64)
    after = at[:-1] + 1
    with np.errstate(over="ignore"):
        for g in GRAMS:
            total = np.zeros(max(0, len(flat) - g + 1), U)
            for i in range(g):
                total = total * U(257) + flat[i : i + len(total)]
            inside = np.flatnonzero(place[: len(total)] + g <= width[of[: len(total)]])
            out[after[of[inside]] + place[inside]] = (mix(total[inside] + U(g << 50)) >> U(64 - FEATURE_BITS)).astype(np.int64)
            after = after + np.maximum(0, width - g + 1)
    return out, at


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # 2^FEATURE_BITS x languages
    transition: np.ndarray  # from, to
    initial: np.ndarray


def marginals(emit: np.ndarray, first: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, float]:
    """Distribution of each word, expected transitions and the log of the normaliser.

    ``emit``: scores of the words of all texts; ``first``: where texts begin.
    Texts advance together, one word a step, the longest first, so that a step
    is one small matrix product for all texts that still have words.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    size, begin = size[order], first[:-1][order]
    k = emit.shape[1]
    top = emit.max(1, keepdims=True) if len(emit) else emit
    e = np.exp(emit - top)
    step = np.exp(model.transition)
    alpha, beta = np.empty_like(e), np.empty_like(e)
    log_z = float(top.sum())
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), "left")  # texts longer than t
    a = np.zeros((0, k))
    for t in range(longest):
        m = active[t]
        at = begin[:m] + t
        a = (a[:m] @ step if t else np.tile(np.exp(model.initial), (m, 1))) * e[at]
        z = a.sum(1, keepdims=True)
        a = a / z
        alpha[at] = a
        log_z += float(np.log(z).sum())
    pairs = np.zeros((k, k))
    b = np.zeros((0, k))
    for t in range(longest - 1, -1, -1):
        m = active[t]
        at = begin[:m] + t
        full = np.ones((m, k))
        if len(b):
            full[: len(b)] = b
        beta[at] = full
        if t:
            ahead = e[at] * full
            back = ahead @ step.T
            both = alpha[at - 1][:, :, None] * step[None] * ahead[:, None, :]
            pairs += (both / both.sum((1, 2), keepdims=True)).sum(0)
            b = back / back.sum(1, keepdims=True)
    p = alpha * beta
    return p / p.sum(1, keepdims=True), pairs, log_z


def spliced(texts: list[list[int]], labels: list[int], rng: np.random.Generator, stretch: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences of word numbers with a label for each word: stretches of the texts, in a random order, several to a sequence."""
    parts = []
    for words, label in zip(texts, labels, strict=True):
        i = 0
        while i < len(words):
            n = int(rng.integers(4, 2 * stretch))
            parts.append((words[i : i + n], label))
            i += n
    rng.shuffle(parts)
    flat, gold, first, held = [], [], [0], 0
    for words, label in parts:
        flat.extend(words)
        gold.extend([label] * len(words))
        held += 1
        if held == 4:
            first.append(len(flat))
            held = 0
    if first[-1] != len(flat):
        first.append(len(flat))
    return np.array(flat, np.int64), np.array(gold, np.int64), np.array(first, np.int64)


class Sample:
    """Training sequences: the features ``found[at[i]:at[i + 1]]`` of distinct word ``i``, the words ``flat`` of all sequences, their labels and where sequences begin and end."""

    def __init__(self, found: np.ndarray, at: np.ndarray, flat: np.ndarray, gold: np.ndarray, begin: np.ndarray, k: int):
        self.found, self.at, self.flat, self.gold, self.begin, self.k = found, at, flat, gold, begin, k
        self.size = np.diff(at)
        self.of = np.repeat(np.arange(len(self.size)), self.size)
        self.want = np.zeros((len(self.size), k))
        np.add.at(self.want, (flat, gold), 1)
        joined = np.ones(len(flat), bool)
        joined[begin[:-1]] = False
        self.steps = np.zeros((k, k))
        np.add.at(self.steps, (gold[:-1][joined[1:]], gold[1:][joined[1:]]), 1)
        self.starts = np.bincount(gold[begin[:-1]], minlength=k)

    def likelihood(self, w: np.ndarray, model: Model) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """The log-likelihood of the labels, and its derivatives by ``w`` (the weights of the features), transitions and initial scores."""
        emit = np.add.reduceat(w[self.found], self.at[:-1], 0) / np.sqrt(self.size)[:, None]
        p, pairs, log_z = marginals(emit[self.flat], self.begin, model)
        got = np.stack([np.bincount(self.flat, p[:, j], len(self.size)) for j in range(self.k)], 1)
        diff = (self.want - got) / np.sqrt(self.size)[:, None]
        by_w = np.stack([np.bincount(self.found, diff[self.of, j], len(w)) for j in range(self.k)], 1)
        score = (self.want * emit).sum() + (self.steps * model.transition).sum() + self.starts @ model.initial
        return score - log_z, by_w, self.steps - pairs, self.starts - p[self.begin[:-1]].sum(0)


def train(texts: list[str], labels: list[str], seed: int = 7, rounds: int = 25, decay: float = 1e-6, rate: float = 0.15) -> Model:
    """Maximum likelihood of the labels of spliced sequences, by Adam on all of them."""
    languages = sorted(set(labels))
    k = len(languages)
    model = Model(languages, np.zeros((1 << FEATURE_BITS, k)), np.zeros((k, k)), np.zeros(k))
    if k < 2:
        return model
    buf, off = raw(pa.array(texts, pa.string()))
    starts, ends, first = word_spans(buf, off, GAPS)
    keys = hash_spans(buf, starts, ends, LOWER)
    _, where, inverse = np.unique(keys, return_index=True, return_inverse=True)
    found, at = features(buf, starts[where], ends[where], keys[where])
    flat, gold, begin = spliced([inverse[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)], [languages.index(x) for x in labels], np.random.default_rng(seed))
    if not len(flat):
        return model
    used, found = np.unique(found, return_inverse=True)
    sample = Sample(found, at, flat, gold, begin, k)
    w = np.zeros((len(used), k))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, model.transition, model.initial)]
    for r in range(1, rounds + 1):
        _, by_w, by_transition, by_initial = sample.likelihood(w, model)
        grads = (
            by_w / len(flat) - decay * w,
            by_transition / len(flat) - decay * model.transition,
            by_initial / len(begin) - decay * model.initial,
        )
        for x, g, (m, v) in zip((w, model.transition, model.initial), grads, state, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    model.weights[used] = w
    return model


class Scorer:
    """Emission scores of words, kept by hash for the words met most: two generations of bounded size."""

    def __init__(self, model: Model, most: int = 100_000):
        self.model, self.most = model, most
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros((0, len(model.languages)))

    def emissions(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        keys = hash_spans(buf, starts, ends, LOWER)
        distinct, where, inverse = np.unique(keys, return_index=True, return_inverse=True)
        out = np.empty((len(distinct), self.rows.shape[1]))
        place = np.minimum(np.searchsorted(self.keys, distinct), max(0, len(self.keys) - 1))
        known = self.keys[place] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
        out[known] = self.rows[place[known]]
        new = np.flatnonzero(~known)
        total = np.concatenate([[0], np.cumsum(ends[where[new]] - starts[where[new]])])
        i = 0
        while i < len(new):
            j = max(i + 1, int(np.searchsorted(total, total[i] + DESCRIBED, "right")) - 1)
            part = new[i:j]
            i = j
            found, at = features(buf, starts[where[part]], ends[where[part]], distinct[part])
            size = np.diff(at)
            out[part] = np.add.reduceat(self.model.weights[found], at[:-1], 0) / np.sqrt(size)[:, None]
        if len(new):
            if len(self.keys) > self.most:  # keep what this stretch used
                self.keys, self.rows = distinct, out.copy()
            else:
                keys_, rows = np.concatenate([self.keys, distinct[new]]), np.concatenate([self.rows, out[new]])
                order = np.argsort(keys_, kind="stable")
                self.keys, self.rows = keys_[order], rows[order]
        return out[inverse]


def label(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    scorer = Scorer(model)
    names = np.array([*model.languages, "und"], object)
    for batch in slices(batches, "text"):
        buf, off = raw(batch.column("text"))
        starts, ends, first = word_spans(buf, off, GAPS)
        n = np.diff(first)
        if len(starts):
            p, _, _ = marginals(scorer.emissions(buf, starts, ends), first, model)
            total = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, 0)])
            mass = total[first[1:]] - total[first[:-1]]
            hard = np.argmax(p, 1)
            change = np.concatenate([[0], np.cumsum(np.append(hard[1:] != hard[:-1], False))])
            switches = np.where(n > 0, change[np.maximum(first[1:] - 1, 0)] - change[np.minimum(first[:-1], len(hard))], 0)
        else:
            mass, switches = np.zeros((batch.num_rows, len(model.languages))), np.zeros(batch.num_rows, np.int64)
        letters = np.concatenate([[0], np.cumsum(ASCII_LETTER[buf])])
        plain = letters[off[1:]] > letters[off[:-1]]
        for i in np.flatnonzero((n > 0) & ~plain):  # bytes above ASCII may be letters or not
            if not any(map(str.isalpha, batch.column("text")[i].as_py())):
                n[i] = switches[i] = 0
        best = np.argmax(mass, 1)
        share = np.where(n > 0, mass[np.arange(len(n)), best] / np.maximum(n, 1), 0.0)
        yield pa.record_batch({"id": batch.column("id"), "lang_pred": pa.array(names[np.where(n > 0, best, len(model.languages))].tolist(), pa.string()), "score": np.clip(share, 0, 1), "n_switches": switches.astype(np.int64)})


def stretch(text: str, key: Column, longest: int) -> Column:
    """A text, or of a longer one ``longest`` characters from a place that a hash says."""
    spare = F.length(text) - longest
    return F.when(spare <= 0, F.col(text)).otherwise(F.substring(F.col(text), (F.pmod(key, spare + 1) + 1).cast("int"), F.lit(longest)))


def training_sample(docs: DataFrame, trainable: Column, per_language: int, longest: int) -> tuple[list[str], list[str]]:
    """At most ``per_language`` texts of each language, chosen by a hash of id and text; of those longer than ``longest`` characters a stretch."""
    usable = docs.where(trainable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return [], []
    span = 1 << 30
    keep = F.lit(False)
    for lang, n in counts.items():
        keep = keep | ((F.col("lang") == lang) & (F.pmod(F.xxhash64("id", "text"), F.lit(span)) < int(span * min(1.0, 1.2 * per_language / n))))
    rows = usable.where(keep).select("lang", stretch("text", F.xxhash64("id", "text", F.lit(5)), longest).alias("text")).limit(3 * per_language * len(counts)).toArrow()
    held: dict[str, list[str]] = {}
    for lang, text in sorted(zip(rows["lang"].to_pylist(), rows["text"].to_pylist(), strict=True)):
        held.setdefault(lang, []).append(text)
    pick = np.random.default_rng(11)
    texts, labels = [], []
    for lang, found in held.items():
        chosen = found if len(found) <= per_language else [found[i] for i in sorted(pick.choice(len(found), per_language, replace=False))]
        texts += chosen
        labels += [lang] * len(chosen)
    return texts, labels


def identify(docs: DataFrame, trainable: Column, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", per_language: int = 100, longest: int = 6000) -> DataFrame:
    """``id, lang_pred, score, n_switches``: one row for each row of ``docs``.

    The model learns from at most ``per_language`` rows of each language for
    which ``trainable`` holds; of a text of more than ``longest`` characters, from
    that many at a hashed place. Prediction reads the whole text and nothing else. ``score`` is the share of
    the text's words, by forward-backward, that are in the predicted language;
    ``n_switches`` the changes of the likeliest label from word to word. A text
    that is null or has no letter is ``und`` with score 0; so is every text
    where nothing can be learned. Repeated rows and null ids give a row each;
    other columns are not read.
    """
    ready(docs.sparkSession)
    named = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"), F.col(lang_column).cast("string").alias("lang"), trainable.alias("ok"))
    texts, labels = training_sample(named, F.col("ok"), per_language, longest)
    model = train(texts, labels)
    kind = docs.schema[id_column].dataType.simpleString()
    if not model.languages:
        return named.select("id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_switches"))
    model.weights = model.weights.astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return label(batches, shared)

    return named.select("id", "text").mapInArrow(run, f"id {kind}, lang_pred string, score double, n_switches long")
