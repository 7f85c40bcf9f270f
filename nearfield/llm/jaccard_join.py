"""N-gram Jaccard join by prefix filters under several global token orders.

Two sets with Jaccard similarity t share, under *every* total order of the
tokens, a token among the first ``n - ceil(t n) + 1`` of each. Candidates come
from equal prefix tokens of one order and must share a prefix token of each
other order too; what is left is verified on whole texts.

All orders put frequent tokens last. Which tokens are frequent is kept in a
bitmap of fixed size, so the order is a function of the token alone and a
wrong bit costs time, never a link.

Large groups of copies are handled without emitting their pairs:

* equal sets are one representative, the smallest id;
* a shared token must come early enough in both orders for what follows to
  reach the similarity;
* in each group of equal prefix tokens, one leader (the member with the fewest
  infrequent tokens, the likely original) is compared with the others;
* after connecting those links, only groups that still hold several components
  go on, and there only members outside the leader's component are compared
  with members of other components. Two members of one component need no
  comparison, since the result is the components.

That leaves out no link between different components, so components are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.components import components
from nearfield.llm.store import Scratch
from nearfield.llm.textops import LOWER, SPACES, Marks, U, hash_words, list_array, mix, shingle_set, signed, slices

SEEDS = (U(0x243F6A8885A308D3), U(0x13198A2E03707344), U(0xA4093822299F31D0))
HELD = 2 << 20
CHUNK = 32
WIDEST = (1 << 24) - 1


def _sets(batch: pa.RecordBatch, k: int) -> list[np.ndarray]:
    words, first = hash_words(batch.column("text"), SPACES, LOWER)
    return [shingle_set(words[a:b], k) for a, b in zip(first[:-1], first[1:], strict=True)]


def _count(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Tokens of at least two rows of a stretch of the input, with the number of those rows."""

    def out(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        tokens, n = np.unique(np.concatenate(held), return_counts=True)
        yield pa.record_batch({"token": signed(tokens[n > 1]), "n": n[n > 1].astype(np.int64)})

    held, size = [], 0
    for batch in slices(batches, "text"):
        for s in _sets(batch, k):
            held.append(s)
            size += len(s)
        if size >= HELD:
            yield from out(held)
            held, size = [], 0
    if held:
        yield from out(held)


def _prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1 if n else 0


def _describe(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int, marks) -> Iterator[pa.RecordBatch]:
    frequent = marks.value
    for batch in slices(batches, "text"):
        sets = _sets(batch, k)
        rows = []
        for s in sets:
            n, p = len(s), _prefix_length(len(s), num, den)
            hot = frequent.has(s)
            orders = []
            for i, seed in enumerate(SEEDS):
                key = (mix(s ^ seed) >> U(1)) | (hot.astype(U) << U(63))
                pick = np.argpartition(key, p - 1)[:p] if p < n else np.arange(n)
                pick = pick if i else pick[np.argsort(key[pick], kind="stable")]
                orders.append(signed(s[pick]) if not i else (s[pick] >> U(32)).astype(np.uint32).view(np.int32))
            with np.errstate(over="ignore"):
                print1, print2 = (np.sum(mix(s ^ seed)) if n else U(0) for seed in (U(0x452821E638D01377), U(0xBE5466CF34E90C6C)))
            rows.append((n, n - int(hot.sum()), np.int64(np.array(print1, U).view(np.int64)), np.int64(np.array(print2, U).view(np.int64)), *orders))
        cols = list(zip(*rows, strict=True))
        yield pa.record_batch(
            {
                "id": batch.column("id"),
                "n": pa.array(cols[0], pa.int64()),
                "rare": pa.array(cols[1], pa.int32()),
                "print1": pa.array(cols[2], pa.int64()),
                "print2": pa.array(cols[3], pa.int64()),
                "first": list_array(list(cols[4]), pa.int64()),
                "second": list_array(list(cols[5]), pa.int32()),
                "third": list_array(list(cols[6]), pa.int32()),
            }
        )


def _verify(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (leader, chunk, role): one leader's text, then its partners'."""
    lead, of = [], None
    for batch in slices(batches, "text"):
        sets = _sets(batch, k)
        a, b = [], []
        for leader, id_, role, s in zip(*(batch.column(c).to_pylist() for c in ("leader", "id", "role")), sets, strict=True):
            if role == 0:  # rows that repeat an id may have several texts
                lead, of = ([*lead, s] if of == leader else [s]), leader
            elif of == leader:
                both = [len(np.intersect1d(x, s, assume_unique=True)) for x in lead]
                if any(n and den * n >= num * (len(x) + len(s) - n) for n, x in zip(both, lead, strict=True)):
                    a.append(leader)
                    b.append(id_)
        yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _links(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) that reach the similarity; each task holds one leader's set and a batch of texts."""
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(1 << 30)).alias("h"))
    per = salted.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    salted = scratch.write(salted.join(per, "a").select("a", "b", F.pmod("h", "chunks").alias("chunk")), "pairs")
    wanted = salted.select("a", "chunk", F.col("a").alias("id"), F.lit(0).alias("role")).distinct().union(salted.select("a", "chunk", F.col("b").alias("id"), F.lit(1).alias("role")))
    # texts of ids in pairs only: at most 2^18 remainders of their hashes are broadcast, whatever the number of ids
    near = F.pmod(F.xxhash64("id"), F.lit(1 << 18))
    some = wanted.select(near.cast("int").alias("bucket")).distinct()
    texts = docs.select("id", "text", near.cast("int").alias("bucket")).join(F.broadcast(some), "bucket", "left_semi").drop("bucket")
    rows = wanted.join(texts, "id").select(F.col("a").alias("leader"), "chunk", "role", "id", "text")
    rows = rows.repartition("leader", "chunk").sortWithinPartitions("leader", "chunk", "role").select("leader", "role", "id", "text")
    out = scratch.write(rows.mapInArrow(partial(_verify, k=k, num=num, den=den), "a long, b long"), "links")
    scratch.drop(salted)
    return out


def jaccard_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 5, threshold: tuple[int, int] = (80, 100), frequent: int = 8, bitmap_bits: int = 25) -> DataFrame:
    """``id, n_shingles, component``: one row for each input row.

    A text is lower-cased (A-Z), split at ASCII white space and taken as the set
    of its distinct ``shingle``-word runs; fewer words are one run. Rows link
    when ``threshold[1] * |A & B| >= threshold[0] * |A | B|``; component is the
    smallest id reachable. A row that repeats an id adds its text to that id. Null and empty texts have an empty set and link with
    nothing. All rows are kept; rows
    without an id get a null component. Other columns are not read.

    ``frequent`` and ``bitmap_bits`` change the order of tokens, not the result.
    """
    spark = docs.sparkSession
    num, den = threshold
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    texts = docs.select("text")
    counts = texts.mapInArrow(partial(_count, k=shingle), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= frequent)
    marks = Marks.of(counts, "token", bitmap_bits)
    shared = spark.sparkContext.broadcast(marks)
    schema = "id long, n long, rare int, print1 long, print2 long, first array<long>, second array<int>, third array<int>"
    sets = scratch.write(docs.mapInArrow(partial(_describe, k=shingle, num=num, den=den, marks=shared), schema), "sets")

    full = sets.where("n > 0 and id is not null")
    same = scratch.write(full.groupBy("n", "print1", "print2").agg(F.min("id").alias("rep")), "same")
    rep = same.select(F.col("rep").alias("id"), "n").distinct()
    lead = full.join(rep, ["id", "n"], "left_semi")
    # how few tokens are rare (for the choice of the leader), size and position in one number; the last two say nothing at WIDEST
    described = F.call_function("shiftleft", F.least(F.col("rare"), F.lit(0x7FFF)).cast("long"), F.lit(48)) + F.call_function("shiftleft", F.least(F.col("n"), F.lit(WIDEST)).cast("long"), F.lit(24)) + F.least(F.col("at"), F.lit(WIDEST))
    rows = lead.select("id", "n", "rare", F.posexplode("first").alias("at", "token")).select("token", "id", described.alias("described"))
    groups = rows.groupBy("token").agg(F.min(F.struct("described", "id")).alias("lead"), F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("token", "lead")
    read = lambda c: (F.shiftright(c, 24).bitwiseAND(WIDEST).cast("int"), c.bitwiseAND(WIDEST).cast("int"))
    (n, at), (other_n, other_at) = read(F.col("described")), read(F.col("lead.described"))
    # sizes, and what may follow the first shared token: a pair's first one passes if the pair reaches the similarity
    fits = f"(greatest(n, other_n) = {WIDEST} or least(n, other_n) * {den}L >= greatest(n, other_n) * {num}L and least(n - at, other_n - other_at) * {num + den}L >= {num}L * (n + other_n))"
    members = scratch.write(rows.join(groups, "token").select("token", "id", n.alias("n"), at.alias("at"), F.col("lead.id").alias("other"), other_n.alias("other_n"), other_at.alias("other_at")), "members")
    pairs = members.where("id <> other").where(fits).select(F.col("other").alias("a"), F.col("id").alias("b")).distinct()

    def filtered(pairs: DataFrame) -> DataFrame:
        """Pairs that share a prefix token under the other orders too."""
        side = lead.select("id", "second", "third")
        left = side.select(F.col("id").alias("a"), F.col("second").alias("second_a"), F.col("third").alias("third_a"))
        right = side.select(F.col("id").alias("b"), F.col("second").alias("second_b"), F.col("third").alias("third_b"))
        kept = pairs.join(left, "a").join(right, "b").where(F.arrays_overlap("second_a", "second_b") & F.arrays_overlap("third_a", "third_b"))
        return kept.select("a", "b").distinct()

    links = _links(filtered(pairs), docs, shingle, num, den, scratch)
    known = scratch.write(components(links, scratch), "known")

    # groups of equal prefix tokens that still hold several components
    named = members.join(known, "id", "left").select("token", "id", "n", "at", F.coalesce("component", "id").alias("part"), "other")
    mixed = named.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.max(F.when(F.col("id") == F.col("other"), F.col("part"))).alias("main")).where("low < high").select("token", "main")
    left = scratch.write(named.join(mixed, "token"), "left")
    strays = left.where("part <> main").select("token", F.col("id").alias("a"), F.col("n").alias("other_n"), F.col("at").alias("other_at"), F.col("part").alias("other_part"), F.col("other").alias("leader"))
    more = strays.join(left, "token").where("part <> other_part and id <> leader and " + fits).where("part = main or a < id").select(F.col("a"), F.col("id").alias("b")).distinct()
    again = _links(filtered(more), docs, shingle, num, den, scratch)

    copies = full.join(same, ["n", "print1", "print2"]).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    final = scratch.write(components(links.union(again).union(copies), scratch), "components")
    scratch.drop(members, left, known)
    return sets.select("id", "n").join(final, "id", "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component"))
