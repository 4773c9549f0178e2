"""Toxicity by a factorization machine over hashed terms.

Terms are a document's distinct words and their prefixes of three to six characters (inflected and compounded
words share these), each hashed to 32 bits. Of a bounded sample of labelled rows, the terms whose frequency
differs most between the labels are kept; a second-order factorization machine on their presence is trained on
that sample, so that pairs of terms (an insult with the mention of a group) weigh beyond what each adds alone.
Scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, text_bytes, written

#: Labelled rows that are learned from, at most: those with the smallest hash of their id.
SAMPLE = 20_000
#: Terms kept, and the fewest sampled documents that a kept term is in.
TERMS = 2048
LEAST = 4
RANK = 8
EPOCHS = 12
CUT = 0.3
PREFIXES = range(3, 7)
REMEMBERED = 50_000
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def text_words(data: bytes) -> set[str]:
    return set(_WORD.findall(data.decode("utf-8", "replace").lower()))


def word_terms(word: str) -> list[int]:
    """The hashes of a word and its proper prefixes."""
    return [zlib.crc32(b"w" + word.encode())] + [zlib.crc32(b"p" + word[:n].encode()) for n in PREFIXES if len(word) > n]


@dataclass
class Machine:
    """terms: sorted hashes; bias, weights and factors of the machine over them."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, places: np.ndarray) -> float:
        """The probability of a document that has the terms at these places."""
        v = self.factors[places]
        s = v.sum(axis=0)
        z = self.bias + self.weights[places].sum() + 0.5 * float((s * s).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(rows: list[np.ndarray], labels: np.ndarray, terms: np.ndarray, rank: int = RANK, epochs: int = EPOCHS, seed: int = 7) -> Machine:
    """Logistic loss, Adam on mini-batches; ``rows`` are the places of each document's terms."""
    rng, n, m = np.random.default_rng(seed), len(rows), len(terms)
    share = float(labels.mean()) if n else 0.0
    bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    p = [np.array([bias]), np.zeros(m), rng.normal(0, 0.02, (m, rank))]
    if not n or not m or share in (0.0, 1.0):
        return Machine(terms, bias, p[1], np.zeros((m, rank)))
    first, second, t = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    for epoch in range(epochs):
        order = rng.permutation(n)
        rate = 0.02 / (1 + epoch / 4)
        for at in range(0, n, 256):
            own = order[at : at + 256]
            x = np.zeros((len(own), m), np.float32)
            for i, k in enumerate(own):
                x[i, rows[k]] = 1
            xv = x @ p[2]
            z = p[0] + x @ p[1] + 0.5 * ((xv * xv).sum(1) - x @ (p[2] * p[2]).sum(1))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[own]) / len(own)
            xg = x * g[:, None]
            grads = [np.array([g.sum()]), x.T @ g + 1e-5 * p[1], xg.T @ xv - xg.sum(0)[:, None] * p[2] + 1e-4 * p[2]]
            t += 1
            for k, d in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.999 * second[k] + 0.001 * d * d
                p[k] = p[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return Machine(terms, float(p[0][0]), p[1], p[2])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep: int = TERMS) -> Machine:
    """A machine from the rows of ``labels`` (doc_id, toxic) whose id isn't held out.

    Rows with a null id or label are left out; an id with several labels is toxic if one says so, and one with several
    texts counts with the first of them. At most ``sample`` ids are learned from, those with the smallest hash; their
    number bounds what is broadcast, and with ``keep`` what comes to the driver. Without rows the score is constant.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select(F.col("doc_id").cast("long").alias("k"), F.col("toxic").cast("int").alias("y")).where(~held_out(F.col("k")))
    own = own.groupBy("k").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("k"))
    n = own.count()  # a bound on the hash first, so that no task sorts more than about the sample
    low = -(1 << 63) + min((1 << 64) - 1, int((1 << 64) * 1.25 * sample / max(n, 1)))
    own = own.where(F.col("h") <= low).orderBy("h", "k").limit(sample).select("k", "y")

    def terms_of(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # terms take more room than the text
                part = batch.slice(at, 256)
                found = [np.fromiter({t for w in text_words(x.as_py() or b"") for t in word_terms(w)}, np.int64) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([np.sort(x) for x in found], pa.list_(pa.int64()))], names=["y", "terms"])

    met = docs.select(F.col("doc_id").cast("long").alias("k"), text_bytes().alias("data")).join(F.broadcast(own), "k")  # at most ``sample`` rows
    again = written(met.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k"), "repeated-ids")
    once = met.join(F.broadcast(again), "k", "left_anti")
    if again.limit(1).count():  # texts are only compared where an id has several
        once = once.unionByName(met.join(F.broadcast(again), "k", "left_semi").groupBy("k", "y").agg(F.min("data").alias("data")).select("k", "data", "y"))
    met = once.select("y", "data")
    rows = written(met.transform(small_batches).mapInArrow(terms_of, "y int, terms array<long>"), "terms")
    n, pos = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    p = (pos + 0.5) / (n + 1)
    counts = rows.select("y", F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n"), F.sum("y").alias("a")).where(F.col("n") >= LEAST)
    z = (F.col("a") - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p))
    kept = counts.select("t", F.abs(z).alias("z")).orderBy(F.desc("z"), "t").limit(keep)
    terms = np.array(sorted(x.t for x in kept.collect()), np.int64)

    def places_of(batches):
        import pyarrow as pa

        for batch in batches:
            found = [np.flatnonzero(np.isin(terms, x.values.to_numpy(zero_copy_only=False))).astype(np.int32) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["y", "places"])

    sampled = sorted(((x.y, tuple(x.places)) for x in rows.transform(small_batches).mapInArrow(places_of, "y int, places array<int>").toLocalIterator()), key=lambda x: (x[1], x[0]))
    return train([np.array(x, np.int64) for _, x in sampled], np.array([y for y, _ in sampled], float), terms)


class Scorer:
    """Scores texts by a machine; remembers the terms of words that it has met."""

    def __init__(self, machine: Machine):
        self.machine, self.known = machine, {}
        self.place = {int(t): i for i, t in enumerate(machine.terms)}

    def __call__(self, data: bytes) -> float:
        if len(self.known) > REMEMBERED:
            self.known = {}
        places: set[int] = set()
        for w in text_words(data):
            own = self.known.get(w)
            if own is None:
                own = self.known[w] = tuple(self.place[t] for t in word_terms(w) if t in self.place)
            if own:
                places.update(own)
        return self.machine.score(np.array(sorted(places), np.int64))


def scores(docs: DataFrame, machine: Machine, cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text).

    Null, blank and unknown texts have the score of no terms; repeated rows the same score; a null doc_id isn't
    held out. Other columns are ignored.
    """

    def of(batches):
        import pyarrow as pa

        score = Scorer(machine)
        for batch in batches:
            out = [score(x.as_py() or b"") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("data")).transform(small_batches).mapInArrow(of, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of ``docs``, all columns, whose text isn't predicted toxic; one pass over the rows, no join.

    Null, blank and unknown texts have the score of no terms, and go or stay together; repeated rows too. Other
    columns, whatever their names, come through. No rows, no result.
    """
    machine, at = learn(docs, labels), docs.columns.index("text")

    def of(batches):
        import pyarrow as pa

        score = Scorer(machine)
        for batch in batches:
            yield batch.filter(pa.array([score(x.as_py() or b"") < cut for x in batch.column(at).cast(pa.binary())], pa.bool_()))

    return docs.transform(small_batches).mapInArrow(of, docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document by a machine learned from ``labels``."""
    docs = table(spark, sf_dir, "documents")
    return scores(docs, learn(docs, table(spark, sf_dir, "labels")))
