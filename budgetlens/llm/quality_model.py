"""Quality classifier: logistic regression over hashed word n-grams.

A text's tokens are its runs of letters or digits, its runs of other marks, and
line ends; a word that repeats the one before counts as a repetition mark; one to three tokens in a row are hashed into 2**bits features, whose
value is the logarithm of one more than the count, all scaled to length one.
Weights are learned online by follow-the-regularised-leader with a learning rate
for each coordinate and an L1 term that keeps unhelpful weights at zero. A score
is a sparse dot product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from budgetlens.llm.common import BASE, BLANK, WordHashes, doc_bucket, each_text, in_arrow, map_batches, mixed, stored

#: Classes of bytes: blank, line end, letter or digit (bytes of other alphabets too), mark.
KIND = np.full(256, 3, np.int8)
KIND[BLANK] = 0
KIND[10] = 1
KIND[[b for b in range(256) if b >= 128 or chr(b).isalnum()]] = 2
#: What a word counts as that equals the one before, also if marks stand between.
REPEAT = np.array([0, 0x5BF0A8B1D6E3C947, 0x2545F4914F6CDD1D], np.uint64)
#: Tokens of a text that are hashed at once.
CHUNK = 1 << 20


class Features:
    """Hashed n-grams of texts."""

    def __init__(self, bits: int = 18, grams: int = 3):
        self.bits, self.grams, self.hashes = bits, grams, WordHashes()
        self.shift = np.uint64(64 - bits)

    def tokens(self, raw: bytes) -> np.ndarray:
        """Hashes of the tokens in order, repeated words as repetition marks."""
        buf = np.frombuffer(raw, np.uint8)
        kind = KIND[buf]
        edge = np.empty(len(kind), bool)
        edge[:1] = True
        edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 1)
        first = np.nonzero(edge)[0]
        end = np.append(first[1:], len(kind))
        kind = kind[first]
        keep = kind > 0
        kind = kind[keep]
        h = self.hashes.of_spans(buf, first[keep], end[keep])
        again = np.zeros(len(h), np.int8)
        again[2:] = 2 * ((h[2:] == h[:-2]) & (kind[1:-1] == 3))
        again[1:][h[1:] == h[:-1]] = 1
        again[kind != 2] = 0
        return np.where(again > 0, REPEAT[again], h)

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the text's features in order, and how often each occurs."""
        raw = text.encode("utf-8", "surrogatepass").lower()
        h = self.tokens(raw) if raw else np.zeros(0, np.uint64)
        if not len(h):
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        index, count = np.zeros(0, np.int32), np.zeros(0, np.int64)
        for k in range(0, len(h), CHUNK):
            # One sort a chunk; a chunk's n-grams begin in it.
            made = [(gram >> self.shift).astype(np.int32) for gram in
                    self.grams_of(h[k:k + CHUNK + self.grams - 1], min(CHUNK, len(h) - k))]
            at, n = summed(np.concatenate(made), None)
            index, count = summed(np.concatenate((index, at)), np.concatenate((count, n))) if len(index) else (at, n)
        return index, count.astype(np.int32)

    def grams_of(self, h: np.ndarray, n: int):
        """Hashes of the runs of one to ``grams`` tokens that begin in the first n."""
        run = h.copy()
        yield mixed(run)[:n]
        for k in range(1, self.grams):
            if len(h) <= k:
                return
            run = run[:-1] * np.uint64(BASE) + h[k:]
            yield mixed(run + np.uint64(k))[:n]


def scaled(count: np.ndarray) -> np.ndarray:
    """Values of features that occur so often, of length one."""
    value = np.log1p(count)
    return value / np.sqrt(value @ value) if len(value) else value


def summed(index: np.ndarray, count: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indexes in order, with the sums of their counts (None: ones)."""
    if count is None:
        index = np.sort(index)
    else:
        order = np.argsort(index, kind="stable")
        index, count = index[order], count[order]
    first = np.nonzero(np.concatenate(([True], index[1:] != index[:-1])))[0]
    return index[first], (np.diff(np.append(first, len(index))) if count is None else np.add.reduceat(count, first))


class Leader:
    """State of follow-the-regularised-leader: for each coordinate the sum of
    shifted gradients ``z`` and the sum of squared gradients ``n``; the last
    coordinate is the constant, which has no penalty."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def constant(self) -> float:
        return float(-self.z[-1] / ((self.beta + np.sqrt(self.n[-1])) / self.alpha))

    def learn(self, index: np.ndarray, value: np.ndarray, y: float) -> float:
        """One update; returns the probability given before it."""
        w, c = self.weights(index), self.constant()
        p = probability(float(w @ value) + c)
        for at, v, old in ((index, value, w), (-1, 1.0, c)):
            g = (p - y) * v
            more = np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])
            self.z[at] += g - more / self.alpha * old
            self.n[at] += g * g
        return p


def probability(x: float) -> float:
    return float(1 / (1 + np.exp(-min(max(x, -35.0), 35.0))))


class Model:
    """Weights of the features and the constant."""

    def __init__(self, features: Features, weight: np.ndarray, constant: float):
        self.features, self.weight, self.constant = features, weight, constant

    def score(self, text: str) -> float:
        index, count = self.features.counts(text)
        return probability(float(self.weight[index] @ scaled(count)) + self.constant)


def examples(docs: DataFrame, labels: DataFrame, features: Features, most: int, modulus: int) -> DataFrame:
    """(id, place, y, index, n) of at most ``most`` labelled training documents,
    the ones whose id hashes lowest. Ids whose crc32 leaves remainder 0 are left
    out; a doc_id with contrary labels counts as bad."""
    ids = (labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("y"))
           .filter("id is not null and y is not null").groupBy("id").agg(F.min("y").alias("y"))
           .filter(doc_bucket("id", modulus) != 0).orderBy(F.xxhash64("id"), "id").limit(most))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text"))
    # At most `most` small rows: a proven bound for the broadcast.
    pick = rows.join(F.broadcast(ids), "id").select("id", F.xxhash64("id").alias("place"), "y", "text")

    def run(batch):
        made = [features.counts(t) for t in each_text(batch)]
        return {"id": batch.column("id"), "place": batch.column("place"), "y": batch.column("y"),
                "index": [i for i, _ in made], "n": [n for _, n in made]}

    return stored(map_batches(pick, run, "id long, place long, y int, index array<int>, n array<int>", bounded=True),
                  "examples")


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 10_000, modulus: int = 5, epochs: int = 3,
          bits: int = 18, grams: int = 3, alpha: float = 5.0, beta: float = 1.0, l1: float = 0.1,
          l2: float = 0.0) -> Model:
    """Learn from at most ``most_rows`` labelled documents (and the repeated rows
    of their ids), whose features are made in parallel and learned one after the
    other in an order given by their ids' hashes. Without labels of both kinds
    there is nothing to tell apart: every text scores 0.5."""
    features = Features(bits, grams)
    rows = examples(docs, labels, features, most_rows, modulus)
    kinds = {r["y"] for r in rows.select((F.col("y") > 0).alias("y")).distinct().collect()}
    if len(kinds) < 2:
        return Model(features, np.zeros(1 << bits, np.float32), 0.0)

    def learn(batches):
        # Sparse rows of a bounded sample, one after the other; only the state stays.
        leader = Leader(1 << bits, alpha, beta, l1, l2)
        for batch in batches:
            index, n = batch.column("index"), batch.column("n")
            for k, y in enumerate(batch.column("y").to_pylist()):
                leader.learn(index[k].values.to_numpy(), scaled(n[k].values.to_numpy()), float(y > 0))
        w = leader.weights(slice(0, 1 << bits))
        at = np.nonzero(w)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(w[at], leader.constant()))],
                                         ["at", "w"])

    every = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    one = every.repartition(1).sortWithinPartitions("epoch", "place", "id", "y", F.xxhash64("index", "n"))
    got = in_arrow(one.select("y", "index", "n"), learn, "at long, w double").collect()  # 2**bits + 1 at most
    weight, constant = np.zeros(1 << bits, np.float32), 0.0
    for r in got:
        if r["at"] < 0:
            constant = r["w"]
        else:
            weight[r["at"]] = r["w"]
    return Model(features, weight, constant)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, modulus: int = 5) -> DataFrame:
    """One row per document: (doc_id, held_out, score, predicted).

    Defined cases: a null text counts as empty, and an empty one has no features
    and the score of the constant; a null id counts as the empty text for
    held_out; a text of any length is read whole; repeated rows come back as
    often as they occur; an empty table gives an empty result; other columns are
    not read.
    """
    pick = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       (doc_bucket("doc_id", modulus) == 0).alias("held_out"), F.col("text").alias("text"))
    # 2**bits weights: a proven bound for the broadcast.
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        s = [sent.value.score(t) for t in each_text(batch)]
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": s,
                "predicted": [int(v >= threshold) for v in s]}

    return map_batches(pick, run, "doc_id long, held_out boolean, score double, predicted int", bounded=True)
