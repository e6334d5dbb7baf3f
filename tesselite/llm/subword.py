"""Supervised subword embeddings for document quality.

A document's features are its words, its word pairs (all pairs of equal words are
one feature) and its character 3-, 4- and 5-grams, hashed into ``BUCKETS`` rows of an
embedding table.  The mean of those rows, and of ``EMPTY`` rows of zeros that keep
the shortest texts near the bias, goes through a softmax over two classes.  Training is stochastic
gradient descent in numpy over a bounded sample of labelled documents; scoring
is distributed.  As mean and output layer are linear, scoring needs one number
for each bucket, so that executors get a table of fixed size.

Inputs of a score: the text alone.  Null and empty texts have no features and
score by the bias alone; one-word texts and texts of any length are hashed
whole, the long ones in parts.  Repeated rows score alike.  Extra columns are
ignored.  Label rows that give one id different labels are left out.  Without
labelled rows of both classes every score is the share of label 1 (0.5 if
there are no labels at all).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselite.llm import hashing
from tesselite.llm._util import discard, kept_and, map_texts, materialise

BUCKETS = 1 << 18
DIM = 8
EPOCHS = 4
RATE = 0.5
#: At most so many labelled documents are trained on, half of them of each class where there are enough.
TRAIN_ROWS = 4000
#: And at most so many characters of them; a document is used whole or not at all, and one that doesn't fit is passed over.
TRAIN_CHARS = 30_000_000
#: Zero rows in every document's mean.
EMPTY = 60
SEED = 20240131

_M = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(1)


def _buckets(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - 18)).astype(np.uint32)


def feature_parts(text: str | None, piece: int = hashing.PIECE) -> Iterator[np.ndarray]:
    """Buckets of every word, word pair and character n-gram of the whole text, with repeats, in parts of bounded size."""
    low = (text or "").lower()
    tail = np.empty(0, np.uint64)
    for c in hashing.normalised(low, piece):
        c = np.concatenate((tail, c.astype(np.uint64)))
        gram = c + _ONE
        for n in (2, 3, 4, 5):
            if len(c) < n:
                break
            gram = gram[:-1] * _M + c[n - 1 :]
            if n > 2:
                # those that end within the part before came with it
                own = gram[max(0, len(tail) - n + 1) :]
                yield _buckets((own ^ (own >> np.uint64(29))) * _M)
        tail = c[-4:]
    word, _ = hashing.words([low], lambda c: c.astype(np.uint64) + _ONE, piece)
    for at in range(0, len(word), piece):
        own = word[at : at + piece]
        yield _buckets(own * _M + np.uint64(7))
        left, right = word[at : at + piece], word[at + 1 : at + piece + 1]
        left = left[: len(right)]
        yield _buckets(np.where(left == right, _ONE, left * np.uint64(3) + right) * _M + np.uint64(11))


def features(text: str | None) -> np.ndarray:
    """All of ``feature_parts`` at once."""
    return np.concatenate([np.empty(0, np.uint32), *feature_parts(text)])


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and how often each occurs, in the smallest type that holds it."""
    parts = list(feature_parts(text))
    if sum(map(len, parts)) <= BUCKETS:
        ids, n = np.unique(np.concatenate([np.empty(0, np.uint32), *parts]), return_counts=True)
    else:
        n = np.zeros(BUCKETS, np.int64)
        for p in parts:
            n += np.bincount(p, minlength=BUCKETS)
        ids = np.flatnonzero(n).astype(np.uint32)
        n = n[ids]
    return ids, n.astype(np.min_scalar_type(int(n.max(initial=0))))


@dataclass
class Model:
    """Difference of the two classes' logits by bucket, and the bias."""

    margin: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        total, n = 0.0, 0
        for ids in feature_parts(text):
            total += float(self.margin[ids].sum(dtype=np.float64))
            n += len(ids)
        z = self.bias + total / (n + EMPTY)
        return 1.0 / (1.0 + float(np.exp(-max(-500.0, min(500.0, z)))))


def train(texts: list[str], labels: list[int], *, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Stochastic gradient descent, one document a step, rate falling to zero; classes count alike."""
    y = np.asarray(labels, np.int64)
    share = float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or share in (0.0, 1.0):
        share = min(0.999, max(0.001, share))
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    # four bytes and a count of one, two or four for each distinct feature of a document
    docs = [counted(t) for t in texts]
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    out, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    weight = 0.5 / np.array([1 - share, share])
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for k in rng.permutation(len(docs)):
            ids, n = docs[k]
            part = (n / (n.sum(dtype=np.int64) + EMPTY)).astype(np.float32)
            mean = part @ table[ids] if len(ids) else np.zeros(dim, np.float32)
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[k]] -= 1
            grad = (p * (rate * (1 - done / steps) * weight[y[k]])).astype(np.float32)
            if len(ids):
                # a bucket's share of a mean is small, so its rate is scaled by the number of buckets
                table[ids] -= np.outer(part * min(len(ids), 200), out @ grad)
                out -= np.outer(mean, grad)
            bias -= grad
            done += 1
    z = table @ out
    return Model((z[:, 1] - z[:, 0]).astype(np.float32), float(bias[1] - bias[0]))


def held_out(doc_id, mod: int, rest: int):
    """Whether crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


def training_sample(documents: DataFrame, labels: DataFrame, label: str, mod: int, rest: int, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> DataFrame:
    """(doc_id, text, y, place): at most ``rows`` labelled documents that aren't held out, half of each class where there
    are enough, chosen by a hash of the id, whose order within the class is ``place``.  The ids are picked from the label
    table before a text is read, and ids with different labels aren't picked; of documents that share an id the least text
    counts.  The sample is written once.

    ``chars`` bounds the texts' characters: the classes take turns, each in the order of its places, and a text is used
    whole if it fits in what is left; of a class of which none fits the shortest text is used all the same."""
    spark = documents.sparkSession
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y")).filter(F.col("_id").isNotNull() & F.col("y").isin(0, 1))
    known = known.filter(~held_out(F.col("_id"), mod, rest)).groupBy("_id").agg(F.min("y").alias("y"), F.max("y").alias("_y")).filter("y = _y").drop("_y")
    order = F.xxhash64(F.lit(SEED), "_id")
    # the rows of a limit are in one partition already, so that their numbers need no shuffle
    place = F.row_number().over(Window.partitionBy("y").orderBy(order, "_id")).alias("place")
    zeros, ones = (known.filter(F.col("y") == y).orderBy(order, "_id").limit(rows // 2).select("_id", "y", place) for y in (0, 1))
    picked = zeros.unionByName(ones)
    # at most ``rows`` ids of 16 bytes; of rows that repeat an id one text counts
    met = documents.select("doc_id", F.col("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    sample = materialise(met.groupBy("doc_id", "y", "place").agg(F.min("text").alias("text")), "sample")
    # at most ``rows`` rows of three numbers
    sizes = sorted((r.place, r.y, r.n) for r in sample.select("place", "y", F.coalesce(F.length("text"), F.lit(0)).alias("n")).collect())
    if sum(n for *_, n in sizes) <= chars:
        return sample.select("doc_id", "text", "y", "place")
    left, taken, shortest = chars, [], {}
    for p, y, n in sizes:
        if n <= left:
            left -= n
            taken.append((y, p))
        else:
            shortest[y] = min(shortest.get(y, (n, p)), (n, p))
    taken += [(y, p) for y, (_, p) in shortest.items() if all(t[0] != y for t in taken)]
    fit = spark.createDataFrame(taken, "y int, place int")
    kept = materialise(sample.join(F.broadcast(fit), ["y", "place"]).select("doc_id", "text", "y", "place"), "sample")
    discard(sample)
    return kept


def fit(documents: DataFrame, labels: DataFrame, *, label: str = "quality", mod: int = 3, rest: int = 1, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model:
    """A model trained on the bounded sample, by one task on an executor; the driver gets the buckets' margins alone."""
    sample = training_sample(documents, labels, label, mod, rest, rows, chars)

    def run(batches):
        texts, ys = [], []
        for b in batches:
            texts += b.column("text").to_pylist()
            ys += b.column("y").to_pylist()
        model = train(texts, ys)
        yield pa.RecordBatch.from_pydict({"margin": pa.array([model.margin.tobytes()], pa.binary()), "bias": pa.array([model.bias], pa.float64())})

    # at most ``rows`` rows meet in the one task
    row = map_texts(sample.repartition(1).sortWithinPartitions("place", "y", "doc_id"), run, "margin binary, bias double").first()
    discard(sample)
    if row is None:
        return train([], [])
    return Model(np.frombuffer(bytes(row["margin"]), np.float32), row["bias"])


def score(documents: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and score (0 to 1) of every document; one pass over the texts and no shuffle."""
    sent = documents.sparkSession.sparkContext.broadcast((model.margin, model.bias))

    def run(batches):
        own = Model(*sent.value)
        for b in batches:
            cols = {k: b.column(k) for k in keep}
            yield pa.RecordBatch.from_pydict(cols | {"score": pa.array([own.score(t) for t in b.column("_text").to_pylist()], pa.float64())})

    # the text is carried twice only if it is kept as well
    rows = documents.select(*keep, F.col("text").alias("_text"))
    return map_texts(rows, run, kept_and(rows, keep, "score double"))
