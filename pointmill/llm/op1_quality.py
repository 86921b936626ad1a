"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network in numpy.

Every word has a sparse random index vector, which its hash decides; its word vector is the sum of the index vectors of
the words near it, over all documents. Words are numbered by hash in BUCKETS buckets, so the vectors have one size at any
input; tasks sum them up as whole numbers and Spark adds the tasks' sums. A document is pooled to the mean of its words'
vectors and the mean difference of neighbouring words' vectors. The network learns from a bounded sample of the labelled rows (SAMPLE rows, those
of the smallest hash); a temperature, fitted on a fifth of the sample that the network doesn't see, calibrates it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointmill.llm.common import by_slices, text_bytes

BUCKETS, DIMS, ONES, NEAR = 1 << 14, 32, 2, 2
#: Labelled rows that the network learns from, at most.
SAMPLE = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 128, 3e-3, 1e-4
THRESHOLD = 0.7
#: Bytes of a text that are cut into words at a time.
STRETCH = 1 << 20
WORD = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff\s]+")
#: Words whose vectors are held at once.
HELD = 1 << 15


def stretches(text: bytes, most: int = STRETCH) -> Iterator[bytes]:
    """The text in parts that end at white space, or at `most` bytes where there is none."""
    at = 0
    while len(text) - at > most:
        cut = max(text.rfind(b" ", at, at + most), text.rfind(b"\n", at, at + most))
        cut = cut if cut > at else at + most
        yield text[at:cut]
        at = cut
    yield text[at:]


def numbers(part: bytes) -> np.ndarray:
    words = WORD.findall(part)
    return (np.fromiter(map(crc32, words), np.uint32, len(words)) % np.uint32(BUCKETS)).astype(np.int64)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the places and the signs of its index vector's ones."""
    rng = np.random.default_rng(7)
    return rng.integers(0, DIMS, (BUCKETS, ONES)), rng.integers(0, 2, (BUCKETS, ONES)) * 2 - 1


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places, signs = index_vectors()
    total = np.zeros(BUCKETS * DIMS, np.int64)
    for batch in batches:
        for at in range(batch.num_rows):  # one text at a time is held
            for part in stretches(batch.column(0)[at].as_py()):
                w = numbers(part)
                for shift in range(1, NEAR + 1):
                    for a, b in ((w[:-shift], w[shift:]), (w[shift:], w[:-shift])):
                        for k in range(ONES):
                            np.add.at(total, a * DIMS + places[b, k], signs[b, k])
    rows = total.reshape(BUCKETS, DIMS)
    used = np.flatnonzero(np.abs(rows).sum(axis=1))
    for at in range(0, len(used), 4096):
        some = used[at : at + 4096]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(np.ascontiguousarray(rows[some, d])) for d in range(DIMS))], names=["bucket", *(f"v{d}" for d in range(DIMS))])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The word vectors, of length one, from all rows; BUCKETS rows of DIMS numbers come to the driver at any input."""
    kind = "bucket int, " + ", ".join(f"v{d} long" for d in range(DIMS))
    sums = docs.select(text_bytes()).mapInArrow(_gather, kind).groupBy("bucket").agg(*(F.sum(f"v{d}") for d in range(DIMS))).collect()
    out = np.zeros((BUCKETS, DIMS))
    for r in sums:
        out[r[0]] = r[1:]
    return (out / (np.linalg.norm(out, axis=1, keepdims=True) + 1)).astype(np.float32)


def pooled(text: bytes, vectors: np.ndarray) -> np.ndarray:
    """The mean of the words' vectors, and of the size of the step from each to the next; zeros for a text without words."""
    total, steps, n, last = np.zeros(DIMS), np.zeros(DIMS), 0, None
    for part in stretches(text):
        w = numbers(part)
        for at in range(0, len(w), HELD):
            own = vectors[w[at : at + HELD]]
            total += own.sum(axis=0, dtype=np.float64)
            steps += np.abs(own[1:] - own[:-1]).sum(axis=0, dtype=np.float64)
            if last is not None:
                steps += np.abs(own[0] - last)
            last = own[-1]
        n += len(w)
    return np.concatenate((total / n, steps / max(1, n - 1))) if n else np.zeros(2 * DIMS)


class Network:
    """One hidden layer of tanh units, trained by Adam on the log loss; then a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        rng = np.random.default_rng(11)
        aside = np.arange(len(x)) % 5 == 4
        if len(x) < 50 or len(set(y[~aside])) < 2:  # too little to learn from: the share of the label
            self.mean, self.dev, self.w, self.temperature = np.zeros(x.shape[1]), np.ones(x.shape[1]), None, 1.0
            self.share = float((y.sum() + 1) / (len(y) + 2))
            return
        self.mean, self.dev = x.mean(axis=0), x.std(axis=0) + 1e-6
        z, t = self._scaled(x[~aside]), y[~aside].astype(float)
        d = z.shape[1]
        self.w = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.array(np.log((t.mean() + 1e-3) / (1 - t.mean() + 1e-3)))]
        m, v, step = [np.zeros_like(p) for p in self.w], [np.zeros_like(p) for p in self.w], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(z))
            for at in range(0, len(z), BATCH):
                some, step = order[at : at + BATCH], step + 1
                hidden = np.tanh(z[some] @ self.w[0] + self.w[1])
                error = (1 / (1 + np.exp(-(hidden @ self.w[2] + self.w[3]))) - t[some]) / len(some)
                back = np.outer(error, self.w[2]) * (1 - hidden**2)
                for k, g in enumerate((z[some].T @ back + DECAY * self.w[0], back.sum(axis=0), hidden.T @ error + DECAY * self.w[2], error.sum())):
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.temperature = 1.0
        raw, t = self.logits(x[aside]), y[aside]
        loss = lambda k: np.logaddexp(0, np.where(t == 1, -raw, raw) / k).mean()
        self.temperature = float(min(np.geomspace(0.25, 8, 41), key=loss))

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.dev, -8, 8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return (np.tanh(self._scaled(x) @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]) / self.temperature

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share) if self.w is None else 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


def verdict_of(labels: DataFrame, column: str, folds: int, aside: int) -> DataFrame:
    """doc_id and y of the labelled rows outside the fold that is held out; a doc_id with several labels has their mean."""
    rows = labels.select(F.col("doc_id").cast("long"), F.col(column).cast("double").alias("y")).dropna()
    return rows.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != aside).groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))


def held_out(folds: int, aside: int):  # noqa: ANN201
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == aside, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs.

    A null or empty text pools to zeros and gets the score of zeros; a text of any length is read whole, in parts. A null doc_id is never labelled and not held out.
    Repeated rows have equal scores; of rows that share a labelled doc_id one is learned from. Without labels, or with
    labels of one kind only, every score is the label's share. An empty table gives an empty
    result. Other columns than doc_id and text are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text"))
    vectors = word_vectors(docs)
    chosen = verdict_of(labels, label, 4, 2).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    shared = spark.sparkContext.broadcast(vectors)

    def features(columns: list[list]) -> list[list]:
        return [columns[0], columns[1], [pooled(t, shared.value).tolist() for t in columns[2]]]

    kind = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("x", pa.list_(pa.float64()))])
    # the sample's size is bounded by its parameter
    learned = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text").mapInArrow(by_slices(features, kind), "doc_id long, y int, x array<double>")
    known = sorted(learned.groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("r")).select("doc_id", "r.y", "r.x").collect())
    x = np.array([r.x for r in known]).reshape(-1, 2 * DIMS)
    order = np.random.default_rng(3).permutation(len(x))
    network = spark.sparkContext.broadcast(Network(x[order], np.array([r.y for r in known], int)[order]))

    def scores(columns: list[list]) -> list[list]:
        return [columns[0], network.value.score(np.array([pooled(t, shared.value) for t in columns[1]])).tolist()]

    out = rows.mapInArrow(by_slices(scores, pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])), "doc_id long, score double")
    return out.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
