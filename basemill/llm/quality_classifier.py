"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network in numpy.

Every word has a fixed sparse index vector (a few +1 and -1 of ``DIMENSIONS``, by its hash). A word's vector is its own
index vector plus those of its neighbours, summed over all occurrences in all documents: a matrix of integer sums, one
row for each hash bucket, so partial sums of partitions add up in any order. Next to words, their shapes (classes of the
first two and last three characters) are words of a second vocabulary. A document is the mean of the unit vectors of its
words and of its shapes. The network is trained on a bounded sample of labelled rows; a temperature fitted on rows kept
from training calibrates its probabilities.

Defined results: null and empty texts are the zero vector and get a score as any other; without labels of both classes
all scores are the share of good ones (1 without any); repeated rows get equal scores; an empty table gives an empty
table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices, utf8

WORDS, SHAPES, DIMENSIONS, SPARKS = 1 << 14, 1 << 10, 64, 4
BUCKETS = WORDS + SHAPES
#: Buckets whose sums travel as one row.
BLOCK = 16
_CLASS = bytes(ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57 else ord("a") if 97 <= b <= 122 or b >= 128 else b for b in range(256))


def index_vectors(seed: int = 7) -> np.ndarray:
    """(BUCKETS, SPARKS, 2): dimension and sign of each spark."""
    rng = np.random.default_rng(seed)
    dims = np.argsort(rng.random((BUCKETS, DIMENSIONS)), axis=1)[:, :SPARKS]
    return np.stack([dims, rng.integers(0, 2, dims.shape) * 2 - 1], axis=2)


def buckets(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and of their shapes, in order."""
    words = text.split()
    crc = zlib.crc32
    own = np.fromiter((crc(w.lower()) for w in words), np.int64, len(words)) % WORDS
    shapes = np.fromiter((crc((w[:2] + b" " + w[-3:]).translate(_CLASS)) for w in words), np.int64, len(words)) % SHAPES + WORDS
    return own, shapes


def _add(sums: np.ndarray, rows: np.ndarray, of: np.ndarray, index: np.ndarray) -> None:
    """sums[rows[i]] += index vector of of[i]."""
    for k in range(SPARKS):
        at = rows * DIMENSIONS + index[of, k, 0]
        sums += np.bincount(at, weights=index[of, k, 1], minlength=sums.size).astype(np.int64)


def word_sums(docs: DataFrame) -> np.ndarray:
    """(BUCKETS, DIMENSIONS) sums over all documents. The result, of fixed size, is all that reaches the driver.

    Each partition adds up its own matrix; blocks of its rows are dealt by block and added while they stream.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, sums = index_vectors(), np.zeros(BUCKETS * DIMENSIONS, np.int64)
        rows: list[np.ndarray] = []
        of: list[np.ndarray] = []
        held = 0

        def flush() -> None:
            if rows:
                _add(sums, np.concatenate(rows), np.concatenate(of), index)
                rows.clear(), of.clear()

        for part in slices(batches):
            for text in utf8(part.column("text")):
                own, shapes = buckets(text)
                for x in (own, shapes):
                    rows.extend((x, x[:-1], x[1:]))
                    of.extend((x, x[1:], x[:-1]))
                held += len(own)
                if held > 500_000:
                    flush()
                    held = 0
        flush()
        yield from _blocks(sums)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for part in slices(batches):
            for block, data in zip(part.column("block").to_pylist(), part.column("sums").to_pylist(), strict=True):
                x = np.frombuffer(data, np.int64)
                found[block] = found[block] + x if block in found else x
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())], ["block", "sums"])

    schema = "block int, sums binary"
    parts = docs.select("text").mapInArrow(partial, schema)
    rows = parts.repartition("block").mapInArrow(total, schema).toArrow()
    sums = np.zeros((BUCKETS // BLOCK, BLOCK * DIMENSIONS), np.int64)
    for block, data in zip(rows.column("block").to_pylist(), rows.column("sums").to_pylist(), strict=True):
        sums[block] += np.frombuffer(data, np.int64)
    return sums.reshape(BUCKETS, DIMENSIONS)


def _blocks(sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    blocks = sums.reshape(-1, BLOCK * DIMENSIONS)
    some = np.flatnonzero(blocks.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([blocks[i].tobytes() for i in some], pa.binary())], ["block", "sums"])


def unit_vectors(sums: np.ndarray) -> np.ndarray:
    """Word vectors: damped, so frequent neighbours don't rule, and of length 1."""
    x = np.sign(sums) * np.log1p(np.abs(sums))
    return (x / np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))).astype(np.float32)


def pool(text: bytes, vectors: np.ndarray) -> np.ndarray:
    """The document's vector: means over words and over shapes."""
    own, shapes = buckets(text)
    if not len(own):
        return np.zeros(2 * DIMENSIONS, np.float32)
    n = np.bincount(shapes, minlength=BUCKETS)
    some = np.flatnonzero(n)
    return np.concatenate([vectors[own].mean(axis=0), (n[some] / len(own)).astype(np.float32) @ vectors[some]])


@dataclass(frozen=True)
class Param:
    #: Labelled rows trained on, at most (a sample by a hash of the id).
    examples: int = 8000
    hidden: int = 32
    epochs: int = 60
    batch: int = 128
    rate: float = 3e-3
    decay: float = 1e-4
    #: Every so manieth example calibrates and doesn't train.
    calibrate: int = 5
    seed: int = 11


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class Network:
    """Two layers over standardised inputs, and a temperature."""

    def __init__(self, mean, scale, w1, b1, w2, b2, temperature=1.0) -> None:
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2, self.temperature = mean, scale, w1, b1, w2, b2, temperature

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


def fit_network(x: np.ndarray, y: np.ndarray, param: Param) -> Network:
    """Logistic loss, Adam on small batches; then the temperature with the least loss on the calibration rows."""
    x, y, rng = x.astype(np.float64), y.astype(np.float64), np.random.default_rng(param.seed)
    kept = np.arange(len(y)) % param.calibrate == param.calibrate - 1
    if len(set(y[kept])) < 2 or len(set(y[~kept])) < 2:
        kept[:] = False
    xt, yt = x[~kept], y[~kept]
    mean, scale = xt.mean(axis=0), xt.std(axis=0) + 1e-3
    xt, n = (xt - mean) / scale, len(yt)
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], param.hidden)), np.zeros(param.hidden), rng.normal(0, param.hidden**-0.5, param.hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(param.epochs):
        for at in np.array_split(rng.permutation(n), max(1, n // param.batch)):
            h = np.tanh(xt[at] @ p[0] + p[1])
            e = (_sigmoid(h @ p[2] + p[3]) - yt[at]) / len(at)
            back = np.outer(e, p[2]) * (1 - h * h)
            step += 1
            for k, g in enumerate((xt[at].T @ back + param.decay * p[0], back.sum(axis=0), h.T @ e + param.decay * p[2], np.array([e.sum()]))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - param.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    if kept.any():
        z, yk = net.logits(x[kept]), y[kept]
        loss = lambda t: float(np.mean(np.logaddexp(0, z / t) - yk * z / t))
        net.temperature = min(np.geomspace(0.25, 8, 61), key=loss)
    return net


def pooled(docs: DataFrame, vectors: np.ndarray, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``vector`` (float32 bytes) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            made = [pool(x, shared.value).tobytes() for x in utf8(part.column("text"))]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(made, pa.binary())], [*keep, "vector"])

    return docs.select(*keep, "text").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", vector binary")


def score_documents(docs: DataFrame, labels: DataFrame, param: Param = Param()) -> DataFrame:
    """doc_id, score of every document. ``labels``: doc_id, quality, of the rows that may be learned from; contrary labels
    of an id count as good, and rows that share an id as one example.

    Word vectors come from all documents and all are pooled, once; the pooled vectors (512 bytes a document) are written,
    for training and scoring to read.
    """
    with Scratch(docs.sparkSession) as own:
        vectors = unit_vectors(word_sums(docs))
        table = own.table(pooled(docs.select(F.col("doc_id").cast("bigint"), "text"), vectors, ["doc_id"]), "quality-vectors")
        known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
        drawn = known.orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id").limit(param.examples)
        rows = table.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "quality").agg(F.min("vector").alias("vector")).toArrow().sort_by("doc_id")
        y = np.array(rows.column("quality").to_pylist(), np.int64) == 1
        x = np.frombuffer(b"".join(rows.column("vector").to_pylist()), np.float32).reshape(-1, 2 * DIMENSIONS)
        if len(set(y.tolist())) < 2:
            return own.keep(table.select("doc_id", F.lit(float(y.mean()) if len(y) else 1.0).alias("score")), "quality-scores")
        net = fit_network(x, y, param)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, 4096):
                x = np.frombuffer(b"".join(part.column("vector").to_pylist()), np.float32).reshape(-1, 2 * DIMENSIONS)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(net.probabilities(x), pa.float64())], ["doc_id", "score"])

        return own.keep(table.mapInArrow(run, "doc_id long, score double"), "quality-scores")
