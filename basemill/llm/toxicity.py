"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples and unlabelled text train a linear classifier in numpy. Unlabelled text holds toxic examples
too, in the share of the class prior; the risk of the negative class is therefore that of the unlabelled text less the
prior's part of the positives, and where that estimate falls below zero its gradient is turned round, so that the
classifier can't gain by fitting single examples.

A text's features are the distinct words (lower-cased, without the marks around them) and distinct word beginnings that
it has, out of a vocabulary of those that confirmed examples have more often than all documents have.

What is learned from: confirmed examples and unlabelled text are bounded samples of the labelled rows (as unlabelled text
their label isn't used; the class prior is that of the same rows). How often features are in unlabelled text is counted
over all documents.

Defined results: null and empty texts have no features and get the base score; without confirmed examples every score is
0; rows that repeat an id count as one example, with the smallest text, toxic if any label says so; repeated rows get
equal scores; columns of ``docs`` pass through; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, binomial_at_least, slices, utf8

MARKS = b".,;:!?\"'()[]{}<>#*$%&|-_~`"
START = 4


@dataclass(frozen=True)
class Param:
    #: Labelled rows trained on, at most: confirmed examples, and rows taken as unlabelled text (by a hash of the id).
    positives: int = 3000
    unlabelled: int = 6000
    vocabulary: int = 1500
    #: A feature is used if confirmed examples have it so many times as often, and so many of them have it,
    lift: float = 3.0
    support: int = 3
    #: ... and chance would bring it into so many of them with at most this probability.
    chance: float = 1e-3
    steps: int = 1500
    rate: float = 0.05
    decay: float = 2e-5


def features(text: bytes) -> set[bytes]:
    """Distinct words, and word beginnings followed by a mark."""
    words = {w.strip(MARKS) for w in set(text.lower().split())}
    words.discard(b"")
    return words | {w[:START] + b"~" for w in words if len(w) > START}


class Model:
    def __init__(self, weights: dict[bytes, float], bias: float) -> None:
        self.weights, self.bias = weights, bias
        self.names = frozenset(weights)

    def score(self, text: bytes) -> float:
        x = self.bias + sum(self.weights[w] for w in sorted(features(text) & self.names))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


NEVER = Model({}, -1e9)


def choose_vocabulary(positive: dict[bytes, int], n: int, everywhere: dict[bytes, int], m: int, param: Param) -> list[bytes]:
    """Features that ``n`` confirmed examples have more often than ``m`` documents, by how unlikely chance has it so."""
    rated = []
    for word, k in positive.items():
        b = (everywhere.get(word, 0) + 0.5) / (m + 1)
        if k >= param.support and k / n >= param.lift * b and (p := binomial_at_least(k, n, b)) <= param.chance:
            rated.append((p, -k, word))
    return [w for _, _, w in sorted(rated)[: param.vocabulary]]


def fit_nnpu(xp: np.ndarray, xu: np.ndarray, prior: float, param: Param) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative estimate of the logistic risk (full batches, Adam)."""
    w, b = np.zeros(xp.shape[1], np.float32), math.log(prior / (1 - prior))
    moments = np.zeros((2, xp.shape[1] + 1))
    sigmoid = lambda z: (1 / (1 + np.exp(-np.clip(z, -60, 60)))).astype(np.float32)
    for step in range(1, param.steps + 1):
        zp, zu = xp @ w + b, xu @ w + b
        # derivatives of the losses log(1 + e^-z) and log(1 + e^z)
        as_positive = -prior * (1 - sigmoid(zp)) / len(zp)
        as_negative_p, as_negative_u = -prior * sigmoid(zp) / len(zp), sigmoid(zu) / len(zu)
        negative_risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        if negative_risk >= 0:
            gp, gu = as_positive + as_negative_p, as_negative_u
        else:
            gp, gu = -as_negative_p, -as_negative_u
        gradient = np.append(gp @ xp + gu @ xu + param.decay * w, gp.sum() + gu.sum())
        moments[0] = 0.9 * moments[0] + 0.1 * gradient
        moments[1] = 0.999 * moments[1] + 0.001 * gradient**2
        move = param.rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1].astype(np.float32), b - move[-1]
    return w, b


def examples(docs: DataFrame, labels: DataFrame, param: Param) -> DataFrame:
    """(doc_id, confirmed, unlabelled, features) of the labelled rows that are learned from. Their ids are drawn first,
    from the labels alone, so no text is shuffled but theirs."""
    first = lambda rows, seed, most: rows.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most).select("doc_id")
    confirmed = first(labels.where("toxic = 1"), "toxic", param.positives).select("doc_id", F.lit(True).alias("confirmed"), F.lit(False).alias("unlabelled"))
    unlabelled = first(labels, "unlabelled", param.unlabelled).select("doc_id", F.lit(False).alias("confirmed"), F.lit(True).alias("unlabelled"))
    ids = confirmed.unionByName(unlabelled).groupBy("doc_id").agg(F.max("confirmed").alias("confirmed"), F.max("unlabelled").alias("unlabelled"))
    own = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "confirmed", "unlabelled").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = pa.array([sorted(features(x)) for x in utf8(part.column("text"))], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("confirmed"), part.column("unlabelled"), found], ["doc_id", "confirmed", "unlabelled", "features"])

    return own.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, confirmed boolean, unlabelled boolean, features array<binary>")


def document_counts(docs: DataFrame, wanted: frozenset[bytes]) -> tuple[dict[bytes, int], int]:
    """In how many documents each wanted feature is, over all of them, and how many documents there are."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for part in slices(batches):
            found[b""] += part.num_rows  # no feature is empty
            for x in utf8(part.column("text")):
                found.update(features(x) & shared.value)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["feature", "n"])

    rows = docs.select("text").mapInArrow(run, "feature binary, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    counted = {bytes(r["feature"]): r["n"] for r in rows}
    return counted, counted.pop(b"", 0)


def train(docs: DataFrame, labels: DataFrame, param: Param = Param()) -> Model:
    """``docs``: doc_id, text; ``labels``: doc_id, toxic, of the rows that may be learned from.

    The prior is the share of toxic ones among all labelled rows. To the driver come numbers of features, and of each
    example those in the vocabulary.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counted = known.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0)).alias("k")).first()
    if not counted["k"]:
        return NEVER
    prior = min(0.95, max(1e-4, counted["k"] / counted["n"]))
    with Scratch(docs.sparkSession) as own:
        rows = own.table(examples(docs, known, param), "toxicity-examples")
        confirmed = rows.where("confirmed")
        n = confirmed.count()
        times = {bytes(r["w"]): r["n"] for r in confirmed.select(F.explode("features").alias("w")).groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= param.support).collect()}
        if not n or rows.where("unlabelled").isEmpty():
            return NEVER
        everywhere, m = document_counts(docs, frozenset(times))
        vocabulary = choose_vocabulary(times, n, everywhere, m, param)
        x = _matrix(rows, vocabulary)
    w, b = fit_nnpu(x["confirmed"], x["unlabelled"], prior, param)
    return Model({v: float(x) for v, x in zip(vocabulary, w, strict=True)}, float(b))


def _matrix(rows: DataFrame, vocabulary: list[bytes]) -> dict[str, np.ndarray]:
    """The examples of each kind as 0/1 rows over the vocabulary, in the order of their ids."""
    number = {w: i for i, w in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            at = pa.array([[number[w] for w in x if w in number] for x in part.column("features").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("confirmed"), part.column("unlabelled"), at], ["doc_id", "confirmed", "unlabelled", "at"])

    table = rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, confirmed boolean, unlabelled boolean, at array<int>").toArrow().sort_by("doc_id")
    made = {}
    for kind in ("confirmed", "unlabelled"):
        some = [at for at, ok in zip(table.column("at").to_pylist(), table.column(kind).to_pylist(), strict=True) if ok]
        made[kind] = np.zeros((len(some), len(vocabulary)), np.float32)
        for i, at in enumerate(some):
            made[kind][i, at] = 1
    return made


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with toxic_score, from the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    names = [*[c for c in docs.columns if c != "toxic_score"], "toxic_score"]
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for part in slices(batches):
            scores = pa.array([own.score(x) for x in utf8(part.column("text"))], pa.float64())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:-1]), scores], names)

    return docs.select(*names[:-1]).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names[:-1]) + ", toxic_score double")
