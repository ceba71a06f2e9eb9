"""Language identification by prediction by partial matching.

Each language has a context tree over bytes: the counts of every byte after every context of up to ``ORDER`` bytes, as
long as the context occurred ``LEAST`` times or more in the language; so the tree is deep where there was much to learn
and shallow elsewhere. It is frozen after training. The code length of a byte is that of the longest context in the tree
that has seen it, plus the escapes on the way there (method C: of n occurrences with d distinct bytes, a byte seen k
times costs log2((n + d) / k), an escape log2((n + d) / d)); what no context has seen costs 8 bits. A text begins after
``ORDER`` blanks, and is given the language that codes it in the fewest bits.

The trees of all languages are laid out as sorted tables of (context, byte), an order each, with the code length in every
language; a language that doesn't have a context gets what its shorter context says. A byte of a text is looked up in the
longest order first, and in shorter ones only if no language has seen it there.

Defined results: texts that are null or have no letter are ``und`` with score 0; ties go to the language that is first
in code point order; without any labelled text all are ``und``; repeated rows get equal results; other columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded, slices, utf8

#: Documents that are learned from, about: of each language, and of all (dealt evenly), taken by a hash of the id.
PER_LANGUAGE, SAMPLE = 1500, 12_000
#: Bytes of the longest contexts, and occurrences that a context needs to be in a tree.
ORDER, LEAST = 4, 2
UNKNOWN = "und"
#: Bytes of text scored at a time.
CHUNK = 1 << 18


def training_sample(docs: DataFrame, per_language: int, sample: int) -> DataFrame:
    """About ``per_language`` rows of each language (all if it has fewer), ``sample`` in all, chosen by a hash of the id;
    null lang is left out."""
    known = docs.where(F.col("lang").isNotNull()).select("doc_id", F.col("lang").alias("lang"), "text")
    sizes = known.groupBy("lang").agg(F.count("*").alias("rows_of_lang"))
    wanted = max(1, min(per_language, sample // max(1, sizes.count())))
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language sample")), F.lit(1 << 20)) * F.col("rows_of_lang") < F.lit(wanted << 20)
    return known.join(F.broadcast(sizes), "lang").where(drawn).select("lang", "text")


def codes_of(text: bytes) -> np.ndarray:
    """For each byte its context and itself as one number, the byte lowest."""
    x = np.frombuffer(b" " * ORDER + text, np.uint8).astype(np.int64)
    code = x[: len(text)].copy()
    for k in range(1, ORDER + 1):
        code <<= 8
        code |= x[k : k + len(text)]
    return code


def count_contexts(sample: DataFrame) -> DataFrame:
    """(lang, code, n): how often each byte follows each longest context; partial counts are summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bounded(batches, 512, 4_000_000):
            langs, texts = part.column("lang").to_pylist(), utf8(part.column("text"))
            for lang in sorted(set(langs)):
                codes, n = np.unique(np.concatenate([codes_of(t) for t, own in zip(texts, langs, strict=True) if own == lang]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["lang", "code", "n"])

    return sample.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


@dataclass
class Order:
    """The contexts of one length in all trees: ``keys`` (context, byte) with ``bits`` by language, and ``contexts`` with
    the bits of an ``escape`` by language (0 where its tree doesn't have the context)."""

    keys: np.ndarray
    bits: np.ndarray
    contexts: np.ndarray
    escape: np.ndarray


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the sorted table, True where the wanted number is there)."""
    if not len(table):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return at, table[at] == wanted


def grow(counts: list[tuple[np.ndarray, np.ndarray]]) -> list[Order]:
    """The trees of languages, from the counts (codes, n) of each, an Order for each length of context from 0 on."""
    made: list[Order] = []
    for k in range(ORDER + 1):
        trees = []
        for codes, n in counts:
            keys, inverse = np.unique(codes & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            seen = np.bincount(inverse, weights=n, minlength=len(keys))
            contexts, of = np.unique(keys >> 8, return_inverse=True)
            total, distinct = np.bincount(of, weights=seen), np.bincount(of)
            stays = (total >= LEAST) | (k == 0)
            trees.append((keys[stays[of]], np.log2((total + distinct)[of] / seen)[stays[of]], contexts[stays], np.log2((total + distinct) / np.maximum(distinct, 1))[stays]))
        keys, contexts = (np.unique(np.concatenate([t[i] for t in trees])) for i in (0, 2))
        escape = np.zeros((len(contexts), len(trees)), np.float32)
        bits = np.full((len(keys), len(trees)), 8, np.float32)
        if k:  # what a shorter context says; it is in a table, as it occurred as often at least
            bits = made[-1].bits[_find(made[-1].keys, keys & ((1 << 8 * k) - 1))[0]].copy()
        for lang, (own, cost, nodes, out) in enumerate(trees):
            escape[_find(contexts, nodes)[0], lang] = out
            bits[:, lang] += escape[_find(contexts, keys >> 8)[0], lang]
            bits[_find(keys, own)[0], lang] = cost
        made.append(Order(keys, bits, contexts, escape))
    return made


class Model:
    """languages, in code point order, and their trees."""

    def __init__(self, languages: list[str], orders: list[Order]) -> None:
        self.languages, self.orders = languages, orders

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths (text, language)."""
        total = np.zeros((len(texts), len(self.languages)))
        held, owner, size = [], [], 0
        for i, text in enumerate(texts):
            for at in range(0, len(text), CHUNK):  # contexts reach back over the cut
                before = min(at, ORDER)
                held.append(codes_of(text[at - before : at + CHUNK])[before:])
                owner.append(i)
                size += len(held[-1])
                if size >= CHUNK:
                    self._add(total, held, owner)
                    held, owner, size = [], [], 0
        if held:
            self._add(total, held, owner)
        return total

    def _add(self, total: np.ndarray, held: list[np.ndarray], owner: list[int]) -> None:
        code, of = np.concatenate(held), np.repeat(owner, [len(x) for x in held])
        cost = np.zeros((len(code), len(self.languages)), np.float32)
        left = np.arange(len(code))
        for k in range(ORDER, -1, -1):
            order, own = self.orders[k], code[left] & ((1 << 8 * (k + 1)) - 1)
            at, there = _find(order.keys, own)
            cost[left[there]] += order.bits[at[there]]
            left, own = left[~there], own[~there]
            at, there = _find(order.contexts, own >> 8)
            cost[left[there]] += order.escape[at[there]]
        cost[left] += 8
        for lang in range(len(self.languages)):
            total[:, lang] += np.bincount(of, weights=cost[:, lang], minlength=len(total))

    def predict(self, texts: list[bytes]) -> list[tuple[str, float]]:
        spoken = [bool(self.languages) and any(map(str.isalpha, x.decode("utf-8", "replace"))) for x in texts]
        bits = self.bits([x if ok else b"" for x, ok in zip(texts, spoken, strict=True)])
        out = []
        for row, ok in zip(bits, spoken, strict=True):
            best = int(row.argmin()) if ok else 0
            out.append((self.languages[best], float(1 / np.exp2(np.clip(row[best] - row, -1000, 0)).sum())) if ok else (UNKNOWN, 0.0))
        return out


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> Model:
    """Learns from ``docs`` (doc_id, text, lang). To the driver come the counts of the sample, which is bounded."""
    with Scratch(docs.sparkSession) as own:
        rows = count_contexts(own.table(training_sample(docs, per_language, sample), "language-sample")).toArrow()
    rows = rows.sort_by([("lang", "ascending"), ("code", "ascending")])
    langs = np.array(rows.column("lang").to_pylist(), object)
    codes, n = rows.column("code").to_numpy(), rows.column("n").to_numpy()
    languages = sorted(set(langs.tolist()), key=lambda x: x.encode())
    return Model(languages, grow([(codes[langs == x], n[langs == x]) for x in languages]) if languages else [])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (the probability of the language, all being as likely before) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.orders))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for part in slices(batches):
            found = own.predict(utf8(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
