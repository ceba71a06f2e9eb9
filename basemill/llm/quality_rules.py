"""Quality rules whose cutoffs come with a guarantee on false rejection.

Base figures of each text are counted exactly; the rules' scores are made from them (higher is worse). In each stratum
(band of lengths) a score is measured in units of what 3 of 4 documents of the stratum stay below, over all documents
and without looking at labels; a document is as strange as its strangest score, and one cutoff on that is a cutoff for
every rule. So a stratum has one path of cutoffs, from the loosest to the strictest, fixed before labels are looked at. A
cutoff stands as long as the exact binomial test rejects "more than ``risk`` of the good documents would be lost", for
itself and for all looser ones: within a stratum nothing has to be corrected for, and the rules don't share the loss.
Between the strata ``error`` is corrected by Holm's steps. Of the standing cutoffs the one that best tells bad from good
documents is used; where none tells anything there is none.

A trial is a distinct text with a label: copies and repeated labels say nothing new. A text with contrary labels is good.

Defined results: null or empty text has no words and fails the base rules; without labels no cutoff stands and only the
base rules hold; repeated rows get equal verdicts; ties at a cutoff are rejected together; other columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binomial_at_most, slices, utf8

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
UPPER = bytes(range(65, 91))
#: Scores are cut on this grid: parts of a thousand.
GRID = 1000
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines")
#: Strangeness is cut at these multiples of the unit, and a unit is this many grid steps at least.
LEVELS, LEAST_UNIT = tuple(np.geomspace(1, 200, 160).round(4).tolist()), 5
STRATA = 3


def n_repeat_words(words: list[bytes]) -> int:
    """Words that lie in 3-word windows found twice or more. Windows are numbered exactly, without hashing."""
    n = len(words) - 2
    if n < 2:
        return 0
    number: defaultdict = defaultdict(count().__next__)
    ids = np.fromiter((number[w] for w in words), np.int64, len(words))
    _, pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    _, windows, times = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = times[windows] > 1
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k : k + n] |= again
    return int(inside.sum())


def figures(text: bytes) -> tuple[int, ...]:
    """FIGURES of a text."""
    words = text.split()  # of bytes: at ASCII white space
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    spaces = len(text) - len(text.translate(None, SPACE))
    return (
        len(words), len(text.decode("utf-8", "replace")) - spaces, len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)), n_repeat_words(words), len(text) - len(text.translate(None, UPPER)), len(lines),
    )


def with_figures(docs: DataFrame) -> DataFrame:
    """doc_id, FIGURES and text_hash of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [figures(x) for x in utf8(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), *(pa.array([x[k] for x in found], pa.int64()) for k in range(len(FIGURES)))], ["doc_id", "text_hash", *FIGURES])

    return docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, " + ", ".join(f"{x} long" for x in FIGURES))


def scores() -> dict[str, Column]:
    """The rules' scores in grid steps, from 0 to GRID; higher is worse."""
    part = lambda a, b: F.least(F.lit(GRID), F.floor(F.col(a) * GRID / F.greatest(F.col(b), F.lit(1)))).cast("int")
    return {"symbols": part("n_symbols", "word_chars"), "upper": part("n_upper", "word_chars"), "lines": part("n_dup_lines", "n_lines"), "repeats": part("n_repeat_words", "n_words")}


def stratum() -> Column:
    return F.when(F.col("n_words") < 150, 0).when(F.col("n_words") < 500, 1).otherwise(2)


@dataclass(frozen=True)
class Risk:
    """Of the good documents of a stratum at most ``risk`` are lost, but for a chance of ``error`` over all strata."""

    risk: float = 0.05
    error: float = 0.05
    #: A good document lost weighs as much as so many bad ones kept.
    price: float = 10.0


def units(histogram: dict[int, int]) -> int:
    """The step that 3 of 4 documents stay below or at, LEAST_UNIT at least."""
    total, upto = sum(histogram.values()), 0
    for step in sorted(histogram):
        upto += histogram[step]
        if 4 * upto >= 3 * total:
            return max(LEAST_UNIT, step)
    return LEAST_UNIT


def standing(good: np.ndarray, risk: float) -> list[float]:
    """For each cutoff of the path, the loosest first, the p-value of "more than ``risk`` are lost", as the largest so far."""
    n, lost, out, worst = int(good.sum()), 0, [], 0.0
    for level in range(len(good) - 1, 0, -1):
        lost += int(good[level])
        worst = max(worst, binomial_at_most(lost, n, risk)) if n else 1.0
        out.append(worst)
        if worst >= 1:
            break
    return out


def choose_cutoffs(good: list[np.ndarray], bad: list[np.ndarray], param: Risk) -> list[int | None]:
    """Of each stratum the number of the level from which on documents are rejected, or None. ``good`` and ``bad`` count
    the holdouts by the highest level that they reach (0: none)."""
    paths = [standing(g, param.risk) for g in good]
    # Holm: strata by the p-value of their loosest cutoff; the k-th smallest may use error / (strata - k)
    order = sorted(range(len(paths)), key=lambda s: (paths[s][0] if paths[s] else 1.0, s))
    chosen: list[int | None] = [None] * len(paths)
    for k, s in enumerate(order):
        allowed = param.error / (len(paths) - k)
        if not paths[s] or paths[s][0] > allowed:
            break
        best, lost, caught = 0.0, 0, 0
        for i, p in enumerate(paths[s]):
            level = len(good[s]) - 1 - i
            lost, caught = lost + int(good[s][level]), caught + int(bad[s][level])
            if p > allowed:
                break
            gain = caught / max(1, int(bad[s].sum())) - param.price * lost / max(1, int(good[s].sum()))
            if gain > best + 1e-12:
                best, chosen[s] = gain, level
    return chosen


def fit_cutoffs(figured: DataFrame, labels: DataFrame, param: Risk = Risk()) -> dict[tuple[int, str], float]:
    """Cutoffs in grid steps by (stratum, rule). ``labels``: doc_id, good (boolean).

    Counts by stratum, rule and grid step, and by stratum and level, are all that reaches the driver, whatever the input.
    """
    rules = scores()
    steps = figured.select(stratum().alias("stratum"), F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("step")) for k, v in rules.items()])).alias("x"))
    histograms: dict = defaultdict(dict)
    for r in steps.groupBy("stratum", "x.rule", "x.step").count().collect():
        histograms[r["stratum"], r["rule"]][r["step"]] = r["count"]
    unit = {(s, k): units(histograms[s, k]) for s in range(STRATA) for k in rules}
    strange = F.greatest(*[v / F.coalesce(*[F.when(stratum() == s, F.lit(float(unit[s, k]))) for s in range(STRATA)]) for k, v in rules.items()])
    level = F.size(F.filter(F.array(*[F.lit(x) for x in LEVELS]), lambda x: x <= strange))
    trials = figured.join(labels, "doc_id").groupBy("text_hash").agg(F.max("good").alias("good"), F.max(stratum()).alias("stratum"), F.max(level).alias("level"))
    counts = {g: [np.zeros(len(LEVELS) + 1, np.int64) for _ in range(STRATA)] for g in (True, False)}
    for r in trials.groupBy("good", "stratum", "level").count().collect():
        counts[r["good"]][r["stratum"]][r["level"]] += r["count"]
    chosen = choose_cutoffs(counts[True], counts[False], param)
    return {(s, k): LEVELS[c - 1] * unit[s, k] for s, c in enumerate(chosen) if c is not None for k in rules}


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(cutoffs: dict[tuple[int, str], float]) -> Column:
    """True where no rule of the document's stratum rejects it."""
    rules, rejected = scores(), F.lit(False)
    for (s, k), cut in sorted(cutoffs.items()):
        rejected = rejected | ((stratum() == s) & (rules[k] >= cut))
    return ~rejected
