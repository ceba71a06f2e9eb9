"""Trimming of reads. All steps of a batch run on flat numpy arrays in one Arrow function (see ``batch``), so the plan is
one pass over the reads, whatever is trimmed; filters and counts stand behind it and can't multiply its expressions.

``trim_reads`` runs the steps in their fixed order: UMI, front, tail, cut_front, cut_tail, cut_right, adapters, poly-G,
poly-X, length filter. A single step is a configuration with that step alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import adapters as A
from . import batch as B


@dataclass(frozen=True)
class TrimConfig:
    """What to trim; nothing by default. Values are checked when it is made."""

    umi_length: int = 0
    front: int = 0
    tail: int = 0
    cut_front: bool = False
    cut_tail: bool = False
    cut_right: bool = False
    quality: int = 20
    window: int = 4
    adapter_trimming: bool = False
    adapters: tuple[str, ...] = tuple(seq for _, seq in A.STANDARD)
    poly_g: int = 0
    poly_x: int = 0
    min_length: int = 0
    correction: bool = False
    merge: bool = False
    # Fixed values that have no option.
    min_match: int = 6
    min_overlap: int = 30
    most_mismatches: int = 5
    mismatch_percent: int = 20

    def __post_init__(self) -> None:
        if not 0 <= self.quality <= 93:
            raise ValueError("quality must be 0 to 93")
        if self.window < 1 or self.min_match < 1 or self.min_overlap < 1:
            raise ValueError("window, min_match and min_overlap must be above zero")
        if min(self.umi_length, self.front, self.tail, self.poly_g, self.poly_x, self.min_length, self.most_mismatches, self.mismatch_percent) < 0:
            raise ValueError("lengths must not be negative")
        for a in self.adapters:
            if not a or set(a.upper()) - set("ACGTN"):
                raise ValueError(f"not an adapter sequence: {a!r}")
        if self.adapter_trimming and not any(len(a) >= self.min_match for a in self.adapters):
            raise ValueError(f"adapters need {self.min_match} bases or more")

    @classmethod
    def full(cls, **own) -> TrimConfig:
        """The full profile; ``own`` overrides it."""
        return replace(cls(cut_front=True, cut_tail=True, cut_right=True, quality=20, window=4, min_length=50, poly_g=10, poly_x=10, adapter_trimming=True), **own)


#: What trimming adds to a read.
FLAGS = {
    "original_length": "long", "quality_trimmed": "boolean", "adapter_position": "int", "poly_g_trimmed": "boolean", "poly_x_trimmed": "boolean",
    "corrected_bases": "long", "umi": "string", "failed": "string", "passed": "boolean",
}


def first_adapter(sequences: list[bytes], adapters: list[bytes], min_match: int = 6) -> np.ndarray:
    """First position at which an adapter is found in each read, -1 for none."""
    s, at = B.flat(pa.array(sequences, pa.binary()))
    found = B.first_adapters(s, at[:-1], at[1:], [a.upper() for a in adapters], min_match)
    return np.where(found < 0, -1, found - at[:-1])


def trim_reads(reads: DataFrame, c: TrimConfig) -> DataFrame:
    """All reads, those that fail included, with FLAGS; ``failed`` is the reason, ``passed`` says that there is none.

    A read that is too short for its UMI fails and stays as it is. The position of an adapter is counted in the read as
    the steps before left it. Columns that reads have beyond sequence, quality and header pass through.
    """
    names = [x for x in reads.columns if x not in FLAGS]
    kinds = {**dict(reads.dtypes), **FLAGS}
    adapters = [a.upper().encode() for a in c.adapters]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in B.pieces(batches):
            own = B.Reads(part.column("sequence"), part.column("quality"))
            if c.umi_length:
                own.umi(c.umi_length)
            own.quality_steps(c)
            if c.adapter_trimming:
                own.cut_at(own.adapters(adapters, c.min_match))
            own.last_steps(c)
            made = own.columns(part.column("header") if c.umi_length else None)
            yield pa.RecordBatch.from_arrays([made[n] if n in made else part.column(n) for n in (*names, *FLAGS)], [*names, *FLAGS])

    return reads.select(*names).mapInArrow(run, ", ".join(f"`{n}` {kinds[n]}" for n in (*names, *FLAGS)))


def counters(k: str = "") -> list[tuple[str, Column]]:
    """(name, aggregate) of every counter of trimmed reads, whose columns end with ``k``; bases of reads that fail count too."""
    col = lambda c: F.col(f"{c}{k}")
    n = F.length(col("sequence")).cast("long")
    count = lambda x: F.coalesce(F.sum(x.cast("long")), F.lit(0).cast("long"))
    return [
        ("total_reads", F.count("*")), ("passed_reads", count(col("passed"))), ("discarded_reads", count(~col("passed"))),
        ("bases_before", count(col("original_length"))), ("bases_after", count(n)), ("bases_trimmed", count(col("original_length") - n)),
        ("quality_trimmed_reads", count(col("quality_trimmed"))), ("adapter_trimmed_reads", count(col("adapter_position").isNotNull())),
        ("poly_g_trimmed_reads", count(col("poly_g_trimmed"))), ("poly_x_trimmed_reads", count(col("poly_x_trimmed"))),
        ("too_short_reads", count(F.coalesce(col("failed") == "TOO_SHORT", F.lit(False)))), ("corrected_reads", count(col("corrected_bases") > 0)), ("corrected_bases", count(col("corrected_bases"))),
        ("umi_processed_reads", count(col("umi").isNotNull())), ("umi_failed_reads", count(F.coalesce(col("failed") == "UMI_TOO_SHORT", F.lit(False)))), ("umi_bases", count(F.coalesce(F.length(col("umi")), F.lit(0)))),
    ]


def trim_statistics(trimmed: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return trimmed.groupBy(*keys).agg(*[x.alias(name) for name, x in counters()])


def adapter_positions(trimmed: DataFrame) -> DataFrame:
    return trimmed.where(F.col("adapter_position").isNotNull()).groupBy(F.col("adapter_position").alias("position")).agg(F.count("*").alias("reads"))
