"""Read pairs: joining mates, overlaps, correction, merging and the trimming of pairs.

Mates are columns with the suffix 1 and 2. What compares mates base by base runs on the flat arrays of ``batch``, all
pairs of a batch at once; the whole trimming of pairs is one Arrow function.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as E
from . import batch as B
from . import trimming as T
from .trimming import FLAGS, TrimConfig

OVERLAP = "struct<start1:int,start2:int,length:int,mismatches:int>"
_OVERLAP = pa.struct([(n, pa.int32()) for n in ("start1", "start2", "length", "mismatches")])
_MATE = ("header", "sequence", "quality")
#: Bytes of a padded block of mates; bases that a shift compares before the pairs that differ too much are left out.
BLOCK, PROBE = 1 << 20, 32


def join_mates(r1: DataFrame, r2: DataFrame) -> DataFrame:
    """Pairs by record number; both sides must have the same numbers (see ``validation.mate_problems``)."""
    side = lambda d, k: d.select("record_number", *[F.col(c).alias(f"{c}{k}") for c in _MATE])
    return side(r1, 1).join(side(r2, 2), "record_number")


def _matrix(s: np.ndarray, begin: np.ndarray, end: np.ndarray, pad: int) -> np.ndarray:
    length = end - begin
    m = np.full((len(begin), int(length.max(initial=0))), pad, np.uint8)
    m[np.arange(m.shape[1]) < length[:, None]] = s[B.ranges(begin, length)[1]]
    return m


def overlaps(one: B.Reads, two: B.Reads, rows: np.ndarray, c: TrimConfig) -> np.ndarray:
    """(start1, start2, length, mismatches) of the best overlap of each read with the reverse complement of its mate, for
    the pairs ``rows``; start1 is -1 for the others and where there is none.

    Better is longer, then fewer mismatches, then the earlier start in the first and in the second. All shifts are tried,
    each for all pairs of a block at once; blocks hold pairs of like lengths, so their padding is bounded.
    """
    best = np.full((len(one.begin), 4), -1, np.int64)
    best[:, 2] = 0
    s1, s2 = B.NORMAL[one.s], B.COMPLEMENT[two.s[::-1]]
    n1, n2 = one.end - one.begin, two.end - two.begin
    rows = rows[(n1[rows] >= c.min_overlap) & (n2[rows] >= c.min_overlap)]
    rows = rows[np.lexsort((rows, n1[rows] + n2[rows]))]
    while len(rows):
        widest = np.maximum.accumulate(n1[rows] + n2[rows])
        block = rows[: max(1, int(np.searchsorted(widest * np.arange(1, len(rows) + 1), BLOCK, "right")))]
        rows = rows[len(block) :]
        a = _matrix(s1, one.begin[block], one.end[block], 0)
        b = _matrix(s2, len(two.s) - two.end[block], len(two.s) - two.begin[block], 255)
        best[block] = _best_shift(a, b, n1[block], n2[block], c)
    return best


def _best_shift(a: np.ndarray, b: np.ndarray, n1: np.ndarray, n2: np.ndarray, c: TrimConfig) -> np.ndarray:
    best = np.full((len(a), 4), -1, np.int64)
    best[:, 2] = 0
    for shift in range(c.min_overlap - b.shape[1], a.shape[1] - c.min_overlap + 1):
        s1, s2 = max(shift, 0), max(-shift, 0)
        length = np.minimum(n1 - s1, n2 - s2)
        rows = np.flatnonzero((length >= c.min_overlap) & (length >= best[:, 2]))
        if not len(rows):
            continue
        allowed = np.minimum(c.most_mismatches, length * c.mismatch_percent // 100)
        w = min(a.shape[1] - s1, b.shape[1] - s2)
        if w > PROBE:  # padding is never equal, and counts as wrong only beyond a pair's own length
            same = np.count_nonzero(a[rows, s1 : s1 + PROBE] == b[rows, s2 : s2 + PROBE], axis=1)
            rows = rows[np.minimum(length[rows], PROBE) - same <= allowed[rows]]
            if not len(rows):
                continue
        wrong = length[rows] - np.count_nonzero(a[rows, s1 : s1 + w] == b[rows, s2 : s2 + w], axis=1)
        rows, wrong = rows[wrong <= allowed[rows]], wrong[wrong <= allowed[rows]]
        found = np.stack([np.full(len(rows), s1), np.full(len(rows), s2), length[rows], wrong], axis=1)
        old = best[rows]
        better = old[:, 0] < 0
        equal = ~better
        for k, sign in ((2, -1), (3, 1), (0, 1), (1, 1)):
            better |= equal & (sign * found[:, k] < sign * old[:, k])
            equal &= found[:, k] == old[:, k]
        best[rows[better]] = found[better]
    return best


def correct(one: B.Reads, two: B.Reads, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Puts the better base in both mates where they differ within their overlaps; returns how many changed in each."""
    rows = np.flatnonzero(found[:, 0] >= 0)
    at, i = B.ranges((one.begin + found[:, 0])[rows], found[rows, 2])
    j = (two.end - 1 - found[:, 1])[rows][at] - (i - (one.begin + found[:, 0])[rows][at])
    one.s, one.q, two.s, two.q = (x.copy() for x in (one.s, one.q, two.s, two.q))
    x, y, p, q = B.NORMAL[one.s[i]], B.COMPLEMENT[two.s[j]], one.q[i], two.q[j]
    to_first, to_second = (x != y) & (y != 78) & (q > p), (x != y) & (x != 78) & (p > q)
    one.s[i[to_first]], one.q[i[to_first]] = y[to_first], q[to_first]
    two.s[j[to_second]], two.q[j[to_second]] = B.COMPLEMENT[x[to_second]], p[to_second]
    return tuple(np.bincount(rows[at[some]], minlength=len(found)) for some in (to_first, to_second))


def merge(one: B.Reads, two: B.Reads, found: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """(sequence, quality) of one read over both mates, null without an overlap; read-through keeps the overlap only."""
    some = found[:, 0] >= 0
    n1, n2 = one.end - one.begin, two.end - two.begin
    shift = found[:, 0] - found[:, 1]
    through = (found[:, 0] == 0) & (found[:, 1] > 0)
    low = np.where(through, 0, np.minimum(0, shift))
    high = np.where(through, found[:, 2], np.maximum(n1, shift + n2))
    row, i = B.ranges(np.where(some, low, 0), np.where(some, high - low, 0))
    has1, has2 = (i >= 0) & (i < n1[row]), (i >= shift[row]) & (i - shift[row] < n2[row])
    row, i, has1, has2 = (x[has1 | has2] for x in (row, i, has1, has2))
    at1, at2 = np.where(has1, one.begin[row] + i, 0), np.where(has2, two.end[row] - 1 - (i - shift[row]), 0)
    pick = lambda data, at, ok: np.where(ok, data[at], 0) if len(data) else np.zeros(len(at), np.uint8)
    raw, qa, qb = pick(one.s, at1, has1), pick(one.q, at1, has1), pick(two.q, at2, has2)
    x, y = B.NORMAL[raw], B.COMPLEMENT[pick(two.s, at2, has2)]
    both = has1 & has2
    base = np.where(both, np.where((x == y) | (qa > qb), x, np.where(qb > qa, y, 78)), np.where(has1, raw, y))
    quality = np.maximum(qa, qb)
    at = B.places(np.bincount(row, minlength=len(found)))
    null = pa.array(some)
    return tuple(pc.if_else(null, B.texts(v.astype(np.uint8), at), pa.scalar(None, pa.string())) for v in (base, quality))


def _one(sequence: bytes, quality: bytes) -> B.Reads:
    return B.Reads(pa.array([sequence], pa.binary()), pa.array([quality], pa.binary()))


def find_overlaps(first: list[bytes], second: list[bytes], min_overlap: int, most: int, percent: int) -> np.ndarray:
    one, two = (B.Reads(pa.array(x, pa.binary()), pa.array(x, pa.binary())) for x in (first, second))
    return overlaps(one, two, np.arange(len(first)), TrimConfig(min_overlap=min_overlap, most_mismatches=most, mismatch_percent=percent))


def correct_pair(s1: bytes, q1: bytes, s2: bytes, q2: bytes, start1: int, start2: int, length: int) -> tuple[bytes, bytes, bytes, bytes, int, int]:
    one, two = _one(s1, q1), _one(s2, q2)
    a, b = correct(one, two, np.array([[start1, start2, length, 0]]))
    return one.s.tobytes(), one.q.tobytes(), two.s.tobytes(), two.q.tobytes(), int(a[0]), int(b[0])


def merge_pair(s1: bytes, q1: bytes, s2: bytes, q2: bytes, start1: int, start2: int, length: int) -> tuple[bytes, bytes]:
    s, q = merge(_one(s1, q1), _one(s2, q2), np.array([[start1, start2, length, 0]]))
    return s[0].as_py().encode(), q[0].as_py().encode()


def _overlap_column(found: np.ndarray) -> pa.Array:
    fields = [pa.array(found[:, k].astype(np.int32)) for k in range(4)]
    return pa.StructArray.from_arrays(fields, fields=list(_OVERLAP), mask=pa.array(found[:, 0] < 0))


def _found(column: pa.Array) -> np.ndarray:
    """The inverse of ``_overlap_column``."""
    out = np.stack([pc.fill_null(pc.struct_field(column, n), -1).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("start1", "start2", "length", "mismatches")], axis=1) if len(column) else np.empty((0, 4), np.int64)
    out[out[:, 0] < 0, 2] = 0
    return out


def _map_pairs(pairs: DataFrame, own: dict[str, str], step) -> DataFrame:
    """``pairs`` with the columns ``own`` (name: type) that ``step`` makes of a piece of a batch and its mates."""
    kinds = {**dict(pairs.dtypes), **own}
    order = [*pairs.columns, *[c for c in own if c not in pairs.columns]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in B.pieces(batches, "sequence1"):
            made = step(part, *(B.Reads(part.column(f"sequence{k}"), part.column(f"quality{k}")) for k in (1, 2)))
            yield pa.RecordBatch.from_arrays([made[n] if n in own else part.column(n) for n in order], order)

    return pairs.mapInArrow(run, ", ".join(f"`{n}` {kinds[n]}" for n in order))


def with_overlap(pairs: DataFrame, c: TrimConfig, name: str = "overlap") -> DataFrame:
    """Adds the struct ``name``, null where the mates don't overlap."""
    return _map_pairs(pairs, {name: OVERLAP}, lambda part, one, two: {name: _overlap_column(overlaps(one, two, np.arange(part.num_rows), c))})


def correct_overlaps(pairs: DataFrame, overlap: str = "overlap") -> DataFrame:
    """Replaces sequences and qualities; adds corrected1 and corrected2."""

    def step(part: pa.RecordBatch, one: B.Reads, two: B.Reads) -> dict[str, pa.Array]:
        a, b = correct(one, two, _found(part.column(overlap)))
        texts = {f"{n}{k}": B.texts(data, np.append(r.begin, r.end[-1:]) if len(r.begin) else np.zeros(1, np.int64)) for k, r in ((1, one), (2, two)) for n, data in (("sequence", r.s), ("quality", r.q))}
        return texts | {"corrected1": pa.array(a), "corrected2": pa.array(b)}

    return _map_pairs(pairs, {**{f"{n}{k}": "string" for k in (1, 2) for n in ("sequence", "quality")}, "corrected1": "long", "corrected2": "long"}, step)


def merge_overlaps(pairs: DataFrame, overlap: str = "overlap") -> DataFrame:
    """record_number, header, sequence, separator, quality of the pairs that overlap."""

    def step(part: pa.RecordBatch, one: B.Reads, two: B.Reads) -> dict[str, pa.Array]:
        return dict(zip(("sequence", "quality"), merge(one, two, _found(part.column(overlap))), strict=True))

    own = _map_pairs(pairs.where(F.col(overlap).isNotNull()), {"sequence": "string", "quality": "string"}, step)
    return own.select("record_number", F.concat(F.lit("@"), E.merged_id(F.col("header1")), F.lit(" merged")).alias("header"), "sequence", F.lit("+").alias("separator"), "quality")


def trim_pairs(pairs: DataFrame, c: TrimConfig) -> DataFrame:
    """All pairs with the flags of both mates, ``passed`` (both pass), ``overlap`` and ``merged`` (structs or null).

    A UMI is taken from the first mate only. If that fails, the first mate stays as it is and neither is searched for
    adapters. Mates are compared only for correction or merging, and read-through is trimmed only then.
    """
    own = {**{f"{n}{k}": kind for k in (1, 2) for n, kind in {**dict.fromkeys(_MATE, "string"), **FLAGS}.items()}, "overlap": OVERLAP, "passed": "boolean", "merged": "struct<sequence:string,quality:string>"}
    adapters = [a.upper().encode() for a in c.adapters]

    def step(part: pa.RecordBatch, one: B.Reads, two: B.Reads) -> dict[str, pa.Array]:
        if c.umi_length:
            one.umi(c.umi_length)
        one.quality_steps(c)
        two.quality_steps(c)
        ready = one.open
        found = np.full((part.num_rows, 4), -1, np.int64)
        if c.correction or c.merge:
            found = overlaps(one, two, np.flatnonzero(ready), c)
        if c.correction:
            one.corrected, two.corrected = correct(one, two, found)
        if c.adapter_trimming:
            through = ready & (found[:, 0] == 0) & (found[:, 1] > 0)
            for r in (one, two):
                r.cut_at(np.where(through, found[:, 2], r.adapters(adapters, c.min_match, ready & ~through)))
        one.last_steps(c)
        two.last_steps(c)
        passed = one.open & two.open
        made = {f"{n}{k}": x for k, r in ((1, one), (2, two)) for n, x in r.columns(part.column(f"header{k}")).items()}
        merged = pa.nulls(part.num_rows, pa.struct([("sequence", pa.string()), ("quality", pa.string())]))
        if c.merge:
            again = overlaps(one, two, np.flatnonzero(passed), c)
            merged = pa.StructArray.from_arrays(merge(one, two, again), ["sequence", "quality"], mask=pa.array(again[:, 0] < 0))
        return made | {"overlap": _overlap_column(found), "passed": pa.array(passed), "merged": merged}

    return _map_pairs(pairs, own, step)


def mates(trimmed: DataFrame) -> DataFrame:
    """Both mates as reads: read R1 or R2, record_number, header, sequence, quality, flags, passed, pair_passed."""
    flags = [*_MATE, *FLAGS]
    sides = [F.struct(F.lit(f"R{k}").alias("read"), *[F.col(f"{c}{k}").alias(c) for c in flags]) for k in (1, 2)]
    return trimmed.select("record_number", F.col("passed").alias("pair_passed"), F.explode(F.array(*sides)).alias("x")).select("record_number", "pair_passed", "x.*")


def pair_statistics(trimmed: DataFrame) -> DataFrame:
    """The counters of both mates together, and of pairs, in one pass."""
    n = lambda x: F.coalesce(F.sum(x.cast("long")), F.lit(0).cast("long"))
    single = [reduce(add, each).alias(name) for name, *each in ((a, b, c) for (a, b), (_, c) in zip(T.counters("1"), T.counters("2"), strict=True))]
    return trimmed.agg(
        *single, F.count("*").alias("total_pairs"), n(F.col("passed")).alias("passed_pairs"), n(~F.col("passed")).alias("discarded_pairs"), (2 * n(F.col("passed"))).alias("output_reads"),
        (n(F.col("passed1") & ~F.col("passed")) + n(F.col("passed2") & ~F.col("passed"))).alias("mate_discarded_reads"), n(F.col("merged").isNotNull()).alias("merged_pairs"),
    )
