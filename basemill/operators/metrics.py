"""Distributions over reads. Every function takes reads (KEYS, sequence, quality), or the ``profile`` of reads, and returns
one small DataFrame, keyed by KEYS, so that both mates and both stages are one query. Reads of length 0 are left out.

All counts but those of whole sequences come from one Arrow pass: each batch is counted with numpy on its flat bytes, what
leaves a partition are partial counts (kind, a, b, n), and these are summed. A metric alone asks for its kind; several
share a written ``profile``, so the reads are scanned once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import adapters as A
from ..functions import expressions as E
from ..sources.shared import written
from . import batch as B

KEYS = ("read",)
#: What a profile counts, by (a, b): quality (position, value), base (position, class), gc (length, count), mean (rounded,
#: truncated mean quality), hit (adapter * 2^31 + first hit, length), any (1 if an adapter was hit, 0).
KINDS = ("quality", "base", "gc", "mean", "hit", "any")
_BASE = np.full(256, 5, np.int64)
for _i, _b in enumerate("ACGTN"):
    _BASE[[ord(_b), ord(_b.lower())]] = _i
_SHIFT = 31
#: Distinct counts that a partition holds before it passes them on.
HELD = 2_000_000


def nonempty(reads: DataFrame) -> DataFrame:
    return reads.where(F.length("sequence") > 0)


def first_hits(read: Column, sequence: Column, adapters=A.STANDARD) -> Column:
    """array<struct<adapter, hit>> of the adapters whose first 12 bases occur in the read exactly; hit is 1-based."""
    found = [F.struct(F.lit(name).alias("adapter"), F.when((read != F.lit({v: k for k, v in A.OTHER_MATE.items()}.get(name, ""))), F.instr(sequence, F.lit(seq[: E.KMER]))).otherwise(0).alias("hit")) for name, seq in adapters]
    return F.filter(F.array(*found), lambda x: x["hit"] > 0)


def _tally(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct codes, their counts); by counters where the codes are dense."""
    if not len(codes):
        return codes, codes
    top = int(codes.max())
    if top < 4 * len(codes) + 65536:
        n = np.bincount(codes)
        some = np.flatnonzero(n)
        return some, n[some]
    return np.unique(codes, return_counts=True)


def _pack(codes: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    return (codes // width << _SHIFT) | codes % width, n


def _count(kind: str, part: pa.RecordBatch, adapters: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(a << 31 | b, count) of one kind over the reads of a piece; none of them is empty."""
    column = part.column("quality" if kind in ("quality", "mean") else "sequence")
    if kind in ("hit", "any"):
        length = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        codes, hit_any = [], np.zeros(len(length), np.int64)
        for k, kmer in enumerate(adapters):
            at = pc.find_substring(column, kmer).to_numpy(zero_copy_only=False).astype(np.int64) if kmer else np.full(len(length), -1)
            some = at >= 0
            hit_any |= some
            codes.append(((k << _SHIFT | at[some] + 1), length[some]))
        if kind == "any":
            return _tally(hit_any)
        pairs, n = np.unique(np.stack([np.concatenate([x for x, _ in codes]), np.concatenate([x for _, x in codes])]), axis=1, return_counts=True)
        return pairs, n
    data, at = B.flat(column)
    length = np.diff(at)
    if kind in ("quality", "base"):
        position = np.arange(1, len(data) + 1) - np.repeat(at[:-1], length)
        if kind == "quality":
            return _pack(*_tally(position * 128 + data - 33), 128)
        return _pack(*_tally(position * 8 + _BASE[data]), 8)
    if kind == "gc":
        gc = np.add.reduceat((_BASE[data] == 1) | (_BASE[data] == 2), at[:-1], dtype=np.int64)
        return np.unique(length << _SHIFT | gc, return_counts=True)
    total = np.add.reduceat(data.astype(np.int64) - 33, at[:-1])
    return _pack(*_tally(np.floor(total / length + 0.5).astype(np.int64) * 128 + total // length), 128)


def counts(reads: DataFrame, kinds: tuple[str, ...], keys=KEYS) -> DataFrame:
    """(KEYS, kind, a, b, n): summed partial counts. For kind hit, ``a`` holds adapter and position."""
    needed = [c for c in ("quality", "sequence") if any((k in ("quality", "mean")) == (c == "quality") for k in kinds)]
    types = dict(reads.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", kind string, a long, b long, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for (kind, *values), found in held.items():
                codes, n = (np.concatenate([x[i] for x in found], axis=-1) for i in (0, 1))
                codes, inverse = np.unique(codes, axis=-1, return_inverse=True)
                n = np.bincount(inverse.ravel(), weights=n).astype(np.int64)
                a, b = codes if codes.ndim == 2 else (codes >> _SHIFT, codes & ((1 << _SHIFT) - 1))
                same = [pa.array([v] * len(n), part.schema.field(k).type) for k, v in zip(keys, values, strict=True)]
                yield pa.RecordBatch.from_arrays([*same, pa.array([kind] * len(n), pa.string()), pa.array(a), pa.array(b), pa.array(n)], [*keys, "kind", "a", "b", "n"])
            held.clear()

        for part in B.pieces(batches, needed[0]):
            for values in zip(*(pc.unique(part.column(k)).to_pylist() for k in keys), strict=True) if len(keys) == 1 else pa.table([part.column(k) for k in keys], list(keys)).group_by(list(keys)).aggregate([]).to_pylist():
                values = tuple(values) if len(keys) == 1 else tuple(values[k] for k in keys)
                own = part
                for k, v in zip(keys, values, strict=True):
                    own = own.filter(pc.equal(own.column(k), v) if v is not None else pc.is_null(own.column(k)))
                other = dict(zip(keys, values, strict=True)).get("read")
                kmers = ["" if name == A.OTHER_MATE.get(other) else seq[: E.KMER] for name, seq in A.STANDARD]
                for kind in kinds:
                    found = _count(kind, own, kmers)
                    if len(found[1]):
                        held.setdefault((kind, *values), []).append(found)
                        size += len(found[1])
            if size > HELD:
                yield from rows()
                size = 0
        if held:
            yield from rows()

    partial = nonempty(reads).select(*keys, *needed).mapInArrow(run, schema)
    return partial.groupBy(*keys, "kind", "a", "b").agg(F.sum("n").alias("n"))


def profile(reads: DataFrame, keys=KEYS) -> DataFrame:
    """The counts of all KINDS, written to the shared folder; its size depends on lengths and not on the number of reads."""
    return written(counts(reads, KINDS, keys).coalesce(1), "profile")


def _of(source: DataFrame, keys, *kinds: str) -> DataFrame:
    if "kind" in source.columns:
        return source.where(F.col("kind").isin(list(kinds)))
    return counts(source, kinds, keys)


def basic_statistics(reads: DataFrame, keys=KEYS) -> DataFrame:
    """Counts and headline percents; percents are of all bases, N included."""
    kind, a, b, n = (F.col(x) for x in ("kind", "a", "b", "n"))
    when = lambda test, x=n: F.coalesce(F.sum(F.when(test, x)), F.lit(0)).cast("long")
    total = _of(reads, keys, "quality", "base", "gc", "any").groupBy(*keys).agg(
        when(kind == "gc").alias("reads"), when(kind == "base").alias("bases"), F.min(F.when(kind == "gc", a)).alias("min_length"), F.max(F.when(kind == "gc", a)).alias("max_length"),
        *[when((kind == "base") & (b == i)).alias(f"n_{x}") for i, x in enumerate("acgtn")], when((kind == "quality") & (b >= 20)).alias("q20"), when((kind == "quality") & (b >= 30)).alias("q30"),
        when((kind == "any") & (b == 1)).alias("adapter_reads"),
    )
    percent = lambda x, of="bases": F.round(100.0 * x / F.col(of), 6)
    return total.select(
        *keys, "reads", "bases", "min_length", "max_length", F.round(F.col("bases") / F.col("reads"), 6).alias("avg_length"), *[f"n_{b}" for b in "acgtn"],
        percent(F.col("n_g") + F.col("n_c")).alias("gc_percent"), percent(F.col("n_n")).alias("n_percent"), percent(F.col("q20")).alias("q20_percent"),
        percent(F.col("q30")).alias("q30_percent"), "adapter_reads", percent(F.col("adapter_reads"), "reads").alias("adapter_percent"),
    )


def length_distribution(reads: DataFrame, keys=KEYS) -> DataFrame:
    """Alone, the lengths are one JVM aggregate."""
    if "kind" in reads.columns:
        return _of(reads, keys, "gc").groupBy(*keys, F.col("a").cast("int").alias("length")).agg(F.sum("n").alias("reads"))
    return nonempty(reads).groupBy(*keys, F.length("sequence").alias("length")).agg(F.count("*").alias("reads"))


def base_content(reads: DataFrame, keys=KEYS) -> DataFrame:
    """Per position: counts, coverage, A/C/G/T as percent of the canonical calls, N of all calls and of covering reads."""
    by_base = [F.coalesce(F.sum(F.when(F.col("b") == i, F.col("n"))), F.lit(0).cast("long")).alias(f"n_{b}") for i, b in enumerate("acgtn")]
    counted = _of(reads, keys, "base").groupBy(*keys, F.col("a").cast("int").alias("position")).agg(*by_base, F.sum("n").alias("coverage"))
    canonical = reduce(lambda a, b: a + b, [F.col(f"n_{b}") for b in "acgt"])
    share = lambda x, of: F.when(of > 0, F.round(100.0 * x / of, 6)).otherwise(0.0)
    return counted.select("*", *[share(F.col(f"n_{b}"), canonical).alias(f"{b}_percent") for b in "acgt"], share(F.col("n_n"), F.col("coverage")).alias("n_percent"))


def quality_histogram(reads: DataFrame, keys=KEYS) -> DataFrame:
    """(position, q) counts, from which the tables by position come."""
    return _of(reads, keys, "quality").select(*keys, F.col("a").cast("int").alias("position"), F.col("b").cast("int").alias("q"), "n")


def quality_by_position(histogram: DataFrame, keys=KEYS, least: int = 100) -> DataFrame:
    """Mean, and lower quartile and median where more than ``least`` reads cover the position."""
    upto = F.sum("n").over(Window.partitionBy(*keys, "position").orderBy("q"))
    total = F.sum("n").over(Window.partitionBy(*keys, "position"))
    ranked = histogram.withColumn("upto", upto).withColumn("total", total)
    at = lambda p: F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("total") * F.lit(p))), F.col("q")))
    out = ranked.groupBy(*keys, "position").agg(F.max("total").alias("n"), (F.sum(F.col("q") * F.col("n")) / F.sum("n")).alias("mean"), at(0.25).alias("q1"), at(0.5).alias("median"))
    seen = F.col("n") > least
    return out.select(*keys, "position", "n", F.round("mean", 6).alias("mean_quality"), F.when(seen, F.col("q1")).alias("lower_quartile"), F.when(seen, F.col("median")).alias("median"))


def quality_by_group(by_position: DataFrame, keys=KEYS) -> DataFrame:
    """Unweighted means of the tables by position over the groups of positions, which follow from the longest position."""
    longest = F.max("position").over(Window.partitionBy(F.lit(0)))  # over the small table by position
    grouped = by_position.withColumn("longest", longest).withColumn("width", E.group_width(F.col("longest")))
    grouped = grouped.withColumn("g", E.base_group(F.col("position"), F.col("longest"), F.col("width")))
    return grouped.groupBy(*keys, "g.first", "g.last").agg(*[F.round(F.avg(c), 4).alias(c) for c in ("mean_quality", "lower_quartile", "median")])


def read_quality(reads: DataFrame, keys=KEYS) -> DataFrame:
    """Reads by mean quality, rounded and truncated; dense from 0 to the largest."""
    both = _of(reads, keys, "mean").select(*keys, "n", F.explode(F.array(
        F.struct(F.col("a").cast("int").alias("mean_quality"), F.lit(1).alias("rounded")), F.struct(F.col("b").cast("int").alias("mean_quality"), F.lit(0).alias("rounded")),
    )).alias("x"))
    counted = both.groupBy(*keys, "x.mean_quality").agg(*[F.coalesce(F.sum(F.when(F.col("x.rounded") == r, F.col("n"))), F.lit(0).cast("long")).alias(name) for r, name in ((1, "read_count"), (0, "read_count_truncate"))])
    found = F.map_from_entries(F.collect_list(F.struct("mean_quality", F.struct("read_count", "read_count_truncate"))))  # 94 values at most
    dense = counted.groupBy(*keys).agg(found.alias("m"), F.max("mean_quality").alias("top")).select(*keys, "m", F.explode(F.sequence(F.lit(0), F.col("top"))).alias("mean_quality"))
    return dense.select(*keys, "mean_quality", *[F.coalesce(F.element_at("m", F.col("mean_quality"))[c], F.lit(0).cast("long")).alias(c) for c in ("read_count", "read_count_truncate")])


def gc_counts(reads: DataFrame, keys=KEYS) -> DataFrame:
    """(length, gc) counts, from which both GC distributions come."""
    return _of(reads, keys, "gc").select(*keys, F.col("a").cast("int").alias("length"), F.col("b").alias("gc"), "n")


def gc_weights(lengths: DataFrame) -> DataFrame:
    """(length, gc, bin, weight) of the length-aware model: a bin is shared evenly by the GC counts that claim it."""
    edge = lambda x: F.floor(x * F.lit(100.0) / F.col("length") + 0.5).cast("int")
    claims = lengths.select("length").distinct().select("length", F.explode(F.sequence(F.lit(0), F.col("length"))).alias("gc")).select(
        "length", F.col("gc").cast("long").alias("gc"),
        F.explode(F.sequence(edge(F.greatest(F.lit(0.0), F.col("gc") - F.lit(0.5))), edge(F.least(F.col("length").cast("double"), F.col("gc") + F.lit(0.5))))).alias("bin"),
    )
    return claims.withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy("length", "bin")))


def gc_distribution(reads: DataFrame, keys=KEYS) -> DataFrame:
    """Bins 0 to 100: reads by rounded GC percent, and the fractional, length-aware counts. One use of the counts."""
    edge = lambda x: F.floor(x * F.lit(100.0) / F.col("length") + 0.5).cast("int")
    low, high = edge(F.greatest(F.lit(0.0), F.col("gc") - F.lit(0.5))), edge(F.least(F.col("length").cast("double"), F.col("gc") + F.lit(0.5)))
    counted = gc_counts(reads, keys).select(*keys, "n", E.gc_bin(F.col("gc"), F.col("length")).alias("raw"), F.explode(F.sequence(low, high)).alias("bin"), "length")
    shares = counted.groupBy(*keys, "length", "bin").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("raw") == F.col("bin"), F.col("n"))).alias("reads"))
    shares = shares.select(*keys, F.col("bin"), "reads", (F.col("n") / E.gc_claims(F.col("length"), F.col("bin"))).alias("observed"))
    every = F.explode(F.sequence(F.lit(0), F.lit(100)))
    binned = shares.groupBy(*keys, "bin").agg(F.sum("reads").alias("reads"), F.sum("observed").alias("observed"))
    found = F.map_from_entries(F.collect_list(F.struct("bin", F.struct("reads", "observed"))))  # 101 bins
    dense = binned.groupBy(*keys).agg(found.alias("m")).select(*keys, "m", every.alias("bin"))
    at = F.element_at("m", F.col("bin"))
    return dense.select(*keys, "bin", F.coalesce(at["reads"], F.lit(0).cast("long")).alias("reads"), F.round(F.coalesce(at["observed"], F.lit(0.0)), 6).alias("observed"))


def gc_deviation(distribution: DataFrame, keys=KEYS) -> DataFrame:
    """Sum of differences from the normal curve about the mode's plateau, in percent of the reads.

    The plateau are the bins next to the first mode that are above 0.9 of it, without a gap; if it reaches an end the
    centre is the mode itself. 101 rows a key, so windows by key hold next to nothing.
    """
    w = Window.partitionBy(*keys)
    x = distribution.withColumn("total", F.sum("observed").over(w)).withColumn("top", F.max("observed").over(w))
    x = x.withColumn("mode", F.min(F.when(F.col("observed") == F.col("top"), F.col("bin"))).over(w)).withColumn("high", F.col("observed") > 0.9 * F.col("top"))
    x = x.withColumn("right", F.min(F.when((F.col("bin") > F.col("mode")) & ~F.col("high"), F.col("bin"))).over(w)).withColumn("left", F.max(F.when((F.col("bin") < F.col("mode")) & ~F.col("high"), F.col("bin"))).over(w))
    x = x.withColumn("centre", F.when(F.col("left").isNull() | F.col("right").isNull(), F.col("mode").cast("double")).otherwise((F.col("left") + F.col("right")) / 2.0))
    x = x.withColumn("variance", F.sum(F.col("observed") * F.pow(F.col("bin") - F.col("centre"), F.lit(2.0))).over(w) / F.greatest(F.col("total") - 1, F.lit(1e-300)))
    scale = F.col("total") / F.sqrt(2 * F.lit(math.pi) * F.col("variance"))
    density = scale * F.exp(-F.pow(F.col("bin") - F.col("centre"), F.lit(2.0)) / (2 * F.col("variance")))
    x = x.withColumn("curve", F.when(F.col("variance") > 0, density).otherwise(F.when(F.col("bin") == F.bround("centre"), F.col("total")).otherwise(0.0)))
    return x.where("total > 1").groupBy(*keys).agg(F.round(F.sum(F.abs(F.col("curve") - F.col("observed"))) * 100 / F.max("total"), 6).alias("deviation_percent"))


def adapter_content(reads: DataFrame, keys=KEYS) -> DataFrame:
    """Percent of all reads whose first hit of the adapter is at or before the position and that reach the position."""
    source = _of(reads, keys, "hit", "gc")
    which = F.shiftright("a", _SHIFT).cast("int")
    begin = F.struct(which.alias("ord"), (F.col("a").bitwiseAND((1 << _SHIFT) - 1)).alias("position"), F.col("n").alias("d"))
    end = F.struct(which.alias("ord"), (F.col("b") + 1).alias("position"), (-F.col("n")).alias("d"))
    of_length = F.struct(F.lit(-1).alias("ord"), F.col("a").alias("position"), F.col("n").alias("d"))
    events = source.select(*keys, F.explode(F.when(F.col("kind") == "hit", F.array(begin, end)).otherwise(F.array(of_length))).alias("e")).groupBy(*keys, "e.ord", "e.position").agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(*keys)
    told = events.withColumn("total", F.sum(F.when(F.col("ord") < 0, F.col("d"))).over(w)).withColumn("longest", F.max(F.when(F.col("ord") < 0, F.col("position"))).over(w))
    other = lambda r: F.array(*[F.lit(A.OTHER_MATE.get(r) == n) for n, _ in A.STANDARD])
    absent = lambda i: F.when(F.col("read") == "R1", F.element_at(other("R1"), i + 1)).when(F.col("read") == "R2", F.element_at(other("R2"), i + 1)).otherwise(False)
    every = F.filter(F.sequence(F.lit(0), F.lit(len(A.STANDARD) - 1)), lambda i: ~absent(i))
    grid = told.where("ord < 0 and position = longest").select(*keys, "total", F.explode(every).alias("ord"), "longest").select(*keys, "total", "ord", F.explode(F.sequence(F.lit(1).cast("long"), F.col("longest"))).alias("position"), F.lit(0).cast("long").alias("d"))
    steps = grid.unionByName(told.where("ord >= 0 and position <= longest").select(*keys, "total", "ord", "position", "d")).groupBy(*keys, "total", "ord", "position").agg(F.sum("d").alias("d"))
    running = Window.partitionBy(*keys, "ord").orderBy("position")
    names = F.array(*[F.lit(n) for n, _ in A.STANDARD])
    return steps.select(*keys, F.element_at(names, F.col("ord") + 1).alias("adapter"), F.col("position").cast("int").alias("position"), F.round(100.0 * F.sum("d").over(running) / F.col("total"), 6).alias("percent"))


def duplication_counts(reads: DataFrame, keys=KEYS) -> DataFrame:
    """Exact counts of the keys of 50 bases: the one wide shuffle; counts are summed before it."""
    return nonempty(reads).groupBy(*keys, E.duplication_key(F.col("sequence")).alias("key50")).agg(F.count("*").alias("n"))


def duplication_levels(counts: DataFrame, keys=KEYS) -> DataFrame:
    """16 levels: percent of all reads and of distinct keys."""
    by_count = counts.groupBy(*keys, "n").agg(F.count("*").alias("k"))
    by_bin = by_count.groupBy(*keys, E.duplication_bin(F.col("n")).alias("i")).agg(F.sum(F.col("n") * F.col("k")).alias("reads"), F.sum("k").alias("distinct"))
    total = by_count.groupBy(*keys).agg(F.sum(F.col("n") * F.col("k")).alias("all_reads"), F.sum("k").alias("all_distinct"))
    labels = F.posexplode(F.array(*[F.lit(x) for x in E.DUPLICATION_LABELS])).alias("i", "duplication_level")
    share = lambda a, b: F.round(F.coalesce(100.0 * F.col(a) / F.col(b), F.lit(0.0)), 6)
    return total.select("*", labels).join(by_bin, [*keys, "i"], "left").select(*keys, F.col("i").alias("level_index"), "duplication_level", share("reads", "all_reads").alias("total_percent"), share("distinct", "all_distinct").alias("deduplicated_percent"))


def duplication_summary(counts: DataFrame, keys=KEYS) -> DataFrame:
    return counts.groupBy(*keys).agg(F.sum("n").alias("total_reads"), F.count("*").alias("unique_sequences")).withColumn("deduplicated_remaining_percent", F.round(100.0 * F.col("unique_sequences") / F.col("total_reads"), 6))


def overrepresented(counts: DataFrame, keys=KEYS, least_percent: float = 0.1) -> DataFrame:
    """Keys of 0.1 percent of the reads or more. The totals are one row a key."""
    total = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    percent = F.lit(100.0) * F.col("n") / F.col("total")
    return counts.join(F.broadcast(total), list(keys)).where(percent >= least_percent).select(*keys, F.col("key50").alias("sequence"), F.col("n").alias("reads"), F.round(percent, 6).alias("percent"))
