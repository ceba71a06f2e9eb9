"""Scalar functions on reads, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_LENGTH = 50
KMER = 12


def qualities(quality: Column) -> Column:
    """Phred values of a quality string."""
    return F.transform(F.split(quality, ""), lambda c: F.ascii(c) - 33)


def count_of(text: Column, characters: str) -> Column:
    """How many of the characters a string holds."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def reverse_complement(sequence: Column) -> Column:
    """Anything but A, C, G, T (either case) becomes N."""
    return F.reverse(F.translate(F.regexp_replace(F.upper(sequence), "[^ACGT]", "N"), "ACGT", "TGCA"))


def pair_id(header: Column) -> Column:
    """Id that mates share: up to the first blank, without the leading @ and a trailing /1 or /2."""
    return F.regexp_replace(F.substring_index(F.regexp_replace(header, "^@", ""), " ", 1), "/[12]$", "")


def merged_id(header: Column) -> Column:
    """Id of a merged pair: up to the first blank or tab, then as ``pair_id``."""
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(header, "^[^ \t]*", 0), "^@", ""), "/[12]$", "")


def gc_bin(gc: Column, length: Column) -> Column:
    """GC percent of a read, rounded half up; N counts in the length."""
    return F.round(gc * F.lit(100.0) / length).cast("int")


def duplication_key(sequence: Column) -> Column:
    """The first 50 bases in upper case; a shorter read is its own key."""
    return F.upper(F.substring(sequence, 1, KEY_LENGTH))


def duplication_bin(level: Column) -> Column:
    """Index of the duplication level: 1 to 9 alone, then by bounds of which the lower counts."""
    bounds = (10, 51, 101, 501, 1001, 5001, 10001)  # >10 holds 10 itself
    out = (level - 1).cast("int")
    for i, low in enumerate(bounds):
        out = F.when(level >= low, F.lit(9 + i)).otherwise(out)
    return out


# The labels of the duplication levels, in order.
DUPLICATION_LABELS = ("1", "2", "3", "4", "5", "6", "7", "8", "9", ">10", ">50", ">100", ">500", ">1k", ">5k", ">10k+")


def base_groups(length: int) -> list[tuple[int, int]]:
    """Groups of positions (first, last) for reads up to ``length``: fewer than 75 where there are more positions than that."""
    if length <= 75:
        return [(p, p) for p in range(1, length + 1)]
    width = next(w * 10**e for e in range(12) for w in (2, 5, 10) if 9 + math.ceil((length - 9) / (w * 10**e)) < 75)
    groups = [(p, p) for p in range(1, 10)]
    start = 10
    while start <= length:
        end = width - 1 if start == 10 and width > 10 else start + width - 1
        groups.append((start, min(end, length)))
        start = end + 1
    return groups


def group_width(longest: Column) -> Column:
    """Width of the groups of positions for reads up to ``longest``: the first of 2, 5, 10, 20, ... with fewer than 75 groups."""
    widths = F.array(*[F.lit(w * 10**e) for e in range(8) for w in (2, 5, 10)])
    return F.element_at(F.filter(widths, lambda w: 9 + F.ceil((longest - 9) / w.cast("double")) < 75), 1)


def base_group(position: Column, longest: Column, width: Column) -> Column:
    """struct<first, last> of the group that a position is in (see ``base_groups``)."""
    single = (longest <= 75) | (position < 10)
    at = F.when(width > 10, F.greatest(F.lit(10), position - position % width)).otherwise(position - (position - 10) % width)
    end = F.when(width > 10, position - position % width).otherwise(at) + width - 1
    return F.struct(F.when(single, position).otherwise(at).cast("int").alias("first"), F.when(single, position).otherwise(F.least(end, longest)).cast("int").alias("last"))


def gc_claims(length: Column, percent: Column) -> Column:
    """How many GC counts of reads of a length stand for a percent: half a base about a count reaches it.

    A count g claims the percents from round(max(g - 0.5, 0) * 100 / length) to round(min(g + 0.5, length) * 100 / length);
    the few counts about percent * length / 100 are tried.
    """
    half_up = lambda x: F.floor(x + 0.5)
    wide = length.cast("double")
    low = F.greatest(F.lit(0).cast("bigint"), F.floor((percent - 1) * wide / 100.0 - 1.5).cast("bigint"))
    high = F.least(length.cast("bigint"), F.ceil((percent + 1) * wide / 100.0 + 1.5).cast("bigint"))
    reaches = lambda g: (half_up(F.greatest(F.lit(0.0), g - F.lit(0.5)) * 100.0 / wide) <= percent) & (half_up(F.least(wide, g + F.lit(0.5)) * 100.0 / wide) >= percent)
    return F.size(F.filter(F.sequence(low, high), reaches))
