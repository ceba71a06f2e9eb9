"""The built-in adapters."""

from __future__ import annotations

# Names, sequences and their order.
STANDARD = (
    ("TruSeq_R1", "AGATCGGAAGAGCACACGTCTGAACTCCAGTCA"),
    ("SmallRNA3'", "TGGAATTCTCGGGTGCCAAGG"),
    ("SmallRNA5'", "GATCGTCGGACTGTAGAACTCTGAAC"),
    ("Nextera", "CTGTCTCTTATACACATCT"),
    ("PolyA", "AAAAAAAAAAAA"),
    ("PolyG", "GGGGGGGGGGGG"),
    ("TruSeq_R2", "AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGT"),
)
#: The adapter of the other mate, which a direction doesn't look for.
OTHER_MATE = {"R1": "TruSeq_R2", "R2": "TruSeq_R1"}


def for_read(read: str, adapters=STANDARD) -> list[tuple[str, str]]:
    return [(name, seq) for name, seq in adapters if name != OTHER_MATE.get(read)]
