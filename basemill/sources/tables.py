"""Small text inputs, parsed on the driver: adapters, sample sheets, rulesets."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession

from ..operators.rules import Ruleset

SHEET_COLUMNS = ("patient_id", "sample_id", "sample_role", "material", "r1", "r2", "platform", "library_type", "reference")


def read_adapters(path: str) -> list[tuple[str, str]]:
    """(name, sequence) in the order of the file; blank lines and lines with # are skipped."""
    found = []
    with open(path, encoding="utf-8") as lines:
        for n, line in enumerate(lines, 1):
            line = line.strip()
            if not line or line.startswith("#"):
                continue
            name, tab, sequence = (x.strip() for x in line.partition("\t"))
            if not tab and "\t" not in line:
                raise ValueError(f"line {n}: a tab is missing")
            if not name or not sequence:
                raise ValueError(f"line {n}: name and sequence are required")
            if set(sequence.upper()) - set("ACGTN"):
                raise ValueError(f"line {n}: not a sequence of A, C, G, T, N: {sequence}")
            found.append((name, sequence))
    if not found:
        raise ValueError("the list of adapters is empty")
    return found


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """The nine columns and the line number; cells are split at commas without quoting. Files become real paths."""
    with open(path, encoding="utf-8") as text:
        lines = text.read().splitlines()
    if not lines:
        raise ValueError("the sample sheet is empty")
    header = [x.strip() for x in lines[0].split(",")]
    if tuple(header) != SHEET_COLUMNS:
        raise ValueError(f"the header must be {', '.join(SHEET_COLUMNS)}")
    rows = []
    for n, line in enumerate(lines[1:], 2):
        if not line.strip():
            continue
        cells = [x.strip() for x in line.split(",")]
        if len(cells) != len(SHEET_COLUMNS):
            raise ValueError(f"line {n}: expected {len(SHEET_COLUMNS)} values")
        for k in (4, 5):
            cells[k] = os.path.realpath(cells[k]) if cells[k] else ""
        rows.append((*cells, n))
    if not rows:
        raise ValueError("the sample sheet has no samples")
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in SHEET_COLUMNS) + ", line long")


def read_ruleset(path: str) -> tuple[Ruleset, str]:
    """The ruleset and the SHA-256 of its file."""
    with open(path, "rb") as data:
        raw = data.read()
    return Ruleset.from_json(raw.decode()), hashlib.sha256(raw).hexdigest()
