"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import math
import sys
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

#: A word: a run of code points other than the ASCII white space. Java, RE2 and Python read it alike.
WORD = r"[^\x20\x09-\x0D]+"
#: The same white space as characters, for trim().
ASCII_SPACE = " \t\n\x0b\x0c\r"


__all__ = ["ASCII_SPACE", "WORD", "Scratch", "beta_share", "binomial_at_least", "binomial_at_most", "bounded", "fresh", "give_back", "held_out", "near", "read_table", "shared_dir", "slices", "utf8"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables that an operator writes on its way, as Parquet in the shared folder: they cut the lineage and survive lost
    executors. When the operator is done those of ``table`` go; those of ``keep`` stay, as its result reads them.

    A scratch deletes nothing but what it has written itself, so results of other operators are never touched.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        self.drop(*[df for df, _ in self._paths.values()])

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        found = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(found)] = found, path
        return found

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables of this scratch before its end; others are left alone."""
        conf = self.spark._jsc.hadoopConfiguration()
        for df in tables:
            if (known := self._paths.pop(id(df), None)) is not None:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(known[1])
                path.getFileSystem(conf).delete(path, True)


def near(small: DataFrame, most_rows: int = 500_000) -> DataFrame:
    """A written table, marked for a broadcast if it has at most ``most_rows`` rows of a few numbers, else for a merge join."""
    return F.broadcast(small) if small.count() <= most_rows else small.hint("merge")


def fresh(name: str, *taken: Iterable[str]) -> str:
    """``name``, with underscores where columns are called so already (in any case)."""
    used = {x.lower() for names in taken for x in names}
    while name.lower() in used:
        name += "_"
    return name


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True for the rows that no classifier of this package learns from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 4 == 2, F.lit(False))


def beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction: its cost doesn't grow with a and b."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    out = d
    for m in range(1, 100_000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + term * d, 1 + term / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) * out / a)


def binomial_at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Bin(n, p), exactly."""
    return 1.0 if k >= n else beta_share(1 - p, n - k, k + 1)


def binomial_at_least(k: int, n: int, p: float) -> float:
    return 1.0 if k <= 0 else beta_share(p, k, n - k + 1)


def give_back() -> None:
    """Gives freed memory back to the system: workers are used again by other operators, beside each other."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of few rows, so that only some texts are Python objects at a time."""
    give_back()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


def bounded(batches: Iterable[pa.RecordBatch], rows: int, most_bytes: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of at most ``rows`` rows and about ``most_bytes`` bytes of ``column``, one row at least."""
    for part in slices(batches, rows):
        upto = np.cumsum(pc.fill_null(pc.binary_length(part.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < part.num_rows:
            before = int(upto[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(upto, before + most_bytes, "right")))
            yield part.slice(at, stop - at)
            at = stop


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
