"""FASTQ as a Python data source: ``spark.read.format("fastq")`` and ``df.write.format("fastq")``.

Gzip is told by its first bytes, not by the name. A file is one partition, as a gzip stream can't be split; repartition
after the scan. Records are checked while they are read and the first fault is raised with its record number. Paths are
files that every executor sees.
"""

from __future__ import annotations

import glob
import gzip
import io
import os
import zlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "header string, sequence string, separator string, quality string, record_number long, path string"


class FastqError(ValueError):
    pass


def _open(path: str) -> io.BufferedReader:
    raw = open(path, "rb")  # noqa: SIM115
    magic = raw.read(2)
    raw.seek(0)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) if magic == b"\x1f\x8b" else io.BufferedReader(raw, 1 << 20)


def _lines(stream: io.BufferedReader) -> Iterator[bytes]:
    for line in stream:
        yield line[:-1].rstrip(b"\r") if line.endswith(b"\n") else line


def records(path: str) -> Iterator[tuple]:
    """(header, sequence, separator, quality, record number from 1, path)."""
    n = 0
    try:
        with _open(path) as stream:
            lines = _lines(stream)
            for header in lines:
                n += 1
                rest = [next(lines, None) for _ in range(3)]
                _check(n, header, *rest)
                yield (*(x.decode("ascii", "replace") for x in (header, *rest)), n, path)
    except (EOFError, gzip.BadGzipFile, zlib.error) as e:
        raise FastqError(f"{path}: the gzip stream is damaged: {e}") from e
    if n == 0:
        raise FastqError(f"{path}: the file has no records")


def _check(n: int, header: bytes, sequence: bytes | None, separator: bytes | None, quality: bytes | None) -> None:
    if not header:
        raise FastqError(f"record {n}: a header is expected, the line is empty")
    if not header.startswith(b"@"):
        raise FastqError(f"record {n}: the header must start with @")
    if not sequence:
        raise FastqError(f"record {n}: the sequence is missing or empty")
    if not separator or not separator.startswith(b"+"):
        raise FastqError(f"record {n}: the separator must start with +")
    if not quality:
        raise FastqError(f"record {n}: the quality is missing or empty")
    if len(sequence) != len(quality):
        raise FastqError(f"record {n}: sequence has {len(sequence)} bases, quality {len(quality)}")
    if min(quality) < 33 or max(quality) > 126:
        at = next(i for i, b in enumerate(quality, 1) if not 33 <= b <= 126)
        raise FastqError(f"record {n}: the quality at {at} is outside 33 to 126")


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return records(partition.value)


class _Message(WriterCommitMessage):
    def __init__(self, path: str) -> None:
        self.path = path


class _Writer(DataSourceWriter):
    """A gzip member for each partition, in the order of partitions; put together they are one legal file."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, rows) -> _Message:
        from pyspark import TaskContext

        context = TaskContext.get()
        os.makedirs(self.path, exist_ok=True)
        name = f"{self.path}/part-{context.partitionId():05d}.fastq.gz"
        temporary = f"{name}.{context.taskAttemptId()}.tmp"
        with gzip.open(temporary, "wb", compresslevel=1) as out:
            for r in rows:
                if len(r["sequence"]) != len(r["quality"]):
                    raise FastqError("sequence and quality differ in length")
                out.write("\n".join((r["header"], r["sequence"], r["separator"], r["quality"], "")).encode())
        os.replace(temporary, name)
        return _Message(name)

    def commit(self, messages) -> None:
        open(f"{self.path}/_SUCCESS", "w").close()

    def abort(self, messages) -> None:
        for m in messages:
            if m and os.path.exists(m.path):
                os.remove(m.path)


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def _path(self) -> str:
        return self.options["path"].removeprefix("file://")

    def reader(self, schema) -> DataSourceReader:
        path = self._path()
        found = sorted(glob.glob(f"{path}/part-*.fastq.gz")) if os.path.isdir(path) else sorted(glob.glob(path))
        if not found:
            raise FastqError(f"no such file: {path}")
        return _Reader(found)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self._path())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastqSource)


def read_fastq(spark: SparkSession, path: str):
    register(spark)
    return spark.read.format("fastq").load(path)


def write_fastq(reads, path: str, partitions: int | None = None) -> None:
    """Writes reads in the order of their record numbers, by ranges of them."""
    register(reads.sparkSession)
    ordered = reads.select("header", "sequence", "separator", "quality", "record_number")
    ordered = ordered.repartitionByRange(partitions, "record_number") if partitions else ordered.repartitionByRange("record_number")
    ordered.sortWithinPartitions("record_number").write.format("fastq").mode("append").save(path)


def join_parts(path: str, target: str) -> None:
    """Puts the members of a written folder together as one gzip file, without packing them again."""
    temporary = f"{target}.tmp"
    with open(temporary, "wb") as out:
        for part in sorted(glob.glob(f"{path}/part-*.fastq.gz")):
            with open(part, "rb") as member:
                while data := member.read(1 << 20):
                    out.write(data)
    os.replace(temporary, target)
