"""Lines that repeat across documents are dropped.

Lines are exploded to (hash of the normalised line, document, position); the distinct documents of each hash are counted;
the lines over the threshold go from all documents but the one with the largest id. Their positions are gathered by
document, and the lines at all other positions are put together again in their order.

Defined results: null or empty text is one empty line (a null text stays null); rows that share an id count as one
document, and each row loses its own lines; null ids are one document, smaller than all others; lines of a document
repeated in it stay or go together; columns of ``docs`` pass through, whatever they are called, but n_lines and
n_dropped, which are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, fresh, slices, utf8

#: Stands for a null id while rows are joined by it.
NO_ID = -(2**63)
_WIDE = 2**63


def line_key(line: bytes, least: int) -> bytes | None:
    """The normalised line (ASCII white space stripped, A-Z lower-cased), or None with under ``least`` code points."""
    key = line.strip().lower()  # of bytes: ASCII only
    if len(key) < least or len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least:
        return None
    return key


def _hash(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return (h >> 64) - _WIDE, (h & (2**64 - 1)) - _WIDE


def _row_key() -> list[Column]:
    """Tells rows apart that share an id: the id and two hashes of the text. Rows equal in all three lose the same lines."""
    return [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("again"), "text").alias("t2")]


def line_hashes(docs: DataFrame, least: int) -> DataFrame:
    """Rows (h1, h2, id, t1, t2, pos): the normalised lines of each document that are long enough, as 128-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            h1, h2, row, pos = [], [], [], []
            for i, text in enumerate(utf8(part.column("text"))):
                for k, line in enumerate(text.split(b"\n")):
                    if (key := line_key(line, least)) is not None:
                        a, b = _hash(key)
                        h1.append(a), h2.append(b), row.append(i), pos.append(k)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), *(part.column(c).take(at) for c in ("id", "t1", "t2")), pa.array(pos, pa.int64())], ["h1", "h2", "id", "t1", "t2", "pos"])

    return docs.select(*_row_key(), "text").mapInArrow(run, "h1 long, h2 long, id long, t1 long, t2 long, pos long")


def dedup_lines(docs: DataFrame, least: int = 40, most_docs: int = 5) -> DataFrame:
    """``docs`` with ``text`` replaced and n_lines, n_dropped added; a null text stays null.

    Shuffles: the hashes twice (counting, and joining with the repeated ones, which the adaptive planner splits where a
    line is in very many documents), and the texts once by document, to meet the positions that they lose.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    key, drops_name = [fresh(c, names) for c in ("id", "t1", "t2")], fresh("drops", names, ("n_lines", "n_dropped"))
    with Scratch(docs.sparkSession) as own:
        lines = own.table(line_hashes(docs, least), "line-hashes")
        counted = lines.select("h1", "h2", "id").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= most_docs)
        repeated = own.table(counted.select("h1", "h2", "keeper"), "line-repeated")
        gone = lines.join(repeated, ["h1", "h2"]).where(F.col("id") != F.col("keeper"))
        by_row = gone.groupBy("id", "t1", "t2").agg(F.collect_set("pos").alias("pos"))  # rows equal in text repeat positions
        drops = own.keep(by_row.select(*[F.col(a).alias(b) for a, b in zip(("id", "t1", "t2"), key, strict=True)], F.col("pos").alias(drops_name)), "line-drops")
    texts = docs.select(*names, *[c.alias(k) for c, k in zip(_row_key(), key, strict=True)]).join(drops.hint("merge"), key, "left")
    kept = T.StructType([*[f for f in docs.schema if f.name in names], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            shown, n_lines, n_dropped = [], [], []
            for text, drop, null in zip(utf8(part.column("text")), part.column(drops_name).to_pylist(), part.column("text").is_null().to_pylist(), strict=True):
                lines = text.split(b"\n")
                gone = set(drop or ())
                shown.append(None if null else b"\n".join([x for k, x in enumerate(lines) if k not in gone]).decode())
                n_lines.append(len(lines)), n_dropped.append(len(gone))
            made = {"text": pa.array(shown, pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
            yield pa.RecordBatch.from_arrays([made[n] if n in made else part.column(n) for n in kept.names], kept.names)

    return texts.select(*names, drops_name).mapInArrow(run, kept)
