"""Query op2_mixing: all documents, weights 5, 2, 1 over the sources, 150% of all words, no source above twice its size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import read_table
from .mixing import mix

NAME = "op2_mixing"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


#: mixing.mix as a sorted running sum; FROM_DOCUMENTS is replaced where the input is another relation.
MIX_SQL = r"""
d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 9))::BIGINT AS h FROM FROM_DOCUMENTS),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM s0),
s2 AS (SELECT *, sum(source_size) OVER ()::BIGINT AS total,
    coalesce(sum(source_size * 2) OVER o, 0)::BIGINT AS filled_words,
    (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::BIGINT AS rest
  FROM s1 WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, total * 3 - filled_words * 2 AS num, rest * 2 AS den FROM s2),
lv AS (SELECT arg_max(num, rest) AS lnum, max(rest) AS lrest, max(rest) * 2 AS lden FROM s3 WHERE num * weight < source_size * 2 * den),
s4 AS (SELECT source, source_size, lrest IS NULL OR rest > lrest AS filled, lnum, lden, weight, (lnum * weight) // lden AS whole FROM s3, lv),
t AS (SELECT source, source_size,
    CASE WHEN filled THEN (source_size * 2)::DOUBLE ELSE (lnum * weight)::DOUBLE / lden::DOUBLE END AS target,
    CASE WHEN filled THEN 2 ELSE coalesce(whole // nullif(source_size, 0), 0) END AS copies,
    CASE WHEN filled THEN 0 ELSE whole - coalesce(whole // nullif(source_size, 0), 0) * source_size END AS budget FROM s4),
r AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h) AS upto, sum(size) OVER (PARTITION BY source, h) AS words FROM d),
mixed AS (
  SELECT r.doc_id, r.size, t.source_size, t.target,
    (t.copies + CASE WHEN upto <= budget OR (upto - words < budget AND 2 * (budget - upto + words) >= words) THEN 1 ELSE 0 END)::BIGINT AS times_taken
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)"""

ORACLE = "WITH" + MIX_SQL.replace("FROM_DOCUMENTS", "documents") + "\nSELECT doc_id, size, source_size, target, (size * times_taken)::BIGINT AS taken FROM mixed"
