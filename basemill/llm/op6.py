"""Query op6_line_dedup: lines of at least 40 code points in at least 5 documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .line_dedup import dedup_lines

NAME = "op6_line_dedup"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


#: From a relation FROM_DOCUMENTS (doc_id, text) to deduped (doc_id, n_lines, n_dropped, kept).
DEDUP_SQL = r"""
l0 AS (SELECT doc_id, coalesce(text, '') AS text FROM FROM_DOCUMENTS),
l1 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM l0),
l2 AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l1),
l3 AS (SELECT k, max(doc_id) AS keeper FROM l2 WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
l4 AS (SELECT l2.*, l3.k IS NOT NULL AND doc_id <> keeper AS gone FROM l2 LEFT JOIN l3 ON l2.k = l3.k),
deduped AS (SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM l4 GROUP BY doc_id)"""

ORACLE = "WITH" + DEDUP_SQL.replace("FROM_DOCUMENTS", "documents") + "\nSELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM deduped"
