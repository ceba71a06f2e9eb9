"""Reads and read pairs derived from the table lineitem, by one SQL text that means the same in Spark and DuckDB.

No table of the test data holds sequencing reads, so these stand in for them. All branches of the operators occur:
duplicates, several lengths, adapters, low-quality tails, poly-G and poly-A tails, lower case, N, and pairs with
overlaps, read-through and substitutions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import written

R1_ADAPTER = "AGATCGGAAGAGCACACGTCTGAACTCCAGTCA"
R2_ADAPTER = "AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGT"
_DNA = "'0123456789abcdef', 'ACGTACGTACGTACGN'"
_PHRED = "'0123456789abcdef', '#+05:<=>?@ABCDEI'"
_FROM = "FROM (SELECT *, concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS k, CAST(l_quantity AS INT) AS q FROM lineitem) t"

READS = f"""
SELECT record_number, read, concat('@', k, ' ', read) AS header, sequence, '+' AS separator,
  CASE WHEN l_linestatus = 'F' THEN concat(substr(quality, 1, length(sequence) - 8), '########') ELSE substr(quality, 1, length(sequence)) END AS quality
FROM (
  SELECT *, CASE
    WHEN l_linenumber = 3 THEN substr(concat(substr(s, 1, 8 + q), CASE WHEN read = 'R1' THEN '{R1_ADAPTER}' ELSE '{R2_ADAPTER}' END), 1, 64)
    WHEN l_linenumber = 4 THEN concat(substr(s, 1, 15), 'CTGTCTCTTATACACATCT', substr(s, 20, q))
    WHEN l_linenumber = 5 THEN concat(substr(s, 1, q), 'GGGGGGGGGGGG')
    WHEN l_linenumber = 6 THEN concat(substr(s, 1, 10 + q), 'AAAAAAAAAAAAAA')
    WHEN l_linenumber = 7 THEN concat(lower(substr(s, 1, 6)), substr(s, 7, q + 6))
    ELSE substr(s, 1, 20 + q) END AS sequence
  FROM (
    SELECT (l_orderkey * 8 + l_linenumber) * 100000000000 + (l_suppkey % 1000) * 100000000 + CAST(floor(l_extendedprice * 100) AS BIGINT) AS record_number, CASE WHEN l_orderkey % 2 = 0 THEN 'R1' ELSE 'R2' END AS read, k, q, l_linenumber, l_linestatus,
      translate(concat(md5(concat(d, 'a')), md5(concat(d, 'b')), md5(concat(d, 'c'))), {_DNA}) AS s,
      translate(concat(md5(concat(k, 'q')), md5(concat(k, 'r')), md5(concat(k, 's'))), {_PHRED}) AS quality
    FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN concat('p', CAST(l_partkey % 40 AS STRING)) ELSE k END AS d {_FROM}) u) v) w
"""

#: Fragments of 25 to 74 bases, read 50 bases from each end: the short ones read through into the adapters.
PAIRS = f"""
SELECT record_number, concat('@', k, '/1') AS header1, substr(concat(f, '{R1_ADAPTER}'), 1, 50) AS sequence1, q1 AS quality1,
  concat('@', CASE WHEN l_linenumber = 6 THEN 'x' ELSE '' END, k, '/2') AS header2,
  substr(concat(CASE WHEN l_linenumber = 2 THEN concat(substr(rc, 1, 9), translate(substr(rc, 10, 1), 'ACGTN', 'CGTAC'), substr(rc, 11, 100)) ELSE rc END, '{R2_ADAPTER}'), 1, 50) AS sequence2, q2 AS quality2
FROM (
  SELECT *, reverse(translate(f, 'ACGTN', 'TGCAN')) AS rc FROM (
    SELECT (l_orderkey * 8 + l_linenumber) * 100000000000 + (l_suppkey % 1000) * 100000000 + CAST(floor(l_extendedprice * 100) AS BIGINT) AS record_number, k, l_linenumber,
      substr(translate(concat(md5(concat(k, 'a')), md5(concat(k, 'b')), md5(concat(k, 'c'))), {_DNA}), 1, 24 + q) AS f,
      substr(translate(concat(md5(concat(k, 'q')), md5(concat(k, 'r'))), {_PHRED}), 1, 50) AS q1,
      substr(translate(concat(md5(concat(k, 's')), md5(concat(k, 't'))), {_PHRED}), 1, 50) AS q2
    {_FROM}) u) v
"""

SHEET = """
SELECT concat('P', CAST(c_nationkey AS STRING)) AS patient_id, concat('S', CAST(CASE WHEN c_custkey % 97 = 0 THEN 0 ELSE c_custkey END AS STRING)) AS sample_id,
  CASE c_custkey % 5 WHEN 0 THEN 'tumor' WHEN 1 THEN 'normal' WHEN 2 THEN 'tumor_rna' WHEN 3 THEN 'tumor' ELSE 'other' END AS sample_role,
  CASE WHEN c_custkey % 5 = 2 AND c_custkey % 7 <> 0 THEN 'rna' WHEN c_custkey % 11 = 0 THEN 'protein' ELSE 'dna' END AS material,
  concat('r', CAST(c_custkey AS STRING), '.fq') AS r1, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('r', CAST(c_custkey % 400 AS STRING), '_2.fq') END AS r2,
  'illumina' AS platform, 'wes' AS library_type, CASE WHEN c_custkey % 50 = 1 THEN 'GRCh37' ELSE 'GRCh38' END AS reference, CAST(c_custkey AS BIGINT) + 1 AS line
FROM customer
"""


_tables: dict[tuple[str, str, str], DataFrame] = {}


def _table(spark: SparkSession, sf_dir: str, name: str, table: str, text: str) -> DataFrame:
    """The derived table, made once a session and written to the shared folder: queries then scan stored reads and
    read only the columns they use. The few source columns are dealt over the cores first, as one file may be one task."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _tables:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").repartition(max(8, spark.sparkContext.defaultParallelism)).createOrReplaceTempView(table)
        _tables[key] = written(spark.sql(text), f"derived-{name}")
    return _tables[key]


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_number, read, header, sequence, separator, quality."""
    return _table(spark, sf_dir, "reads", "lineitem", READS)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_number and header, sequence, quality of both mates (suffix 1 and 2)."""
    return _table(spark, sf_dir, "pairs", "lineitem", PAIRS)


def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample sheet with every kind of fault."""
    spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("customer")
    return spark.sql(SHEET)
