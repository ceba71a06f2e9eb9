"""Checks of reads, pairs and sample sheets. Each returns the faults as rows; ``first_fault`` raises the earliest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as E


def read_faults(reads: DataFrame) -> DataFrame:
    """record_number, rule and message of every read that breaks a rule, by the first rule that it breaks."""
    s, q = F.col("sequence"), F.col("quality")
    rules = [
        ("header", ~F.col("header").startswith("@"), "the header must start with @"),
        ("sequence", F.length(s) == 0, "the sequence is empty"),
        ("separator", ~F.col("separator").startswith("+"), "the separator must start with +"),
        ("quality", F.length(q) == 0, "the quality is empty"),
        ("length", F.length(s) != F.length(q), "sequence and quality differ in length"),
        ("quality_range", ~q.rlike("^[!-~]*$"), "a quality is outside 33 to 126"),
        ("alphabet", ~s.rlike("^[ACGTNacgtn]*$"), "a base is none of A, C, G, T, N"),
    ]
    rule, message = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, bad, text in reversed(rules):
        rule, message = F.when(bad, name).otherwise(rule), F.when(bad, text).otherwise(message)
    keys = [c for c in ("read",) if c in reads.columns]
    return reads.select(*keys, "record_number", rule.alias("rule"), message.alias("message")).where(F.col("rule").isNotNull())


def mate_problems(r1: DataFrame, r2: DataFrame) -> DataFrame:
    """Records without a mate and mates with different ids: record_number, rule."""
    a = r1.select("record_number", E.pair_id(F.col("header")).alias("id1"))
    b = r2.select("record_number", E.pair_id(F.col("header")).alias("id2"))
    rule = F.when(F.col("id1").isNull(), "r1_missing").when(F.col("id2").isNull(), "r2_missing").when(F.col("id1") != F.col("id2"), "id_mismatch")
    return a.join(b, "record_number", "full_outer").select("record_number", rule.alias("rule")).where(F.col("rule").isNotNull())


def id_mismatches(pairs: DataFrame) -> DataFrame:
    """Pairs whose ids differ: record_number, id1, id2."""
    return pairs.select("record_number", E.pair_id(F.col("header1")).alias("id1"), E.pair_id(F.col("header2")).alias("id2")).where("id1 <> id2")


def first_fault(faults: DataFrame) -> None:
    """Raises for the fault with the smallest record number, whatever the partitioning."""
    found = faults.orderBy("record_number", "rule").first()
    if found:
        raise ValueError(f"record {found['record_number']}: {found['rule']}")


_SAFE = "^[A-Za-z0-9_.-]+$"


def _unsafe(c: Column) -> Column:
    return ~c.rlike(_SAFE) | c.isin(".", "..")


def sheet_faults(sheet: DataFrame) -> DataFrame:
    """line and the first fault of each line of a sample sheet that has one.

    Repeated samples and files are faults of the later lines. A file is compared by its path as given; callers that read
    from disk pass real paths.
    """
    col = F.col
    needed = ("r1", "platform", "library_type", "reference")
    rules = [
        ("patient_id is required", col("patient_id") == ""), ("sample_id is required", col("sample_id") == ""),
        ("patient_id must be a safe path component", _unsafe(col("patient_id"))), ("sample_id must be a safe path component", _unsafe(col("sample_id"))),
        ("sample_role must be tumor, normal, or tumor_rna", ~col("sample_role").isin("tumor", "normal", "tumor_rna")), ("material must be dna or rna", ~col("material").isin("dna", "rna")),
        *[(f"{c} is required", col(c) == "") for c in needed],
        ("tumor_rna must have material rna", (col("sample_role") == "tumor_rna") & (col("material") != "rna")),
        ("DNA samples must have material dna", col("sample_role").isin("tumor", "normal") & (col("material") != "dna")),
        ("sample_id is repeated for the patient", col("sample_again")), ("a file is used twice", col("file_again")),
    ]
    again = F.row_number().over(Window.partitionBy("patient_id", "sample_id").orderBy("line")) > 1
    files = sheet.select("line", F.posexplode(F.array("r1", "r2")).alias("side", "file")).where("file <> ''")
    twice = files.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("line", "side"))).where("n > 1").select("line").distinct().withColumn("used", F.lit(True))
    x = sheet.withColumn("sample_again", again).join(twice, "line", "left").withColumn("file_again", F.coalesce("used", F.lit(False)))
    fault = F.lit(None).cast("string")
    for text, bad in reversed(rules):
        fault = F.when(bad, text).otherwise(fault)
    return x.select("line", "patient_id", "sample_id", fault.alias("fault")).where(F.col("fault").isNotNull())


def case_roles(sheet: DataFrame) -> DataFrame:
    """Per patient: the roles present, whether tumor and normal share the reference (the last line of a role counts), and
    the status: error, warning or ok."""
    role = lambda r: F.max(F.col("sample_role") == r)
    reference = lambda r: F.max_by("reference", F.when(F.col("sample_role") == r, F.col("line")))
    x = sheet.groupBy("patient_id").agg(role("tumor").alias("tumor"), role("normal").alias("normal"), role("tumor_rna").alias("tumor_rna"), reference("tumor").alias("a"), reference("normal").alias("b"))
    same = ~(F.col("tumor") & F.col("normal") & (F.col("a") != F.col("b")))
    status = F.when((F.col("tumor") & ~F.col("normal")) | ~F.col("same_reference"), "error").when(~F.col("tumor_rna"), "warning").otherwise("ok")
    return x.withColumn("same_reference", F.coalesce(same, F.lit(True))).select("patient_id", "tumor", "normal", "tumor_rna", "same_reference", status.alias("status"))
