"""Query op5_quality_classifier: learned from rows that aren't held out, all documents scored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, read_table
from .quality_classifier import score_documents

NAME = "op5_quality_classifier"
THRESHOLD = 0.7


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", "quality")
    return score_documents(docs, labels).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
