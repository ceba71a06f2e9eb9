"""Query op8_jaccard_join: components of all documents under similarity of 0.75 over 5-word shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import read_table
from .jaccard_join import jaccard_components

NAME = "op8_jaccard_join"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
