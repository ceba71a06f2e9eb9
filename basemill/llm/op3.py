"""Query op3_toxicity: learned from rows that aren't held out, all documents scored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, read_table
from .toxicity import score_documents, train

NAME = "op3_toxicity"
THRESHOLD = 0.3


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint"), "text")
    labels = read_table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", "toxic")
    model = train(docs.where(~held_out()), labels)
    scored = score_documents(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"))
