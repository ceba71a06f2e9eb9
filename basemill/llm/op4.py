"""Query op4_quality_rules: base rules and risk-controlled cutoffs over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, held_out, read_table
from .quality_rules import base_failed, fit_cutoffs, verdict, with_figures

NAME = "op4_quality_rules"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as own:
        figured = own.keep(with_figures(read_table(spark, sf_dir, "documents")), "quality-figures")
        labels = read_table(spark, sf_dir, "labels").where(F.col("quality").isNotNull() & ~held_out()).select("doc_id", (F.col("quality") == 1).alias("good"))
        cutoffs = fit_cutoffs(figured.where(~base_failed()), labels)
        return figured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & verdict(cutoffs)).alias("kept"))
