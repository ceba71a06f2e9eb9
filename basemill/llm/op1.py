"""Query op1_media: every document stored as an image, referred to by a page, resolved by digest and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read_table
from .media import describe, resolve, sequences, store_texts

NAME = "op1_media"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as own:
        stored = own.table(store_texts(read_table(spark, sf_dir, "documents")), "media-store")
        found = resolve(sequences(stored, "seq_id"), describe(stored))
        images = F.filter("parts", lambda x: x["kind"] == "image")
        shown = found.select("seq_id", F.element_at(images, 1).alias("image"), F.size("parts").alias("n_parts"))
        joined = stored.select("seq_id", "doc_id").join(shown, "seq_id")
        return own.keep(joined.select("doc_id", "image.media.*", F.col("image.pos").alias("position"), "n_parts", F.col("image.caption").alias("caption")), "media-features")
