"""Query op7_byte_bpe: all documents encoded by the public 50k vocabulary and decoded again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bpe import digests
from .common import read_table

NAME = "op7_byte_bpe"
VOCABULARY = "byte_bpe_50k.tiktoken"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
