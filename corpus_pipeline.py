"""A corpus from documents to token ids, in five stages, each written as Parquet and read again by the next.

1. toxicity: documents that the classifier of op3 rejects go
2. line_dedup: lines that repeat across documents go (op6)
3. jaccard_join: of documents linked by shared shingles, one stays: the one with the smallest id (op8)
4. mixing: each document as often as the mix of sources takes it (op2)
5. byte_bpe: token ids of every text, checked by decoding them (op7)

Every stage returns the columns of ``documents``, whatever they are, but the last, which has token ids in place of the
text. Defined results: null and empty texts pass all stages (they are neither toxic, nor linked; they have no words, so the
mix takes them as often as their hash says) and have no tokens; very long texts are processed whole; rows that repeat an
id are scored and cut each by its own text, and stay or go together in 3 and 4; documents that tie are told apart by id; a
null id is an id of its own, and its rows stay in 3; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basemill.llm import bpe, jaccard_join, line_dedup, mixing, op3, op7, toxicity
from basemill.llm.common import Scratch, fresh, held_out, near, read_table, shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", "toxic")
    model = toxicity.train(docs.select("doc_id", "text").where(~held_out()), labels)
    return toxicity.score_documents(docs, model).where(F.col("toxic_score") < op3.THRESHOLD).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(docs)
    changed = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"])
    return done.withColumn("n_chars", changed).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard_join.jaccard_components(docs.select("doc_id", "text"))
    stays = F.max(F.col("doc_id").eqNullSafe(F.col("component_id")))
    name = fresh("gone", docs.columns)
    with Scratch(spark) as own:  # the few ids that go are joined, not all that stay
        gone = own.keep(found.groupBy("doc_id").agg(stays.alias("stays")).where("not stays").select(F.col("doc_id").alias(name)), "pipeline-gone")
    return docs.join(near(gone), F.col("doc_id") == F.col(name), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, public_tokenizers.path(op7.VOCABULARY), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("jaccard_join", one_of_each_group),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: The classifier has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
