"""A corpus from documents to token ids, in five stages, each of which works on all that the one before it kept."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bpe, mixing, pii, simhash, toxicity
from barloom.llm.common import shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples call toxic go; every label may be learned from."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"), lambda doc_id: doc_id.isNotNull())


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest doc_id stays."""
    return simhash.keep_first(docs)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms under the session's key, whatever table they stand in."""
    return pii.pseudonymised(docs, pii.session_key(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeat a document as often as its source's rate asks for."""
    out = mixing.mixed(docs)
    return out.drop(out.columns[-1])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the text that they decode to."""
    ids = bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return ids.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.col("decoded").cast("string").alias("text"))


STAGES = [("toxicity", drop_toxic), ("simhash near-dedup", drop_near_copies), ("pii", pseudonymise), ("source mixing", mix), ("byte-level bpe", encode)]

#: SQL can't express the fitted and hashed stages; they are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage is written as Parquet to the shared folder and read again as the next one's documents.

    What a stage wrote stays, so that a run can be looked into or taken up; the folder is the caller's to delete.
    """
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{i}")
        docs = spark.read.parquet(path)
    return docs
