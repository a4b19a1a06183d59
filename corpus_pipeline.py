"""A corpus pipeline of five operators: language, near-duplicates, contamination, personal data, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet
and read again as the next stage's ``docs``.  All but the last return the columns
of ``documents``; none changes a document other than by what its operator decides.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import bpe, decontaminate, lang_cnn, pii, simhash
from keelson.llm.common import ensure_checkpoint_dir, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in which no language can be told (no text, or no letter in it) go."""
    named = lang_cnn.identify(docs, lang_cnn.fit(docs))
    return named.where(F.col("lang_pred") != lang_cnn.UNKNOWN).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the least doc_id stays."""
    return simhash.deduplicate(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind, and n_chars follows."""
    return pii.redact(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, checked by decoding: doc_id, lang, source, token_ids, n_tokens and digests."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ids = bpe.encode(docs, ranks, public_tokenizers.PATTERN).drop("text")
    decoded = bpe.decode(ids, ranks)
    return decoded.select("doc_id", "lang", "source", "token_ids", *bpe.digests())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("contamination", contamination),
    ("personal_data", personal_data),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a Parquet table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


#: Fingerprints, a trained network and token ids aren't SQL; tests hold the stages against plain versions.
ORACLE_SQL = None
