"""From raw documents to packed training sequences, in five stages.

Each stage takes what the one before it kept, written as Parquet and read
again.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkworks.llm.common import shared_folder, table
from sparkworks.llm.exact_dedup import drop_exact_duplicates
from sparkworks.llm.language_id import UNKNOWN, identify, learn_profiles
from sparkworks.llm.near_dedup import drop_near_duplicates
from sparkworks.llm.packing import pack_documents
from sparkworks.llm.queries import tokenizer_file
from sparkworks.llm.substring_dedup import remove_repeats

#: Texts that share nothing have a cosine of standard deviation 1 / sqrt(512) = 0.044; the least of a long text of sf0.1 and check_s is 0.12.
LEAST_COSINE = 0.11
#: Below so many characters a text's few trigrams say too little; only a cosine of noise from below, under 0.02, rejects it.
ENOUGH, LEAST_SHORT = 200, 0.02


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without letters and those that resemble no language; the others keep all they have.

    Rows with a null id, or that repeat one, are judged like others.
    """
    found = identify(docs, learn_profiles(docs), keep=True)
    sound = found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= F.when(F.length("row.text") >= ENOUGH, LEAST_COSINE).otherwise(LEAST_SHORT)))
    return sound.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays, whatever ids repeat; a null id is the least."""
    return drop_exact_duplicates(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; rows are told apart by id and text."""
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more go where a document with a smaller id has them; other texts stay as they are."""
    out = remove_repeats(docs, threshold=50, anchor=10, keep=True)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 token ids; each row is packed, whatever its id."""
    return pack_documents(docs, tokenizer_file("word_bpe_49k.json"), end_id=1, limit=2048)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("minhash_near_dedup", minhash_near_dedup), ("substring_dedup", substring_dedup), ("packing", packing)]

#: SQL has neither the profiles of the first stage nor the tokenizer of the last; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
