"""A corpus cleaned and encoded in five stages, each over all that its predecessor kept.

All but the last return the columns of ``documents`` (doc_id, text, lang, source, n_chars), whatever else the table has.
Nulls in any column, repeated ids, repeated rows, empty and very long texts and empty tables pass through each stage; rows
are told apart by id and text together, so that a row never goes because of another one under its id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.llm import bpe, decontaminate, line_dedup, ngram_join, toxicity
from turnmill.llm.common import saved, table
from turnmill.session import ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects; a null text is scored as the empty one, and stays unless most documents are toxic."""
    ship_package(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels")).select(COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the cross-site lines, but for their first places; n_chars follows the text. A null source is one site, a null text stays null."""
    ship_package(spark)
    clean = line_dedup.dedup_lines(docs)
    return clean.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least id and text hash, ids before null; texts without words all stay."""
    ship_package(spark)
    return ngram_join.one_of_each(docs).select(COLUMNS)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item; one without words, or a benchmark without rows, leaks nothing."""
    ship_package(spark)
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text; a null text counts as empty, a null id stays null."""
    ship_package(spark)
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxic_stage), ("line dedup", line_stage), ("n-gram join", join_stage), ("decontamination", leak_stage), ("byte-level BPE", encode_stage)]
#: The stages train a classifier and encode tokens, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
