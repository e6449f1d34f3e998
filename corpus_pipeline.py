"""The corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, suffix-array dedup, packing.

Every stage works on all that its predecessor kept and, but for the last, returns the
columns of ``documents``; each result is written as Parquet to the shared folder and
read again as the next stage's documents. Part of the subpackage llm.

All stages: null text counts as empty, texts are read whole however long, null or
repeated ids and columns of any name come through, no documents give no rows. A row is
judged by its own text, so of rows that share an id some may go. Ties: equal texts keep
the largest doc_id (one row, if rows are equal too), near copies the smallest, a row
without id last and first respectively; of several near copies without id one stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import digest_index, jaccard, packing, suffix_array, toxicity
from siltstone.llm.common import materialise, ship, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    ship(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    ship(spark)
    return digest_index.keep_distinct(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays."""
    ship(spark)
    return jaccard.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose what repeats; a character that a cut leaves incomplete goes too. No row goes."""
    ship(spark)
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    kept = suffix_array.remove_repeats(docs, carry=others)
    return kept.select("row.*", F.col("kept_text").alias("text"), F.length("kept_text").cast("long").alias("n_chars")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 ids."""
    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact_copies), ("jaccard_join", drop_near_copies), ("suffix_array", cut_repeats), ("packing", pack)]

#: Scores and token ids are beyond SQL; tests/llm/test_pipeline.py holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
