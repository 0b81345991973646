"""A corpus from raw documents to token ids: five stages, each over all that the one before kept.

Every stage but the last returns the columns of ``documents``; a stage's result is a Parquet table in the shared
folder, which the next one reads.

Cases, in every stage: further columns stay, whatever their names, but in the last stage, which returns its own; an empty table gives an
empty result; very long texts are worked on whole, in parts. What becomes of nulls, empty texts, ties and repeated rows is said at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marketloom.llm import bpe, common, exact, mixing, neardup, quality

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current quality policy; those that it rejects go. Null and empty texts are too short; repeated rows have one fate; null ids are no matter."""
    common.prepared(spark)
    return quality.quality_filter(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays, and once if it repeats wholly. Null counts as an empty text, a null id as lower than any."""
    common.prepared(spark)
    return exact.drop_duplicates(docs, whole=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by shingles of five words and a similarity of 0.8, the least doc_id stays. Texts without words link with nothing, rows without id stay, rows that share an id are one document."""
    common.prepared(spark)
    return neardup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as sources, languages and topics need for their tempered shares. A null source or language is a value of its own; rows that share an id have one fate in their cell; texts without words go with their cell."""
    common.prepared(spark)
    return mixing.sample(docs)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the token ids of the text, with their number and the digests of ids and decoded bytes, for every row. Null and empty texts have no ids; null ids stay null."""
    common.prepared(spark)
    return bpe.digests(docs, RANKS, ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode_bytes", encode_bytes),
]

#: Near-duplicate links by minhash and byte-pair merges have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage stores on its way is deleted when its result has been written; the last one's result is the caller's to write."""
    docs = common.documents(common.prepared(spark), sf_dir)
    for name, stage in STAGES[:-1]:
        with common.passing(spark):
            docs = common.stored(stage(spark, docs, sf_dir), name, lasting=True)
    return STAGES[-1][1](spark, docs, sf_dir)
