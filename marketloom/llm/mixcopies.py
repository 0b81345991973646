"""How often the mix takes each document when none is left out for want of more: the ratios of ``mixing`` in full."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing
from .common import documents

SQL = mixing.COPIES_SQL


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source", "lang")
    return mixing.mix(docs).select("doc_id", "n_tokens", "source", "lang", F.col("m_topic").alias("topic"), F.round("ratio", 6).alias("ratio"), "copies")
