"""Content-addressed raw store: what is fetched once is never fetched again, and what is stored can be checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical_url


def address(content: str = "content") -> list:
    """Digest, and the two folders that its blob is filed under."""
    digest = F.sha2(F.col(content), 256)
    return [digest.alias("sha256"), F.substring(digest, 1, 2).alias("shard1"), F.substring(digest, 3, 2).alias("shard2")]


def manifest_of(fetched: DataFrame) -> DataFrame:
    """One row per canonical URL of (url, content, fetched_at, content_type, http_status): the first fetch counts."""
    named = fetched.withColumn("url", canonical_url(F.col("url"))).filter("url is not null")
    row = F.struct(F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("size"), "fetched_at", "content_type", "http_status")
    return named.groupBy("url").agg(F.min_by(row, "fetched_at").alias("r")).select("url", "r.*")


def conflicts(fetched: DataFrame) -> DataFrame:
    """URLs that have been seen with different bytes."""
    named = fetched.select(canonical_url(F.col("url")).alias("url"), F.sha2("content", 256).alias("sha256"))
    return named.groupBy("url").agg(F.countDistinct("sha256").alias("versions"), F.min("sha256").alias("least"), F.max("sha256").alias("greatest")).filter("versions > 1")


def to_fetch(urls: DataFrame, manifest: DataFrame) -> DataFrame:
    """The URLs (column ``target``) that no manifest row has."""
    return urls.join(manifest.select(F.col("url").alias("target")), "target", "left_anti")


def verify(manifest: DataFrame, blobs: DataFrame) -> DataFrame:
    """Problems of the store: blobs (sha256 of their name, content) that are missing or hash to something else."""
    held = blobs.select("sha256", F.sha2("content", 256).alias("actual"))
    out = manifest.join(held, "sha256", "left")
    problem = F.when(F.col("actual").isNull(), "blob missing").when(F.col("actual") != F.col("sha256"), F.concat(F.lit("content hashes to "), F.col("actual")))
    return out.withColumn("problem", problem).filter("problem is not null").select("url", "sha256", "problem").orderBy("url")


class CacheConflict(ValueError):
    """A URL was fetched with other bytes than are on file."""


def checked(fetched: DataFrame, manifest: DataFrame) -> DataFrame:
    """fetched, refused if a URL of it has other bytes than the manifest has for it, or two versions itself."""
    named = fetched.select(canonical_url(F.col("url")).alias("url"), F.sha2("content", 256).alias("sha256")).union(manifest.select("url", "sha256"))
    bad = named.groupBy("url").agg(F.min("sha256").alias("least"), F.max("sha256").alias("greatest")).filter("url is not null and least <> greatest").first()
    if bad:
        raise CacheConflict(f"{bad.url} is stored as {bad.least} and as {bad.greatest}")
    return fetched


def stored_blobs(spark: SparkSession, path: str) -> DataFrame:
    """(content, sha256, shard1, shard2) of the blobs on file; empty where nothing has been stored yet."""
    schema = "content binary, sha256 string, shard1 string, shard2 string"
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def write_blobs(fetched: DataFrame, path: str) -> None:
    """Append the distinct contents that are not on file yet, filed by the first two bytes of their digest."""
    new = fetched.select("content", *address()).dropDuplicates(["sha256"])
    have = stored_blobs(fetched.sparkSession, path).select("sha256", "shard1", "shard2")
    new.join(have, ["sha256", "shard1", "shard2"], "left_anti").select("content", "sha256", "shard1", "shard2").write.mode("append").partitionBy("shard1", "shard2").parquet(path)


def entries(manifest: DataFrame, blobs: DataFrame) -> DataFrame:
    """Manifest rows with their contents, in the order of their names (the digest of the URL): what a new parse reads."""
    return manifest.join(blobs.select("sha256", "content"), "sha256").withColumn("name", F.sha2("url", 256)).orderBy("name")


def files(spark: SparkSession, path: str) -> DataFrame:
    """Raw files of a folder as (path, content), in order of their names where it matters to the caller."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length", "content")
