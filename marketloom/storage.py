"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_within: ContextVar[str | None] = ContextVar("within", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or on a local master (tests) a new local one where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="marketloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def passing(spark: SparkSession) -> Iterator[str]:
    """Tables stored inside go to one folder, which is deleted at the end, also on failure: results must have been written elsewhere by then."""
    folder = _fresh(spark, "passing")
    token = _within.set(folder)
    try:
        yield folder
    finally:
        _within.reset(token)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts lineage, survives lost executors. lasting: it outlives ``passing``."""
    spark, folder = df.sparkSession, _within.get()
    path = _fresh(spark, name) if lasting or folder is None else f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
