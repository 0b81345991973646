"""Token counts: lengths only, in batches of bounded bytes.

Each Arrow batch is cut into slices of about equal bytes, so one slice of long texts costs what one of
many short texts does; a longer text is a slice of its own, worked on in parts, and its distinct chunks are encoded as
those of any other (see ``chunks``: texts are cut only where the ids of the parts join to those of
the whole). Only lengths leave the task. The rows are spread over the executors by the scan; there
is no shuffle.

Cases: null and empty texts have no bytes and no tokens; repeated rows are counted each; other
columns named in ``keep`` pass through, null ones as they are, the rest is not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .chunks import library_encoder
from .common import column, documents, prepared, slices

LIMIT = 1024


def _lengths(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(path)
        for batch in batches:
            texts = column(batch, "text")
            n_bytes, n_tokens = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for first, end, at, _ in slices(texts):
                n_bytes[first:end] = np.diff(at)
                n_tokens[first:end] = encoder.lengths([t or "" for t in texts[first:end].to_pylist()])
            kept = [n for n in batch.schema.names if n != "text"]
            yield pa.record_batch([*[column(batch, n) for n in kept], pa.array(n_bytes), pa.array(n_tokens)], names=[*kept, "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep``, with n_bytes (UTF-8) and n_tokens by the tokenizers file at ``path``."""
    given = docs.select(*keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name != "text")
    return given.mapInArrow(_lengths(path), f"{schema}, n_bytes long, n_tokens long")


def query(spark: SparkSession, sf_dir: str, tokenizer: str = public_tokenizers.path("byte_bpe_50k.json")) -> DataFrame:
    counted = token_counts(documents(prepared(spark), sf_dir), tokenizer)
    return counted.select("*", (counted["n_tokens"] > LIMIT).alias("over_limit"))
