"""Token ids in files of patched frame-of-reference blocks, in ascending doc_id order.

``write`` range-partitions the documents by doc_id, and rows that share one by their text, encodes
them and stores records of about RECORD_IDS ids: the packed ids (see ``pfor``) with the documents' ids and lengths. Spark's Parquet
writer is the container, so files commit atomically and are readable in any store; part and record
numbers give the order. ``read_documents`` unpacks record by record.

Cases: null and empty texts hold the end id alone; rows that share a doc_id stand next to each
other, by text (by its first HEAD characters, then its hash, so that one id with many rows is dealt to many partitions and no long text is
among the bounds of ranges), and only rows equal in both always share a partition; null doc_ids come first; other columns are not stored; an empty table gives no records.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import pfor
from .chunks import library_encoder
from .common import column, documents, partitions, prepared, shared_dir, slices

END_ID = 2
RECORD_IDS = 1 << 19
#: Characters of a text that order rows of one doc_id before its hash does.
HEAD = 64
RECORD = pa.schema([("part", pa.int32()), ("record", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("ids", pa.binary())])
RECORD_DDL = "part int, record int, n_ids long, doc_ids array<long>, lengths array<long>, ids binary"


def _records(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, record = library_encoder(path), TaskContext.get().partitionId(), 0
        docs, lengths, ids, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            all_ids, per = np.concatenate(ids), np.concatenate(lengths)
            row = (part, record, len(all_ids), docs, per, pfor.pack(all_ids))
            return pa.record_batch([pa.array([x], f.type) for x, f in zip(row, RECORD)], schema=RECORD)

        for batch in batches:
            names, texts = column(batch, "doc_id"), column(batch, "text")
            for first, end, _, _ in slices(texts):
                got, per = encoder.encoded([t or "" for t in texts[first:end].to_pylist()])
                docs += names[first:end].to_pylist()
                ids.append(np.insert(got, np.cumsum(per), end_id))
                lengths.append(per + 1)
                held += len(ids[-1])
                if held >= RECORD_IDS:
                    yield flush()
                    docs, lengths, ids, held, record = [], [], [], 0, record + 1
        if docs:
            yield flush()

    return run


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode and write all documents to the folder ``path``."""
    order = [F.col("doc_id"), F.left("text", F.lit(HEAD)), F.xxhash64("text")]
    spread = docs.select("doc_id", "text").repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order, "text")
    spread.mapInArrow(_records(tokenizer, end_id), RECORD_DDL).write.parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            part, record, n, docs, lengths, data = (batch.column(i)[r] for i in range(6))
            ids, per = pfor.unpack(data.as_py()).astype("<u4"), lengths.values.to_numpy()
            ends = np.cumsum(per)
            crc = [zlib.crc32(ids[e - w : e]) for e, w in zip(ends, per)]
            k = len(per)
            yield pa.record_batch({
                "part": pa.repeat(part, k), "record": pa.repeat(record, k), "doc_id": docs.values, "at": pa.array(ends - per), "n_tokens": pa.array(per), "ids_crc32": pa.array(crc, pa.int64()),
            })


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32.

    A record's first id is numbered in two steps, within its part and over the parts, so that the
    last sum has one row for each part.
    """
    files = spark.read.schema(RECORD_DDL).parquet(path)
    within = files.select("part", "record", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("record")) - F.col("n_ids")).alias("inside"))
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    base = within.join(before, "part").select("part", "record", (F.col("inside") + F.col("before")).alias("base"))
    docs = files.mapInArrow(_documents, "part int, record int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(base, ["part", "record"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str, tokenizer: str = public_tokenizers.path("byte_bpe_50k.json")) -> DataFrame:
    path = f"{shared_dir(prepared(spark)).rstrip('/')}/ids-{uuid.uuid4().hex}"
    write(documents(spark, sf_dir), path, tokenizer)
    return read_documents(spark, path)
