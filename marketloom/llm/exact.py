"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. Every task hashes its texts to 64 bits, sorts the hashes, cuts them by owner (the hash range) and
   sends each owner one compressed message: about two bits over the log of the mean gap for a text.
2. An owner decodes its messages and returns, for each, a bitmap of the hashes that occur again.
3. Only suspects move as text: those whose bit is set are grouped by their bytes (combined before the
   shuffle, so a text with a billion copies is one row of each task), which also proves equality.

Messages hold no text, and bitmaps one bit a document. The messages with their document ids are a
small table in the shared folder, so a lost executor repeats no decision.

Cases: null text counts as empty and equals it; rows that share doc_id and text are copies of each
other and have one decision (each says kept); a null doc_id is lower than any
other; very long texts are hashed and grouped whole; columns of the input besides doc_id and text are not read by ``duplicates``,
whatever their names, and are kept by ``drop_duplicates``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import golomb
from .common import column, documents, partitions, prepared, small_or_not, stored

#: A message is sent when a task has hashed so many texts, so its memory is bounded.
ROUND_ROWS = 1 << 17
#: Fingerprints that one owner holds, 8 bytes each.
OWNER_ROWS = 1 << 22
MESSAGES = pa.schema([("sender", pa.int64()), ("owner", pa.int32()), ("n", pa.int32()), ("k", pa.int32()), ("code", pa.binary()), ("ids", pa.list_(pa.int64())), ("sure", pa.list_(pa.int64()))])
BITMAPS = pa.schema([("sender", pa.int64()), ("owner", pa.int32()), ("hits", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _messages(owners: int):
    def send(ids: list, prints: list, round_no: int) -> pa.RecordBatch:
        fp = np.array(prints, np.uint64)
        order = np.argsort(fp, kind="stable")
        fp, given = fp[order], [ids[i] for i in order]
        # A hash that this task has met twice is sent once, and its rows are suspects without asking.
        fp, first, times = np.unique(fp, return_index=True, return_counts=True)
        ids = [given[a] if n == 1 else None for a, n in zip(first, times)]
        owner = ((fp >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)
        cuts = np.searchsorted(owner, np.arange(owners + 1))
        rows = []
        for o in np.unique(owner):
            a, b = cuts[o], cuts[o + 1]
            # The lower end of an owner's range is known to it, so codes count from there.
            k, code = golomb.encode(fp[a:b] - np.uint64(low_of(int(o), owners)))
            sure = [given[j] for i in np.flatnonzero(times[a:b] > 1) + a for j in range(first[i], first[i] + times[i])]
            rows.append((TaskContext.get().partitionId() << 20 | round_no, int(o), int(b - a), k, code, ids[a:b], sure))
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), MESSAGES)], schema=MESSAGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, prints, round_no = [], [], 0
        for batch in batches:
            ids += column(batch, "doc_id").to_pylist()
            prints += [xxhash.xxh3_64_intdigest(t.as_buffer() if t.is_valid else b"") for t in column(batch, "text").cast(pa.large_binary())]
            if len(ids) >= ROUND_ROWS:
                yield send(ids, prints, round_no)
                ids, prints, round_no = [], [], round_no + 1
        if ids:
            yield send(ids, prints, round_no)

    return run


def low_of(owner: int, owners: int) -> int:
    """The least fingerprint whose high half is dealt to this owner."""
    return -(-(owner << 32) // owners) << 32


def _bitmaps(owners: int):
    """Per owner: first the rows that came for it, then a bitmap for each. Only codes are held."""

    def answer(rows: list[dict]) -> pa.RecordBatch:
        each = [golomb.decode(r["n"], r["k"], r["code"]) for r in rows]
        got = np.concatenate(each)
        values, counts = np.unique(got, return_counts=True)
        again = values[counts > 1]
        hits = []
        for fp in each:
            at = np.minimum(np.searchsorted(again, fp), max(0, len(again) - 1))
            hits.append(np.packbits(again[at] == fp if len(again) else np.zeros(len(fp), bool), bitorder="little").tobytes())
        return pa.record_batch([pa.array([r["sender"] for r in rows], pa.int64()), pa.array([r["owner"] for r in rows], pa.int32()), pa.array(hits, pa.binary())], schema=BITMAPS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []  # of one owner: rows arrive sorted by it
        for batch in batches:
            for r in batch.to_pylist():
                if rows and rows[0]["owner"] != r["owner"]:
                    yield answer(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield answer(rows)

    return run


def suspects(docs: DataFrame, owners: int | None = None) -> DataFrame:
    """doc_id of the rows whose fingerprint occurs more than once.

    owners: ranges of fingerprints. By default the session's shuffle partitions, and more where an owner would hold more than
    OWNER_ROWS of the counted rows.
    """
    owners = owners or max(partitions(docs.sparkSession), -(-docs.count() // OWNER_ROWS))
    sent = stored(docs.select("doc_id", "text").mapInArrow(_messages(owners), _ddl(MESSAGES)), "messages")
    answers = (
        sent.select("sender", "owner", "n", "k", "code")
        .repartition(owners, "owner")
        .sortWithinPartitions("owner")
        .mapInArrow(_bitmaps(owners), _ddl(BITMAPS))
    )
    bit = "(get(bytes, i div 8) >> (i % 8)) & 1"
    local = sent.select(F.explode("sure").alias("doc_id"))
    return (
        sent.select("sender", "owner", "ids")
        .join(answers, ["sender", "owner"])
        .select(F.expr("ids"), F.expr("transform(sequence(0, length(hits) - 1), i -> cast(conv(hex(substring(hits, i + 1, 1)), 16, 10) as int))").alias("bytes"))
        .select(F.explode(F.expr(f"filter(ids, (d, i) -> {bit} = 1)")).alias("doc_id"))
        .union(local)
        .distinct()
    )


def duplicates(docs: DataFrame, owners: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id (largest doc_id with that text), group_size, kept, text_sha256."""
    docs = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = stored(suspects(docs, owners), "suspects")
    near = small_or_not(found.withColumnRenamed("doc_id", "suspect"), found.count(), 16)
    texts = docs.join(near, docs["doc_id"].eqNullSafe(near["suspect"]), "left_semi")
    # Grouping by the text compares bytes; the digest only names the group afterwards.
    groups = (
        texts.groupBy("text").agg(F.max("doc_id").alias("most"), F.count("*").alias("copies"))
        .filter("copies > 1")
        .select(F.sha2("text", 256).alias("text_sha256"), "most", "copies")
    )
    # One row a group: broadcast while they are few; else a merge join, in which Spark cuts the partition of a hot text.
    groups = stored(groups, "groups")
    groups = small_or_not(groups, groups.count(), 120)
    own = docs.select("doc_id", F.sha2("text", 256).alias("text_sha256"))
    out = own.join(groups, "text_sha256", "left")
    keep = F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("most"))
    return out.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256",
    )


def drop_duplicates(docs: DataFrame, owners: int | None = None, whole: bool = False) -> DataFrame:
    """docs without the rows whose text another row with a larger doc_id has; ``whole`` also leaves one of equal (doc_id, text) rows."""
    found = stored(duplicates(docs, owners).filter("group_size > 1").select("doc_id", "text_sha256", "kept"), "found")

    def same(rows: DataFrame) -> tuple[DataFrame, Column]:
        near = small_or_not(rows.select(F.col("doc_id").alias("gone"), F.col("text_sha256").alias("gone_sha")), rows.count(), 96)
        return near, docs["doc_id"].eqNullSafe(near["gone"]) & (F.sha2(F.coalesce(docs["text"], F.lit("")), 256) == near["gone_sha"])

    left = docs.join(*same(found.filter("not kept")), "left_anti")
    if not whole:
        return left
    again = stored(found.filter("kept").groupBy("doc_id", "text_sha256").count().filter("count > 1"), "again")
    if again.isEmpty():
        return left
    one = docs.join(*same(again), "left_semi").withColumn("_null", F.expr("coalesce(text, '')")).dropDuplicates(["doc_id", "_null"]).drop("_null")
    return left.join(*same(again), "left_anti").unionByName(one)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(documents(prepared(spark), sf_dir))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
