"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language in every task (one dense vector of ``buckets`` longs for a
language met), adds them up in Spark and turns the sums into a matrix of log probabilities. The
matrix has languages x buckets cells, whose number is checked before it is broadcast; it does not
grow with the rows. Scoring gathers matrix rows by bucket and adds them per text, in numpy.

Cases: a text that is null or has no letter is ``und`` with score 0; rows with null text or null
language are not learned from; a row without doc_id is not held out; repeated rows count as often as they occur; of languages with equal
scores the first by name wins; without a single row to learn from every text is ``und``; very long texts are counted and scored whole,
piece by piece; columns named in ``keep`` pass through, others are not read; an empty table gives an empty result. The matrix
has at most MATRIX_CELLS cells, 512 languages of BUCKETS each: more are refused, with the advice to take fewer buckets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, documents, prepared

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: languages x buckets of the broadcast matrix may not pass this; 64 MB as single floats.
MATRIX_CELLS = 1 << 24
SMOOTHING = 0.5
#: Code points that are worked on together.
PIECE = 1 << 18
LETTER = re.compile(r"[^\W\d_]")


def grams(points: np.ndarray, fresh: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and end position of each n-gram. ``fresh`` is where a text begins: no n-gram crosses it."""
    where, found = [], []
    index = np.arange(len(points))
    since = index - np.maximum.accumulate(np.where(fresh, index, 0))
    acc = np.zeros(len(points), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        # acc[i] covers the n characters that end at i
        acc[n - 1 :] = (acc[n - 2 : -1] if n > 1 else 0) * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :].astype(np.uint64) + np.uint64(n)
        if n in ORDERS:
            at = np.flatnonzero(since >= n - 1)
            h = acc[at] * np.uint64(0xD6E8FEB86659FD93)
            found.append(((h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % buckets)
            where.append(at)
    return np.concatenate(found), np.concatenate(where)


def _sparse(texts: list[str], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of all n-grams, slice by slice."""
    first = 0
    while first < len(texts):
        end, size = first + 1, len(texts[first])
        while end < len(texts) and size + len(texts[end]) <= PIECE:
            size += len(texts[end])
            end += 1
        lowered = [t.lower() for t in texts[first:end]]
        for a in range(0, max(1, len(lowered[0])) if end == first + 1 else 1, PIECE):
            back = min(a, max(ORDERS) - 1)
            part = [lowered[0][a - back : a + PIECE]] if end == first + 1 else lowered
            points = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
            if not len(points):
                continue
            lengths = np.array([len(t) for t in part])
            starts = np.cumsum(lengths) - lengths
            fresh = np.zeros(len(points), bool)
            fresh[starts[lengths > 0]] = True
            bucket, at = grams(points, fresh, buckets)
            if back:
                bucket, at = bucket[at >= back], at[at >= back]
            yield np.repeat(np.arange(first, end), lengths)[at], bucket
        first = end


def _counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            langs, texts = column(batch, "lang").to_pylist(), column(batch, "text").to_pylist()
            names = sorted(set(langs))
            code = np.array([names.index(x) for x in langs])
            for x in langs:
                docs[x] = docs.get(x, 0) + 1
            for row, bucket in _sparse(texts, buckets):
                for k in np.unique(code[row]):
                    if names[k] not in sums:
                        sums[names[k]] = np.zeros(buckets, np.int64)
                    sums[names[k]] += np.bincount(bucket[code[row] == k], minlength=buckets)
        for lang in sorted(docs):
            got = sums.get(lang, np.zeros(buckets, np.int64))
            at = np.flatnonzero(got)
            # Bucket -1 holds the number of documents.
            yield pa.record_batch({"lang": pa.array([lang] * (len(at) + 1), pa.string()), "bucket": pa.array(np.append(at, -1), pa.int32()), "n": pa.array(np.append(got[at], docs[lang]), pa.int64())})

    return run


def train(docs: DataFrame, buckets: int = BUCKETS) -> tuple[list[str], np.ndarray]:
    """Language names and the matrix (buckets + 1, languages) of log probabilities, the last row the priors."""
    known = docs.filter("text is not null and lang is not null").select("text", "lang")
    sums = known.mapInArrow(_counts(buckets), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    dense = (
        sums.groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("b"))  # at most buckets + 1 entries a language
        .select("lang", F.col("b.bucket").alias("bucket"), F.col("b.n").alias("n"))
    )
    rows = dense.limit(MATRIX_CELLS // buckets + 1).collect()
    if len(rows) * buckets > MATRIX_CELLS:
        raise ValueError(f"more than {MATRIX_CELLS // buckets} languages: the matrix would pass its bound; lower buckets")
    rows.sort(key=lambda r: r["lang"])
    names = [r["lang"] for r in rows]
    counts = np.zeros((buckets + 1, len(names)))
    for k, r in enumerate(rows):
        counts[np.array(r["bucket"]), k] = r["n"]  # -1: the last row
    if names:
        body = counts[:-1] + SMOOTHING
        counts = np.log(np.vstack([body / body.sum(0), counts[-1:] / counts[-1].sum()]))
    return names, counts.astype(np.float32)


def _predict(shared, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value
        for batch in batches:
            texts = [t or "" for t in column(batch, "text").to_pylist()]
            total = np.zeros((len(texts), len(names)))
            for row, bucket in _sparse(texts, buckets) if names else ():
                # n-grams of one row are not adjacent: orders follow each other
                order = np.argsort(row, kind="stable")
                row, bucket = row[order], bucket[order]
                cuts = np.flatnonzero(np.diff(row, prepend=-1))
                total[row[cuts]] += np.add.reduceat(matrix[bucket], cuts, axis=0, dtype=np.float64)
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            if names:
                total += matrix[-1]
                best = total.argmax(1)
                scores = 1 / np.exp(np.minimum(0, total - total.max(1, keepdims=True))).sum(1)
                clear = [bool(LETTER.search(t)) for t in texts]
                scores = np.where(clear, scores, 0.0)
                langs = [names[b] if c else "und" for b, c in zip(best, clear)]
            keep = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
            kept = [n for n in batch.schema.names if n != "text"]
            yield pa.record_batch([*keep, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*kept, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep``, with lang_pred and score, from ``text`` alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    given = docs.select(*keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name != "text")
    return given.mapInArrow(_predict(shared, len(model[1]) - 1), f"{schema}, lang_pred string, score double")


def held_out() -> Column:
    """Whether a document is kept out of training; one without doc_id is not."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(prepared(spark), sf_dir)
    model = train(docs.filter(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
