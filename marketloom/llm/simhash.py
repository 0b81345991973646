"""Near-duplicates by SimHash, their candidates found by the pigeonring principle.

A fingerprint has 64 bits: of the XXH64 hashes of all word shingles, bit j is 1 if it is set in over half of them. Two
fingerprints link where at most DISTANCE bits differ.

The bits stand on a ring of SEGMENTS segments. If the differences of all segments come to at most DISTANCE, some segment starts
a chain in which every first l segments differ in at most l * DISTANCE / SEGMENTS bits (else the ring could be cut into
stretches that are all over their part of the budget). With five segments and two bits the budgets of a chain are 0, 0, 1, 1, 2:
its first two segments, some 25 bits, are equal, which makes them the key of a bucket, one for each start; the third and fourth
segment then differ in one bit at most. A pair of a bucket that breaks a budget falls out before its full distance is taken.

Only distinct fingerprints are compared, so a text with a billion copies is one of them. The fingerprints of a bucket of at most
PAIRED members meet in a join on the key, whose condition holds the budgets. Members of larger buckets are not paired: each is
sent to the 65 fingerprints within one bit of it, and those that meet at one of these links to the least there. Two fingerprints are within two
bits of each other just when they share such a neighbour, so this is exact, and linear however large a bucket is.

Cases: null and empty texts, and those without words, have fingerprint zero, which links like any other; a text of one or two words has its
whole sequence as its one shingle; rows are what is linked, so rows that share a doc_id but not a fingerprint are linked only
as their fingerprints are; a row without doc_id has its component's least doc_id, or null where no row has one; repeated rows keep
one result each; very long texts are hashed piece by piece; other columns are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, column, documents, prepared, slices, small_or_not, stored
from .components import components
from .shingles import words_apart

SHINGLE, SEED = 3, 42
BITS, DISTANCE, SEGMENTS = 64, 2, 5
#: Members of a bucket that are compared with each other.
PAIRED = 128
#: Where each segment begins on the ring, and its end.
CUTS = [BITS * i // SEGMENTS for i in range(SEGMENTS + 1)]
_digest = partial(xxhash.xxh64_intdigest, seed=SEED)


def _hashes(joined: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return np.fromiter(map(_digest, map(joined.__getitem__, map(slice, start.tolist(), end.tolist()))), np.uint64, len(start))


def _bits(hashes: np.ndarray) -> np.ndarray:
    """(hashes, 64) zeros and ones, the lowest bit first."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _majority(ones: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Fingerprints from counts of ones a bit, and the number of hashes they were counted in."""
    return np.packbits(2 * ones > of[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _long_text(data: np.ndarray, k: int, piece: int) -> int:
    """The fingerprint of one text, of which a piece at a time is taken apart."""
    ones, n, held, at = np.zeros(BITS, np.int64), 0, b"", 0
    space = np.frombuffer(b" \t\n\v\f\r", np.uint8)
    while at < len(data):
        end = min(len(data), at + piece)
        while end < len(data) and data[end] not in space:  # words stay whole
            step = data[end : end + piece]
            stop = np.flatnonzero(np.isin(step, space))
            end += int(stop[0]) if len(stop) else len(step)
        part = np.concatenate([np.frombuffer(held, np.uint8), data[at:end]])
        joined, start, size, _ = words_apart(np.array([0, len(part)]), part)
        if len(start) >= k:
            h = _hashes(joined, start[: len(start) - k + 1], start[k - 1 :] + size[k - 1 :])
            ones += _bits(h).sum(axis=0, dtype=np.int64)
            n += len(h)
            held = joined[start[len(start) - k + 1] :] if k > 1 else b""
        else:
            held = joined
        at = end
    if not n and held:
        ones, n = _bits(np.array([_digest(held.rstrip(b" "))], np.uint64))[0].astype(np.int64), 1
    return int(_majority(ones[None, :], np.array([n]))[0])


def fingerprints_of(texts: pa.Array, k: int = SHINGLE, piece: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, fingerprints of the rows from it on), slice by slice."""
    for first, end, at, data in slices(texts, piece):
        if end == first + 1 and len(data) > piece:
            yield first, np.array([_long_text(data, k, piece)], np.uint64)
            continue
        joined, start, size, row = words_apart(at, data)
        words = np.diff(np.searchsorted(row, np.arange(end - first + 1)))
        each = np.where(words >= k, words - k + 1, np.minimum(words, 1))  # shingles of a row
        head = np.repeat(np.cumsum(words) - words, each)
        inside = np.arange(len(head)) - np.repeat(np.cumsum(each) - each, each)
        last = head + inside + np.minimum(np.repeat(words, each), k) - 1
        hashes = _hashes(joined, start[head + inside], start[last] + size[last])
        ones = np.zeros((end - first, BITS), np.int64)
        some = np.flatnonzero(each)
        if len(some):
            ones[some] = np.add.reduceat(_bits(hashes), (np.cumsum(each) - each)[some], axis=0, dtype=np.int64)
        yield first, _majority(ones, each)


def _prints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = column(batch, "doc_id")
            for first, prints in fingerprints_of(column(batch, "text"), k):
                yield pa.record_batch({"doc_id": ids[first : first + len(prints)], "print": pa.array(prints.view(np.int64))})

    return run


def _turned(print_: Column, start: int) -> Column:
    """The ring read from the start of a segment on, segments counted from the highest bit down."""
    at = CUTS[start]
    return print_ if not at else F.shiftleft(print_, at).bitwiseOR(F.shiftrightunsigned(print_, BITS - at))


def _width(start: int, length: int) -> int:
    """Bits of the first so many segments from ``start`` on."""
    return sum(CUTS[s + 1] - CUTS[s] for s in ((start + i) % SEGMENTS for i in range(length)))


def clean(distance: int = DISTANCE) -> int:
    """Segments at the head of a chain whose budget is less than one bit."""
    return max(n for n in range(1, SEGMENTS + 1) if n * distance < SEGMENTS)


def budgets(distance: int = DISTANCE) -> Column:
    """Whether the differences of ``ta`` and ``tb``, read from the segment ``start`` on, keep to the budget of each length of chain beyond the equal head."""
    held = F.lit(True)
    for n in range(clean(distance) + 1, SEGMENTS):
        below = ", ".join(str(BITS - _width(s, n)) for s in range(SEGMENTS))
        held = held & F.expr(f"bit_count(shiftrightunsigned(ta ^ tb, element_at(array({below}), start + 1))) <= {n * distance // SEGMENTS}")
    return held


def links(distinct: DataFrame, distance: int = DISTANCE, paired: int = PAIRED) -> DataFrame:
    """Links (a, b) between the distinct fingerprints (print) with the same components as all pairs within ``distance``, which is at most two."""
    if not 1 <= distance <= 2:
        raise ValueError("neighbourhoods of one bit meet within two bits")
    head = clean(distance)
    starts = [(s, _turned(F.col("print"), s)) for s in range(SEGMENTS)]
    chains = F.array(*[F.struct(F.lit(s).alias("start"), t.alias("turned"), F.shiftrightunsigned(t, BITS - _width(s, head)).alias("head")) for s, t in starts])
    rows = distinct.select("print", F.explode(chains).alias("r")).select("print", "r.start", "r.turned", "r.head")
    buckets = stored(rows.groupBy("start", "head").agg(F.count("*").alias("members")).filter("members > 1"), "buckets")
    members = stored(rows.join(small_or_not(buckets, buckets.count(), 24), ["start", "head"]), "members")
    few = members.filter(F.col("members") <= paired)
    a = few.select("start", "head", F.col("turned").alias("ta"), F.col("print").alias("a"))
    b = few.select(F.col("start").alias("start_"), F.col("head").alias("head_"), F.col("turned").alias("tb"), F.col("print").alias("b"))
    met = a.join(b, (F.col("start") == F.col("start_")) & (F.col("head") == F.col("head_")) & (F.col("a") < F.col("b")) & budgets(distance))
    pairs = met.filter(F.expr(f"bit_count(a ^ b) <= {distance}")).select("a", "b")
    wide = members.filter(F.col("members") > paired).select("print").distinct()
    return pairs.union(meetings(wide, distance))


def meetings(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links between fingerprints that share a neighbour within one bit (with a distance of 1: that are neighbours), without pairing them."""
    one = F.lit(1).cast("long")
    flips = F.array(F.lit(0).cast("long"), *[F.shiftleft(one, i) for i in range(BITS)])
    around = prints.select("print", F.explode(flips).alias("flip")).select("print", F.col("print").bitwiseXOR(F.col("flip")).alias("meets"))
    if distance == 1:
        own = prints.select(F.col("print").alias("meets"))
        return around.join(own, "meets").filter("print < meets").select(F.col("print").alias("a"), F.col("meets").alias("b"))
    groups = around.groupBy("meets").agg(F.min("print").alias("a"), F.collect_list("print").alias("every")).filter("size(every) > 1")
    return groups.select("a", F.explode("every").alias("b")).filter("a <> b")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, paired: int = PAIRED) -> DataFrame:
    """One row per document: doc_id, fingerprint in hexadecimal, component_id."""
    prints = stored(docs.select("doc_id", "text").mapInArrow(_prints(shingle), "doc_id long, print long"), "prints")
    distinct = stored(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct")
    label = components(stored(links(distinct.select("print"), distance, paired), "links"))
    linked = distinct.join(label, distinct["print"] == label["v"], "left").select("print", "least", F.coalesce("label", "print").alias("label"))
    least = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = stored(linked.select("print", "label").join(least, "label").select(F.col("print").alias("own"), "component_id"), "classes")
    near = small_or_not(classes, classes.count(), 16)
    out = prints.join(near, prints["print"] == near["own"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(prepared(spark), sf_dir))
