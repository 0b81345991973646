"""Bytes covered by long strings that occur again anywhere in the corpus, by a hash-compared suffix sort.

A suffix matters here only by its first LENGTH bytes, its window: what begins two equal windows is removed. Windows are
brought together by content, compared where they meet:

1. Of the GRAM-byte strings in every window, the one with the least hash is the window's anchor (one in about 150
   bytes). Equal windows have equal anchors at equal offsets, so a window can repeat only if its anchor's gram does. Grams are
   counted over all texts; most are single and end here.
2. The context of an anchor is all bytes of windows around it. Anchors that share gram and context, by a 128-bit BLAKE2b digest
   of its bytes, repeat as a whole. One of each different context of a gram goes on, with its bytes.
3. The suffixes of a gram's contexts meet in one task and are sorted there (see ``suffixes``): a merge sort whose comparisons
   find the common extension of two suffixes by binary search over prefix polynomial hashes. Neighbours that share LENGTH bytes
   repeat, once their bytes have been compared.
4. A gram with more contexts than a task should hold is split in two by the bytes beyond it: windows that reach far to its left
   hold GRAM and more bytes there, the others to its right. Each half is a longer string, which fewer contexts share; equal halves
   repeat as a whole and go on as one. Halves are split again until few meet, or until they are whole windows, which need no
   comparison. So no task holds more than GROUP contexts.

Cases: null and empty texts have no bytes; texts shorter than LENGTH keep all theirs; equal rows are copies of each other and both
lose what they share; rows are told apart by doc_id and text, null doc_ids included; matches never cross documents, may
overlap themselves, and are judged on the input; very long texts are worked on in overlapping pieces; other columns are not
returned, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, documents, prepared, raw, slices, stored
from .shingles import mixed, powers
from .suffixes import repeating

LENGTH, GRAM = 400, 128
REACH = LENGTH - GRAM
#: Bytes of text whose hashes a task holds together.
SLICE = 1 << 18
#: Contexts of one group of suffixes, and bytes that are sorted together.
GROUP, TOGETHER = 1024, 1 << 20
_BYTE = mixed(np.arange(256, dtype=np.uint64))
_BACK = pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_back = np.ones(1, np.uint64)

ANCHORS = "gram long, c1 long, c2 long, doc_id long, th long, pos int, hi int, first int, n int"
#: A context in a group k1, k2 of windows that have their anchor at offsets from ``least`` to ``most``: its windows (place of the first in the
#: text, their number), their bytes, and where in them the anchor is.
CONTEXTS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("least", pa.int32()), ("most", pa.int32()), ("doc_id", pa.int64()), ("th", pa.int64()), ("first", pa.int32()), ("n", pa.int32()), ("off", pa.int32()), ("body", pa.binary())])
HALVES = CONTEXTS.append(pa.field("c1", pa.int64())).append(pa.field("c2", pa.int64()))
CONTEXTS_DDL = "k1 long, k2 long, least int, most int, doc_id long, th long, first int, n int, off int, body binary"


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Of every GRAM bytes: they only choose anchors, so a collision costs a comparison and no more."""
    global _back
    n = len(data)
    if len(_back) <= n:
        steps = np.full(2 * n + 2, _BACK, np.uint64)
        steps[0] = 1
        _back = np.cumprod(steps, dtype=np.uint64)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(n), dtype=np.uint64, out=prefix[1:])
    m = n - GRAM + 1
    return mixed((prefix[GRAM:] - prefix[:m]) * _back[:m])


def _digest(*parts) -> tuple[int, int]:
    h = hashlib.blake2b(digest_size=16)
    for p in parts:
        h.update(p)
    d = h.digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _anchors(at: np.ndarray, data: np.ndarray) -> dict[str, np.ndarray] | None:
    """Anchors of the rows in the bytes, with the run of windows that each is chosen by."""
    windows = len(data) - LENGTH + 1
    if windows <= 0 or not (np.diff(at) >= LENGTH).any():
        return None
    gram = _gram_hashes(data)
    # The least hash, and of equal ones the first: high bits of the hash, then the place.
    least = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    size = 1
    while 2 * size <= REACH + 1:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[:windows], least[REACH + 1 - size : REACH + 1 - size + windows])
    starts = np.flatnonzero(np.arange(windows) + LENGTH <= at[np.searchsorted(at, np.arange(windows), "right")])
    pos = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    run = np.flatnonzero(np.concatenate([[True], np.diff(pos) != 0]))
    pos, first, n = pos[run], starts[run], np.diff(np.append(run, len(starts)))
    row = np.searchsorted(at, pos, "right") - 1
    base = at[row]
    return {"row": row, "gram": gram[pos].view(np.int64), "pos": pos - base, "hi": np.minimum(pos + LENGTH, at[row + 1]) - base, "first": first - base, "n": n}


def _with_context(found: dict[str, np.ndarray], base: np.ndarray, data: np.ndarray) -> dict[str, np.ndarray]:
    """Adds the digest of each anchor's context, told apart by where in it the anchor is."""
    view = memoryview(data)
    lo = np.maximum(found["pos"] - REACH, 0)
    blake = hashlib.blake2b
    both = b"".join([blake(view[a:b], digest_size=16).digest() for a, b in zip((base + lo).tolist(), (base + found["hi"]).tolist())])
    halves = np.frombuffer(both, np.int64).reshape(-1, 2)
    return found | {"c1": halves[:, 0] ^ mixed((found["pos"] - lo).astype(np.uint64)).view(np.int64), "c2": halves[:, 1]}


def _pieces(at: np.ndarray, data: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
    """Anchors of a slice; of one long row piece by piece, each with all bytes that decide on the anchors in it."""
    if len(at) > 2 or len(data) <= 2 * SLICE:
        if (found := _anchors(at, data)) and len(found["row"]):
            yield _with_context(found, at[found["row"]], data)
        return
    for a in range(0, len(data), SLICE):
        lo, hi = max(0, a - REACH), min(len(data), a + SLICE + LENGTH)
        found = _anchors(np.array([0, hi - lo]), data[lo:hi])
        if not found:
            continue
        own = np.flatnonzero((found["pos"] + lo >= a) & (found["pos"] + lo < a + SLICE))
        if len(own):
            moved = {k: v[own] + lo if k in ("pos", "hi", "first") else v[own] for k, v in found.items()}
            yield _with_context(moved, np.zeros(len(own), np.int64), data)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, ths = column(batch, "doc_id"), column(batch, "th")
        for start, _, at, data in slices(column(batch, "text"), SLICE):
            for found in _pieces(at, data):
                rows = pa.array(found["row"] + start)
                yield pa.record_batch({
                    "gram": pa.array(found["gram"]), "c1": pa.array(found["c1"]), "c2": pa.array(found["c2"]), "doc_id": ids.take(rows), "th": ths.take(rows),
                    **{k: pa.array(found[k].astype(np.int32)) for k in ("pos", "hi", "first", "n")},
                })


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each context of the texts, with the bytes of its windows."""
    for batch in batches:
        at, data = raw(column(batch, "text"))
        docs, ths = column(batch, "doc_id").to_pylist(), column(batch, "th").to_pylist()
        for i, runs in enumerate(column(batch, "runs").to_pylist()):
            rows = []
            for r in runs:
                a = int(at[i]) + r["first"]
                off = r["pos"] - r["first"]
                rows.append((r["gram"], 0, 0, REACH, docs[i], ths[i], r["first"], r["n"], off, data[a : a + r["n"] + LENGTH - 1].tobytes()))
            yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*rows), CONTEXTS)], schema=CONTEXTS)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each context in up to two rows: windows that begin near the anchor, and those that begin far before it.

    An anchor at offset d of a window lies d bytes after its start. All windows with offsets from ``least`` to ``most`` hold
    the bytes from ``least`` before the anchor to LENGTH - ``most`` after it; their digest is the key of the new group.
    """
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            middle = (r["least"] + r["most"]) // 2
            for least, most in ((r["least"], middle), (middle + 1, r["most"])):
                # Windows begin at off - d in the body.
                a, b = max(0, r["off"] - most), min(r["n"] - 1, r["off"] - least)
                if a > b:
                    continue
                fixed = r["body"][r["off"] - least : r["off"] - most + LENGTH]
                key = _digest(bytes([least >> 8, least & 255, most >> 8, most & 255]), fixed)
                off, body = r["off"] - a, r["body"][a : b + LENGTH]
                # off is below 2 * LENGTH.
                rows.append((*key, least, most, r["doc_id"], r["th"], r["first"] + a, b - a + 1, off, body, *_digest(bytes([off >> 8, off & 255]), body)))
        if rows:
            yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*rows), HALVES)], schema=HALVES)


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group: as many whole groups together as TOGETHER bytes hold, one at least."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        k1, k2 = column(batch, "k1").to_numpy(), column(batch, "k2").to_numpy()
        at, _ = raw(column(batch, "body"))
        ends = np.flatnonzero((np.diff(k1) != 0) | (np.diff(k2) != 0)) + 1
        if last is not None and last != (k1[0], k2[0]):
            ends = np.concatenate([[0], ends])
        begin = 0
        for e in ends.tolist():
            if size + at[e] - at[begin] >= TOGETHER:
                held.append(batch.slice(begin, e - begin))
                yield from _covered(held)
                held, size, begin = [], 0, e
        held.append(batch.slice(begin))
        size += at[-1] - at[begin]
        last = (k1[-1], k2[-1])
    yield from _covered(held)


def _covered(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intervals of the texts that repeating windows of these contexts cover."""
    rows = pa.Table.from_batches(held, CONTEXTS).combine_chunks() if held else None
    if rows is None or rows.num_rows < 2:
        return
    batch = rows.to_batches()[0]
    k1, k2 = column(batch, "k1").to_numpy(), column(batch, "k2").to_numpy()
    group = np.cumsum(np.concatenate([[False], (np.diff(k1) != 0) | (np.diff(k2) != 0)]))
    n, off = column(batch, "n").to_numpy().astype(np.int64), column(batch, "off").to_numpy().astype(np.int64)
    at, data = raw(column(batch, "body"))
    data, at = data[at[0] : at[-1]], at - at[0]
    # Contexts alone in their group have nothing to meet.
    some = np.flatnonzero(np.bincount(group)[group] > 1)
    of = np.repeat(some, n[some])
    inside = np.arange(len(of)) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
    hit = repeating(data, at[of] + inside, group[of] * LENGTH + off[of] - inside, LENGTH)
    of, start = of[hit], inside[hit]
    if not len(of):
        return
    # Neighbouring windows of one context cover one interval.
    begin = np.flatnonzero(np.concatenate([[True], (np.diff(of) != 0) | (np.diff(start) > LENGTH)]))
    end = np.append(begin[1:], len(of)) - 1
    first = column(batch, "first").to_numpy()[of[begin]]
    own = pa.array(of[begin])
    yield pa.record_batch({
        "doc_id": column(batch, "doc_id").take(own), "th": column(batch, "th").take(own),
        "lo": pa.array((first + start[begin]).astype(np.int32)), "hi": pa.array((first + start[end] + LENGTH).astype(np.int32)),
    })


def _compared(rows: DataFrame) -> DataFrame:
    """(doc_id, th, lo, hi) of repeating windows of contexts, group by group; large groups are split first."""
    ready, whole = [], []
    while True:
        sizes = stored(rows.groupBy("k1", "k2", "least", "most").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
        large = sizes.filter(F.col("size") > GROUP).select("k1", "k2")
        if large.isEmpty():
            ready.append(rows)
            break
        key = ["k1", "k2"]
        ready.append(rows.join(sizes.filter(F.col("size") <= GROUP).select(*key).hint("shuffle_merge"), key, "left_semi"))
        left = rows.join(large.hint("shuffle_merge"), key, "left_semi")
        # Contexts of a whole window are equal by the key.
        whole.append(left.filter("least = most").select("doc_id", "th", F.col("first").alias("lo"), (F.col("first") + LENGTH).alias("hi")))
        halves = stored(left.filter("least < most").mapInArrow(_split, f"{CONTEXTS_DDL}, c1 long, c2 long"), "halves")
        # Halves that are equal repeat as a whole, like contexts, and one of them stands for all.
        same = [*key, "c1", "c2"]
        again = stored(halves.groupBy(*same).agg(F.count("*").alias("times")).filter("times > 1").select(*same), "again")
        whole.append(halves.join(again.hint("shuffle_merge"), same, "left_semi").select("doc_id", "th", F.col("first").alias("lo"), (F.col("first") + F.col("n") - 1 + LENGTH).alias("hi")))
        rows = stored(halves.dropDuplicates(same).select(*CONTEXTS.names), "different")
    groups = reduce(DataFrame.unionByName, [r.select(*CONTEXTS.names) for r in ready])
    found = groups.repartition("k1", "k2").sortWithinPartitions("k1", "k2").mapInArrow(_sorted_groups, "doc_id long, th long, lo int, hi int")
    return reduce(DataFrame.union, whole, found)


def intervals(docs: DataFrame) -> DataFrame:
    """(doc_id, th, parts): ranges (lo, hi) of repeated bytes of each text that has any, which may overlap. docs: doc_id, text and th, the text's hash."""
    anchors = stored(docs.mapInArrow(_find, ANCHORS), "anchors")
    differ = (F.min("c1") != F.max("c1")) | (F.min("c2") != F.max("c2"))
    grams = anchors.groupBy("gram").agg(F.count("*").alias("times"), differ.alias("open")).filter("times > 1").select("gram", "open")
    grams = stored(grams, "grams")
    suspects = stored(anchors.join(grams.hint("shuffle_merge"), "gram"), "suspects")
    lo = F.greatest(F.col("pos") - REACH, F.lit(0)).alias("lo")
    whole = suspects.filter("not open").select("doc_id", "th", lo, "hi")
    opened = suspects.filter("open")
    key = ["gram", "c1", "c2"]
    # Any of the equal contexts stands for them all, and all columns are of one row.
    contexts = opened.groupBy(*key).agg(F.count("*").alias("times"), *[F.first(c).alias(c) for c in ("doc_id", "th", "pos", "first", "n")])
    contexts = stored(contexts, "contexts")
    again = contexts.filter("times > 1").select(*key)
    whole = whole.union(opened.join(again.hint("shuffle_merge"), key, "left_semi").select("doc_id", "th", lo, "hi"))
    # What is left over is compared with one of each other context of its gram.
    single = contexts.groupBy("gram").agg(F.min("times").alias("least")).filter("least = 1").select("gram")
    runs = contexts.join(single.hint("shuffle_merge"), "gram", "left_semi").groupBy("doc_id", "th").agg(F.collect_list(F.struct("gram", "pos", "first", "n")).alias("runs"))
    runs = runs.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "runs").hint("shuffle_merge")
    texts = docs.join(runs, docs["doc_id"].eqNullSafe(runs["d"]) & (docs["th"] == runs["t"])).select("doc_id", "th", "text", "runs")
    edges = _compared(stored(texts.mapInArrow(_cut, CONTEXTS_DDL), "bodies"))
    return whole.union(edges).groupBy("doc_id", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("parts"))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, data = raw(column(batch, "text"))
        kept, spans = [], []
        parts = column(batch, "parts")
        for i in range(batch.num_rows):
            whole = data[at[i] : at[i + 1]]
            if not parts[i].is_valid:
                kept.append(whole.tobytes())
                spans.append(None)
                continue
            own = parts[i].values
            lo, hi = own.field(0).to_numpy(), own.field(1).to_numpy()
            order = np.argsort(lo, kind="stable")
            lo, hi = lo[order], np.maximum.accumulate(hi[order])
            new = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
            begin, end = lo[new], hi[np.append(new[1:], len(hi)) - 1]
            spans.append([{"lo": int(a), "hi": int(b)} for a, b in zip(begin, end)])
            kept.append(b"".join(whole[a:b].tobytes() for a, b in zip(np.append(0, end), np.append(begin, len(whole)))))
        spans = pa.array(spans, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))
        yield pa.record_batch([column(batch, "doc_id"), pa.array(np.diff(at)), spans, pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (array of lo, hi; null without any), kept (binary: the bytes outside them)."""
    given = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    found = intervals(given).select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "parts").hint("shuffle_merge")
    both = given.join(found, given["doc_id"].eqNullSafe(found["d"]) & (given["th"] == found["t"]), "left")
    return both.select("doc_id", "text", "parts").mapInArrow(_remove, "doc_id long, n_bytes long, spans array<struct<lo:long,hi:long>>, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest columns, and what is left: its bytes' number and, with U+FFFD for characters that were cut, its text."""
    out = remove_repeats(documents(prepared(spark), sf_dir))
    n = F.expr("aggregate(coalesce(spans, array()), 0L, (a, s) -> a + s.hi - s.lo)")
    return out.select(
        "doc_id", "n_bytes", n.alias("n_removed"), F.expr("bigint(coalesce(size(spans), 0))").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        F.length("kept").cast("long").alias("n_kept"), F.expr("make_valid_utf8(cast(kept as string))").alias("kept_text"),
    )
