"""Byte-level BPE by a global shuffle of distinct words.

Encoding, with the documents in blocks (consecutive rows of a scan partition, BLOCK_BYTES of text):

1. A block numbers its distinct pre-tokens, most frequent first. Each is sent once to the owner of its group (by its hash), however
   often it stands in the block, packed with the block's other words of that group; and with them go the positions of
   the words in the block's documents, as compressed lists of numbers. The texts are read and pre-tokenised once.
2. Words meet by group, in whose task each distinct word is encoded once, by the rank file, and its ids replied to
   every block that asked. Positions pass through here.
3. Replies and positions meet by block, and ids are put in the words' places.

A frequent word comes once from each block, so no key is hot, and no task holds more than a block: BLOCK_BYTES, or one longer
text. The input must be a table or files, not a result that changes when a lost task reads it again.

Decoding looks the ids up in the token-byte table, whose size is that of the vocabulary, in every task.

Cases: null and empty texts have no ids and decode to no bytes; rows that share a doc_id, or have none, are encoded each; text in
any script round-trips, as every byte is a token; very long texts are worked on in parts; ids outside the vocabulary raise; other
columns are not returned, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import ChunkEncoder
from .common import column, documents, partitions, prepared, slices

BLOCK_BYTES = 32 << 20
#: Words of documents in one Arrow batch of results, or of positions; more only if a single document has more.
OUT_WORDS = 1 << 19
#: Groups of words by hash, for each partition: one group is encoded at a time.
GROUPS = 8
#: A row on its way to the owner of a group of words, and from there to where its block is put together. kind 0: words of the group,
#: later their ids (numbers of the words in the block, lengths, bytes or ids); kind 1: positions (numbers of words, words of each document).
ROW = pa.schema([("group", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("numbers", pa.binary()), ("counts", pa.binary()), ("values", pa.binary()), ("doc_ids", pa.list_(pa.int64()))])
ROW_DDL = "group long, block long, kind int, numbers binary, counts binary, values binary, doc_ids array<long>"


def ranks_of(path: str) -> dict[bytes, int]:
    """Token bytes to id, of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}


@lru_cache(maxsize=2)
def _coder(path: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of(path), special_tokens={})


def _squeezed(a: np.ndarray, level: int = 3) -> bytes:
    """Numbers as bytes: a plane for each byte that any of them needs, compressed."""
    a = a.astype("<u4")
    need = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, 4)[:, :need].T)
    return bytes([need]) + zstandard.ZstdCompressor(level=level).compress(planes.tobytes())


def _spread(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 4), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u4").ravel()


class _Block:
    """Distinct words of some documents, and the documents as numbers of words."""

    def __init__(self, number: int):
        self.number, self.size = number, 0
        self.words: dict[str, int] = {}
        self.rows: list[int] = []
        self.places: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        find = regex.compile(public_tokenizers.PATTERN).findall
        opens = bytearray()  # whether a word begins with a space

        def encode(chunks: list[str]) -> list[list[int]]:
            got = [[self.words.setdefault(w, len(self.words)) for w in find(c)] for c in chunks]
            fresh = [w[0] == " " for w, _ in zip(reversed(self.words), range(len(self.words) - len(opens)))]
            opens.extend(reversed(fresh))
            return got

        self.coder = ChunkEncoder(encode, lambda ids: np.frombuffer(bytes(opens), np.bool_)[ids])

    def add(self, rows: list[int], texts: list[str], size: int) -> None:
        self.rows += rows
        self.size += size
        got, per = self.coder.encoded(texts)
        self.places.append(got)
        self.counts.append(per)

    def close(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Words by number, all places, and the words of each document; numbers by frequency, then by word."""
        self.coder = None  # its memory goes before the sort
        places = np.concatenate(self.places) if self.places else np.zeros(0, np.uint32)
        words = [w.encode("utf-8", "surrogatepass") for w in self.words]
        often = np.bincount(places, minlength=len(words))
        order = sorted(range(len(words)), key=lambda i: (-often[i], words[i]))
        number = np.empty(len(words), np.uint32)
        number[order] = np.arange(len(words))
        return [words[i] for i in order], number[places] if len(words) else places, np.concatenate(self.counts)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    block, base = None, 0
    for batch in batches:
        if block is None:
            base = TaskContext.get().partitionId() << 16
            block = _Block(base)
        names, texts = column(batch, "doc_id"), column(batch, "text")
        for first, end, at, _ in slices(texts):
            block.add(names[first:end].to_pylist(), [t or "" for t in texts[first:end].to_pylist()], int(at[-1]))
            if block.size >= BLOCK_BYTES:
                yield block
                base += 1
                block = _Block(base)
    if block and block.rows:
        yield block


def _stretches(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Documents (first, end) of about OUT_WORDS words together."""
    ends, a = np.cumsum(counts), 0
    while a < len(counts):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] - counts[a] + OUT_WORDS, "right")))
        yield a, b
        a = b


def _row(*values) -> pa.RecordBatch:
    return pa.record_batch([pa.array([v], f.type) for v, f in zip(values, ROW)], schema=ROW)


def _asked(groups: int):
    """For each block the distinct words by group, and the positions of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            words, places, counts = block.close()
            to = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) % np.uint64(groups)
            order = np.argsort(to, kind="stable")
            cuts = np.flatnonzero(np.concatenate([[True], np.diff(to[order]) != 0])) if len(words) else np.zeros(0, np.int64)
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(words)]):
                own = order[a:b]
                some = [words[i] for i in own]
                sizes = np.fromiter(map(len, some), np.int64, len(some))
                yield _row(int(to[own[0]]), block.number, 0, _squeezed(np.diff(own, prepend=0)), _squeezed(sizes), zstandard.ZstdCompressor().compress(b"".join(some)), [])
            ends = np.cumsum(counts)
            for a, b in _stretches(counts):
                own = places[ends[a] - counts[a] : ends[b - 1]]
                yield _row(block.number, block.number, 1, _squeezed(own, 9), _squeezed(np.append(counts[a:b], len(words))), b"", block.rows[a:b])

    return run


def _replies(path: str):
    """Rows come sorted by group. A word met again in its group is not encoded again. Positions pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _coder(path)._encode_single_piece
        group, known = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                to, block, kind, numbers, counts, values = (batch.column(c)[i].as_py() for c in range(6))
                if kind == 1:
                    yield batch.slice(i, 1)
                    continue
                if to != group:
                    group, known = to, {}
                ends = np.cumsum(_spread(counts), dtype=np.int64).tolist()
                body = zstandard.ZstdDecompressor().decompress(values)
                found = []
                for a, b in zip([0, *ends], ends):
                    word = body[a:b]
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = encode(word)
                    found.append(ids)
                n = np.fromiter(map(len, found), np.int64, len(found))
                yield _row(to, block, 0, numbers, _squeezed(n), _squeezed(np.fromiter(chain.from_iterable(found), np.uint32, int(n.sum()))), [])

    return run


def _joined(replies: list[tuple[bytes, bytes, bytes]], n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many ids each word of a block has, where they begin, and all ids."""
    width, at = np.zeros(n_words, np.int64), np.zeros(n_words, np.int64)
    pool, size = [np.zeros(0, np.uint32)], 0
    for a, b, c in replies:
        own, n, ids = np.cumsum(_spread(a), dtype=np.int64), _spread(b).astype(np.int64), _spread(c)
        width[own] = n
        at[own] = np.cumsum(n) - n + size
        pool.append(ids)
        size += len(ids)
    if (width == 0).any():
        raise RuntimeError("a word has no reply: the documents changed while they were read again")
    return width, at, np.concatenate(pool)


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block, the replies before the positions."""
    block, replies, table = None, [], None
    for batch in batches:
        for i in range(batch.num_rows):
            number, kind, numbers, counts, values = (batch.column(c)[i].as_py() for c in range(1, 6))
            if number != block:
                block, replies, table = number, [], None
            if kind == 0:
                replies.append((numbers, counts, values))
                continue
            per = _spread(counts).astype(np.int64)
            per, n_words = per[:-1], int(per[-1])
            if table is None:
                table, replies = _joined(replies, n_words), []
            width, at, pool = table
            own = _spread(numbers)
            w = width[own]
            stop = np.concatenate([[0], np.cumsum(w)])
            take = np.arange(stop[-1]) + np.repeat(at[own] - stop[:-1], w)
            cuts = np.concatenate([[0], np.cumsum(per)])
            ids = pa.ListArray.from_arrays(pa.array(stop[cuts], pa.int32()), pa.array(pool[take].astype(np.int32)))
            yield pa.record_batch([batch.column(6)[i].values, ids], names=["doc_id", "ids"])


def encode(docs: DataFrame, ranks: str, decoded: bool = False) -> DataFrame:
    """doc_id and ids (array of int) of every document's text, by the rank file at ``ranks``; with the bytes they decode to if wanted."""
    given = docs.select("doc_id", "text")
    n = partitions(docs.sparkSession)
    asked = given.mapInArrow(_asked(GROUPS * n), ROW_DDL).repartition(n, "group").sortWithinPartitions("group")
    met = asked.mapInArrow(_replies(ranks), ROW_DDL).repartition(n, "block").sortWithinPartitions("block", "kind")
    if not decoded:
        return met.mapInArrow(_assemble, "doc_id long, ids array<int>")
    table = _decode(ranks)
    return met.mapInArrow(lambda batches: table(_assemble(batches)), "doc_id long, ids array<int>, decoded binary")  # both in one worker


@lru_cache(maxsize=2)
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and width of each id's bytes (width -1: no such id), and all bytes."""
    ranks = ranks_of(path)
    start, width = np.zeros(max(ranks.values()) + 1, np.int64), np.full(max(ranks.values()) + 1, -1)
    for token, rank in ranks.items():
        width[rank] = len(token)
    order = sorted(ranks, key=ranks.__getitem__)
    ends = np.cumsum([len(t) for t in order])
    start[[ranks[t] for t in order]] = ends - [len(t) for t in order]
    return start, width, np.frombuffer(b"".join(order), np.uint8)


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, width, table = _token_bytes(path)
        for batch in batches:
            ids = column(batch, "ids")
            flat = ids.flatten().to_numpy(zero_copy_only=False)
            if len(flat) and (flat.min() < 0 or flat.max() >= len(width) or (width[flat] < 0).any()):
                raise ValueError("an id is not in the vocabulary")
            per = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            w = width[flat]
            stop = np.concatenate([[0], np.cumsum(w)])
            out = table[np.arange(stop[-1]) + np.repeat(start[flat] - stop[:-1], w)]
            cuts = stop[np.concatenate([[0], np.cumsum(per)])]
            decoded = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(out)])
            yield pa.record_batch([*batch.columns, decoded], names=[*batch.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """encoded with ``decoded``: the bytes that its ``ids`` stand for."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(_decode(ranks), f"{schema}, decoded binary")


def digests(docs: DataFrame, ranks: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the bytes that they decode to; the ids as well if wanted."""
    both = encode(docs, ranks, decoded=True)
    return both.select(
        "doc_id", *["ids"] * ids, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def query(spark: SparkSession, sf_dir: str, ranks: str = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")) -> DataFrame:
    return digests(documents(prepared(spark), sf_dir), ranks)
