"""Encoding with a byte-level BPE by distinct chunks.

Texts are cut where a single space stands between two characters that are no white space. There the
pre-tokenizer always ends a piece before the space, whatever surrounds it, so the ids of the chunks
(each but a text's first with its leading space) joined are the ids of the text. Special tokens hold
no space. Equal chunks are encoded once, by the library itself, many new ones in one call: joined by
their spaces they are again a text that may be cut there.

Long texts are worked on in parts that end at such a space, so that what a task holds beside the text
and its ids does not grow with the text (a run without any such space is one part).
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator, Sequence
from itertools import chain, repeat

import numpy as np

SAFE = re.compile(r"(?<=\S) (?=\S)")
#: White space besides the space and the line feed.
OTHER_SPACE = re.compile(r"[^\S \n]")
#: A worker remembers at most so many distinct chunks and so many of their characters, and one batch's more.
MEMORY, MEMORY_CHARS = 1 << 21, 1 << 25
#: Characters that are worked on together.
PART = 1 << 19
#: New chunks of one call of the library.
JOINED = 2000


def split(text: str) -> list[str]:
    """The chunks of a text, the leading spaces left out."""
    if OTHER_SPACE.search(text) or "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " ":
        return SAFE.split(text)
    return text.split(" ")


def parts(text: str) -> Iterator[str]:
    """A text in parts that end at safe spaces; joined by these spaces they are the text."""
    first = 0
    while len(text) - first > PART and (cut := SAFE.search(text, first + PART)):
        yield text[first : cut.start()]
        first = cut.end()
    yield text[first:]


def batches(texts: list[str]) -> Iterator[tuple[list[int], list[str], list[bool]]]:
    """(place of the text, part, whether another part of it came before), of about PART characters together."""
    places, cut, inside, size = [], [], [], 0
    for i, text in enumerate(texts):
        for k, part in enumerate(parts(text)):
            places.append(i)
            cut.append(part)
            inside.append(k > 0)
            size += len(part)
            if size >= PART:
                yield places, cut, inside
                places, cut, inside, size = [], [], [], 0
    if cut:
        yield places, cut, inside


class ChunkEncoder:
    """Ids of texts as arrays.

    encode: a list of texts to a list of id lists. opens: of an array of ids, which of them begin with a space; with it, new
    chunks are encoded many in one text. What is remembered is bounded; when full, it forgets all. A chunk's number is its
    place in ``at``.
    """

    def __init__(self, encode: Callable[[list[str]], list[Sequence[int]]], opens: Callable[[np.ndarray], np.ndarray] | None = None):
        self.encode, self.opens = encode, opens
        self._forget()

    def _forget(self) -> None:
        self.heads: dict[str, int] = {}  # first chunks of texts
        self.tails: dict[str, int] = {}  # others, written here without their leading space
        self.chars = 0
        self.at = np.zeros(1, np.int64)  # starts of each chunk's ids in self.ids, and the end
        self.ids = np.zeros(0, np.uint32)

    def _keep(self, into: dict[str, int], new: Sequence[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        into.update(zip(new, range(len(self.at) - 1, len(self.at) - 1 + len(new))))
        self.chars += sum(map(len, new))
        self.at = np.concatenate([self.at, np.cumsum(sizes) + self.at[-1]])
        self.ids = np.concatenate([self.ids, ids])

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = self.encode(texts)
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return sizes, np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum()))

    def _learn_heads(self, new: set[str]) -> None:
        if new:
            self._keep(self.heads, list(new), *self._each(list(new)))

    def _learn_tails(self, new: set[str]) -> None:
        plain = [c for c in new if " " not in c] if self.opens else []
        found = []
        for a in range(0, len(plain), JOINED):
            some = plain[a : a + JOINED]
            ids = np.asarray(self.encode([" " + " ".join(some)])[0], np.uint32)
            starts = np.flatnonzero(self.opens(ids))
            if len(starts) != len(some):
                raise RuntimeError("a token goes over a space between two words")
            found.append((some, np.diff(starts, append=len(ids)), ids))
        rest = [c for c in new if " " in c] if self.opens else list(new)
        if rest:
            found.append((rest, *self._each([" " + c for c in rest])))
        if found:
            names, sizes, ids = zip(*found)
            self._keep(self.tails, list(chain.from_iterable(names)), np.concatenate(sizes), np.concatenate(ids))

    def numbers(self, cut: list[str], inside: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all chunks of some parts, and how many each has. Valid until the next call."""
        if len(self.at) > MEMORY or self.chars > MEMORY_CHARS:
            self._forget()
        each = list(map(split, cut))
        per = np.fromiter(map(len, each), np.int64, len(each))
        flat = list(chain.from_iterable(each))
        number = np.fromiter(map(self.tails.get, flat, repeat(-1)), np.int64, len(flat))
        first = np.cumsum(per) - per
        opening = [i for i, deep in enumerate(inside) if not deep]
        heads = [each[i][0] for i in opening]
        self._learn_heads(set(heads) - self.heads.keys())
        number[first[opening]] = list(map(self.heads.__getitem__, heads))
        missed = np.flatnonzero(number < 0).tolist()
        self._learn_tails({flat[i] for i in missed})
        number[missed] = [self.tails[flat[i]] for i in missed]
        return number, per

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Number of ids of each text."""
        out = np.zeros(len(texts), np.int64)
        for places, cut, inside in batches(texts):
            number, per = self.numbers(cut, inside)
            total = np.concatenate([[0], np.cumsum(np.diff(self.at)[number])])
            ends = np.cumsum(per)
            np.add.at(out, places, total[ends] - total[ends - per])
        return out

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and how many each has."""
        ids, out = [np.zeros(0, np.uint32)], np.zeros(len(texts), np.int64)
        for places, cut, inside in batches(texts):
            number, per = self.numbers(cut, inside)
            width = np.diff(self.at)[number]
            stop = np.cumsum(width)
            take = np.arange(stop[-1]) + np.repeat(self.at[number] - stop + width, width)
            ids.append(self.ids[take])
            total = np.concatenate([[0], stop])
            ends = np.cumsum(per)
            np.add.at(out, places, total[ends] - total[ends - per])
        return np.concatenate(ids), out


_encoders: dict[str, ChunkEncoder] = {}


def library_encoder(path: str) -> ChunkEncoder:
    """One encoder per worker process and tokenizer file (.json of the tokenizers library, byte-level)."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        vocabulary = tok.get_vocab()
        space = np.zeros(max(vocabulary.values()) + 1, bool)
        space[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True  # how a byte-level vocabulary writes a space

        def encode(texts: list[str]) -> list[Sequence[int]]:
            return [x.ids for x in tok.encode_batch_fast(texts, add_special_tokens=False)]

        _encoders[path] = ChunkEncoder(encode, lambda ids: space[ids])
    return _encoders[path]
