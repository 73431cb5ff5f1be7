"""Words and their 64-bit hashes for Arrow batches of texts, in whole-array numpy.

The texts of a batch are looked at as one run of UTF-8 bytes.  Word characters are
told by a table of 256 entries, so multi-byte characters need no decoding.  A word is
hashed eight bytes at a time: each piece is mixed with a key of its place, and the sum of
the mixed pieces with the length.  Mixing is not linear, so no pattern of repetition makes
two words collide whatever the keys are, as it does for polynomials modulo 2^64.  Equal
words have equal hashes on every machine and in every run.  What must not depend on luck
compares bytes: word_numbers() gives equal numbers to equal words alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text looked at together: bounds the temporary arrays (about ten times this).
BLOCK_BYTES = 1 << 20

WHITE_SPACE = bytes([0x20, *range(0x09, 0x0E)])
_GOLDEN = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers that depend on the seed alone."""
    steps = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(_GOLDEN)
    return mix(steps) | np.uint64(1)


#: What is kept of eight bytes of which the first 0 to 8 belong to a word (little endian).
_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


def space_words() -> np.ndarray:
    """True for the bytes of words that white space parts."""
    table = np.ones(256, bool)
    table[list(WHITE_SPACE)] = False
    return table


def alphanumeric_words() -> np.ndarray:
    """True for ASCII letters and digits and all bytes of other characters."""
    table = np.zeros(256, bool)
    for first, last in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
        table[first:last] = True
    return table


@dataclass
class Words:
    """The words of some documents, in text order.

    data: the bytes (lower-cased if asked); start, end: each word's place in them;
    hash: 64 bits a word; first: where each document's words begin, one more entry than
    documents; text: where each document's bytes begin, likewise; row: the number of the
    first document in the batch.
    """

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    text: np.ndarray
    row: int

    @property
    def documents(self) -> int:
        return len(self.first) - 1

    def owner(self) -> np.ndarray:
        """The document of each word, counted from 0 in this block."""
        return np.repeat(np.arange(self.documents), np.diff(self.first))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its offsets; nulls are empty."""
    column = column.cast(pa.large_binary()) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    return data, offsets


def blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Runs of whole documents of BLOCK_BYTES or one document: bytes, offsets from 0, number of the first."""
    data, offsets = text_bytes(column)
    n, row = len(offsets) - 1, 0
    while row < n:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, "right")) - 1)
        yield data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row], row
        row = to


def find_words(column: pa.Array, is_word: np.ndarray, lower: bool = True) -> Iterator[Words]:
    """The words of each block of a string column."""
    table = lower_table()
    for data, text, row in blocks(column):
        if lower:
            data = table[data]
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = is_word[data]
        edges = inside[1:] != inside[:-1]
        # the last word of a text and the first of the next one can touch
        touching = text[1:-1][(text[1:-1] > 0) & (text[1:-1] < len(data))]
        touching = np.unique(touching[inside[touching] & inside[touching + 1]])
        marks = np.flatnonzero(edges)
        start, end = marks[0::2], marks[1::2]
        if len(touching):
            start, end = np.sort(np.concatenate([start, touching])), np.sort(np.concatenate([end, touching]))
        yield Words(data, start, end, hash_runs(data, start, end), np.searchsorted(start, text), text, row)


def hash_parts(parts: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of each sequence parts[first[i] : first[i + 1]] of 64-bit numbers; the last sequence ends with parts, none is empty."""
    place = np.arange(len(parts)) - np.repeat(first, np.diff(np.append(first, len(parts))))
    with np.errstate(over="ignore"):
        keyed = mix(parts ^ mix(place.astype(np.uint64) * np.uint64(_GOLDEN) + np.uint64(1)))
        return mix(np.add.reduceat(keyed, first) ^ mix(length.astype(np.uint64)))


def hash_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each of the runs."""
    if not len(start):
        return np.zeros(0, np.uint64)
    held = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) + 1, "<u8", held, strides=(1,))  # the eight bytes from each place on
    length = end - start
    parts = np.maximum((length + 7) >> 3, 1)
    first = np.cumsum(parts) - parts
    at = 8 * (np.arange(int(parts.sum())) - np.repeat(first, parts))
    value = eights[np.repeat(start, parts) + at] & _KEPT[np.minimum(np.repeat(length, parts) - at, 8)]
    return hash_parts(value, first, length)


def same_bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, start2: np.ndarray, end2: np.ndarray) -> np.ndarray:
    """Are data[start:end] and other[start2:end2] equal, for each of the runs?"""
    length = end - start
    same = length == end2 - start2
    todo = np.flatnonzero(same & (length > 0))
    total = np.cumsum(length[todo])
    at = 0
    while at < len(todo):  # bounds the temporary arrays
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + BLOCK_BYTES, "right")))
        own = todo[at:to]
        n = length[own]
        first = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(first, n)
        differ = data[np.repeat(start[own], n) + place] != other[np.repeat(start2[own], n) + place]
        same[own] = ~np.logical_or.reduceat(differ, first)
        at = to
    return same


class Numbers(dict):
    """Words by number: (hash, tie) to bytes and number.  Equal numbers mean equal bytes."""

    def of(self, word: bytes, hash_: int) -> int:
        tie = 0
        while True:
            known = self.get((hash_, tie))
            if known is None:
                self[hash_, tie] = known = (word, len(self))
            if known[0] == word:
                return known[1]
            tie += 1


def word_numbers(w: Words, numbers: Numbers | None = None, own: np.ndarray | None = None) -> np.ndarray:
    """A number for each word of a block, or for those at the places `own`: equal for equal bytes, different for different ones, in all blocks that share `numbers`."""
    numbers = Numbers() if numbers is None else numbers
    own = slice(None) if own is None else own
    hash_, start, end = w.hash[own], w.start[own], w.end[own]
    if not len(hash_):
        return np.zeros(0, np.int64)
    unique, one, group = np.unique(hash_, return_index=True, return_inverse=True)
    starts, ends = start[one], end[one]
    known = np.array([numbers.of(w.data[a:b].tobytes(), h) for a, b, h in zip(starts.tolist(), ends.tolist(), unique.tolist(), strict=True)], np.int64)
    out = known[group]
    for i in np.flatnonzero(~same_bytes(w.data, start, end, w.data, starts[group], ends[group])).tolist():  # colliding words
        out[i] = numbers.of(w.data[start[i] : end[i]].tobytes(), int(hash_[i]))
    return out


def hash_windows(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of `size` word hashes: entry i is of words i to i + size - 1."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    n = len(words) - size + 1
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for j, c in enumerate(constants(size, 7)):
            total += words[j : j + n] * c
        return mix(total + np.uint64(size))
