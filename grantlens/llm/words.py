"""Words, shingles and their hashes for Arrow text columns, a block of whole texts at a time.

Texts are looked at as UTF-8 bytes. A word is a run of ASCII letters, ASCII digits and non-ASCII
characters, A-Z lower-cased; this is the same as splitting the lower-cased text by
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Every step is one numpy operation over a block of texts, so
memory is bounded by the block size or by the longest single text, whichever is larger.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_U64 = np.uint64
_WORD_BYTE = np.zeros(256, np.uint8)
_WORD_BYTE[0x30:0x3A] = np.arange(0x30, 0x3A)
_WORD_BYTE[0x61:0x7B] = np.arange(0x61, 0x7B)
_WORD_BYTE[0x41:0x5B] = np.arange(0x61, 0x7B)
_WORD_BYTE[0x80:] = np.arange(0x80, 0x100)

_BASE = _U64(0x9E3779B97F4A7C15)
_STEP = _U64(0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection)."""
    x = x.astype(_U64, copy=True)
    x ^= x >> _U64(30)
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, _U64)
    out[0] = 1
    return np.cumprod(out, dtype=_U64)


_POWERS = _powers(256)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = _powers(2 * n)
    return _POWERS


@dataclass
class Block:
    """Consecutive texts of a column: rows ``first`` .. ``first + len(offsets) - 2``."""

    first: int
    offsets: np.ndarray  # where each text begins in data, and the end of the last
    data: np.ndarray  # UTF-8 bytes

    @property
    def texts(self) -> int:
        return len(self.offsets) - 1


def blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string column into blocks of whole texts; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).cast(pa.large_binary()).fill_null(b"")
    if len(column) == 0:
        return
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(offsets, offsets[row] + block_bytes, side="right")) - 1
        stop = min(max(stop, row + 1), len(column))
        own = offsets[row : stop + 1]
        yield Block(row, own - own[0], data[own[0] : own[-1]])
        row = stop


@dataclass
class Words:
    """The words of a block in order, and where the words of each text begin."""

    hashes: np.ndarray  # uint64 per word
    text: np.ndarray  # index of its text within the block
    start: np.ndarray  # byte positions in the block
    end: np.ndarray
    bounds: np.ndarray  # words of text t: bounds[t] .. bounds[t + 1] - 1


def words(block: Block) -> Words:
    low = _WORD_BYTE[block.data]
    inside = low != 0
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    begins = block.offsets[:-1]
    begins = begins[begins < len(low)]
    starts[begins] = inside[begins]
    start = np.flatnonzero(starts)
    if not len(start):
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, _U64), none, none, none, np.zeros(block.texts + 1, np.int64))
    packed = low[inside]
    first = np.cumsum(inside, dtype=np.int64)[start] - 1
    lengths = np.diff(np.append(first, len(packed)))
    within = np.arange(len(packed), dtype=np.int64) - np.repeat(first, lengths)
    values = packed.astype(_U64)
    values *= powers(int(lengths.max()) + 1)[within]
    hashes = mix64(np.add.reduceat(values, first) + lengths.astype(_U64) * _STEP)
    text = np.searchsorted(block.offsets, start, side="right") - 1
    bounds = np.searchsorted(text, np.arange(block.texts + 1))
    return Words(hashes, text, start, start + lengths, bounds)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` neighbouring words, texts' borders not regarded."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, _U64)
    out = np.full(count, n, _U64)
    for i in range(n):
        out *= _BASE
        out += hashes[i : i + count]
    return mix64(out)


def shingles(found: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of each text, and their texts (in order).

    A text of fewer than ``n`` words, but not none, has one shingle: all its words.
    """
    runs = grams(found.hashes, n)
    whole = found.text[: len(runs)] == found.text[n - 1 :][: len(runs)]
    hashes, text = [runs[whole]], [found.text[: len(runs)][whole]]
    counts = np.diff(found.bounds)
    for m in range(1, n):
        short = np.flatnonzero(counts == m)
        if len(short):
            own = np.full(len(short), m, _U64)
            for i in range(m):
                own = own * _BASE + found.hashes[found.bounds[short] + i]
            hashes.append(mix64(own))
            text.append(short)
    hashes, text = np.concatenate(hashes), np.concatenate(text)
    order = np.argsort(text, kind="stable")
    return hashes[order], text[order]


def distinct_shingles(found: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of each text without repeats, sorted by text and hash."""
    hashes, text = shingles(found, n)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[fresh], text[fresh]
