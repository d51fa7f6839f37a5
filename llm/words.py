"""Words of many texts at once: byte classes, 64-bit word hashes and hashes of word runs in numpy.

A block of texts is looked at as one array of bytes. A table of 256 entries says which bytes belong to
words (and folds A-Z); hashes of all words then come from one prefix sum. Hashes only select and group
candidates; callers that promise exact results compare the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

# Blocks hold about so many bytes (or one text), which bounds the memory of the arrays below.
BLOCK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def byte_classes(separators: bytes, fold: bool) -> np.ndarray:
    """256 entries: 0 for bytes between words, else the byte itself, A-Z in lower case if `fold`."""
    table = np.arange(256, dtype=np.uint8)
    if fold:
        table[65:91] += 32
    table[np.frombuffer(separators, dtype=np.uint8)] = 0
    return table


# White space is x20 and x09-x0D; NUL belongs to words, so it is mapped to a byte that UTF-8 never uses.
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
SPACED = byte_classes(BLANKS, fold=False)
SPACED[0] = 0xFF
# ASCII letters and digits and everything beyond ASCII, as [^\x00-\x2F\x3A-\x60\x7B-\x7F] after folding.
LETTERS = byte_classes(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), fold=True)


class Words(NamedTuple):
    data: np.ndarray  # bytes of the block after the class table
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after each word
    row: np.ndarray  # text of each word, counted within the block
    first: np.ndarray  # first word of each text, and the number of words as the last entry

    def words(self) -> list[bytes]:
        whole = self.data.tobytes()
        return [whole[a:b] for a, b in zip(self.start.tolist(), self.end.tolist(), strict=True)]

    def text(self, a: int, b: int) -> bytes:
        """Words a to b (exclusive), joined by one space."""
        whole = self.data
        return b" ".join(
            whole[s:e].tobytes() for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist(), strict=True)
        )


def blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets into them) for parts of a string column; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def split(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> Words:
    """Words of a block; a word never crosses from one text into the next."""
    mapped = classes[data]
    inside = mapped != 0
    rows = len(offsets) - 1
    if not inside.any():
        none = np.zeros(0, np.int64)
        return Words(mapped, none, none, none, np.zeros(rows + 1, np.int64))
    edge = np.zeros(len(mapped) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(rows), np.diff(first))
    return Words(mapped, start, end, row, first)


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, (n + 1).bit_length())
    if size not in _powers:
        tables = []
        for base in (_BASE, _INVERSE):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        if size > 1 << 22:
            return tuple(tables)  # one very long text: not kept
        _powers[size] = tuple(tables)
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: Words) -> np.ndarray:
    """64 bits per word, equal for equal words wherever they stand."""
    n = len(words.data)
    up, down = _power_table(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((words.data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return mix((sums[words.end] - sums[words.start]) * down[words.start] + (words.end - words.start).astype(np.uint64))


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of words i .. i + k - 1 for every i; runs over the edge of a text are the caller's to leave out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:n].copy()
    for j in range(1, k):
        total *= _STEP
        total += hashes[j : j + n]
    return mix(total)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of values[i : i + width] for every i, by doubling."""
    if len(values) < width:
        return values[:0]
    done, out = 1, values
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out
