"""Words of whole texts as numpy arrays, for use inside Arrow tasks.

A slice of rows is laid out as one byte buffer, so that splitting, hashing and
windows are array operations. A slice holds about a megabyte of text, or one
text if that is longer; memory follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLICE_BYTES = 1 << 20
#: rows of an Arrow batch that are Python objects at a time
PART_ROWS = 1024

#: bytes of words ``[^\x20\x09-\x0D]+``
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower-cased
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = np.array(x, dtype=np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit constants."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_LOWER = np.arange(256)
_LOWER[0x41:0x5B] += 32
_BYTE = {False: constants(256, 11), True: constants(256, 11)[_LOWER]}
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WINDOW = constants(64, 23)


def slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``SLICE_BYTES`` of text each."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > SLICE_BYTES:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def parts(batches) -> Iterator:
    """The batches in pieces of ``PART_ROWS`` rows, without copying."""
    for batch in batches:
        for start in range(0, batch.num_rows, PART_ROWS):
            yield batch.slice(start, PART_ROWS)


def encoded(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in column.cast("binary").to_pylist()]


def decoded(column) -> list[str]:
    """An Arrow string column as text; malformed bytes become U+FFFD, null counts as empty."""
    return [x.decode("utf-8", "replace") for x in encoded(column)]


class Words:
    """The words of some texts: ``bounds[i]`` to ``bounds[i + 1]`` are those of text ``i``."""

    def __init__(self, texts: list[bytes], is_word: np.ndarray, lower: bool):
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.row_start = np.concatenate([[0], np.cumsum(lengths + 1)])
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        self.inside = is_word[self.data]
        change = np.flatnonzero(self.inside[1:] != self.inside[:-1]) + 1
        if self.inside[0]:
            change = np.concatenate([[0], change])
        self.start, self.end = change[0::2], change[1::2]
        self.bounds = np.searchsorted(self.start, self.row_start)
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.bounds))
        self.hash = self._hash(lower)

    def _hash(self, lower: bool) -> np.ndarray:
        if not self.start.size:
            return np.zeros(0, dtype=np.uint64)
        length = self.end - self.start
        first = np.concatenate([[0], np.cumsum(length)[:-1]])
        place = np.arange(first[-1] + length[-1]) - np.repeat(first, length)
        power = np.full(int(length.max()), _BASE)
        power[0] = 1
        power = np.multiply.accumulate(power)
        return mix64(np.add.reduceat(_BYTE[lower][self.data[self.inside]] * power[place], first))

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The first word of each window of ``size`` words within one text, and the window's hash."""
        n = self.hash.size - size + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        first = np.flatnonzero(self.row[:n] == self.row[size - 1:])
        return first, sequence_hash([self.hash[first + j] for j in range(size)])


def sequence_hash(words: list[np.ndarray]) -> np.ndarray:
    """A hash of sequences, given as the hashes of their first, second, ... words."""
    total = np.full(words[0].shape, np.uint64(len(words)))
    for j, w in enumerate(words):
        total += w * _WINDOW[j % 64] + (w >> np.uint64(32)) * np.uint64(2 * j + 1)
    return mix64(total)
