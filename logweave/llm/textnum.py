"""Vectorised word handling for Arrow string batches.

All text operators that work on words use the same definition: a word is a
maximal run of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text.  Those
bytes never occur inside a multi-byte character, so words can be found and
hashed on the raw Arrow buffer without making one Python string per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 2))
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def forget() -> None:
    """Drop what is kept between calls."""
    _powers.clear()


@dataclass
class Words:
    """Words of some consecutive texts: byte spans, and the first word of each text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # length texts + 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes, A-Z lower-cased if asked."""
        if not len(self.starts):
            return np.empty(0, dtype=np.uint64)
        up, down = _power_tables(len(self.data))
        table = _LOWER if lower else _SAME
        sums = np.empty(len(self.data) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum((table[self.data].astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=sums[1:])
        h = (sums[self.ends] - sums[self.starts]) * down[self.starts]
        return mix64(h + (self.ends - self.starts).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def string_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array, nulls read as empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.type != pa.large_string():
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.empty(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def find_words(texts: pa.Array) -> Words:
    data, offsets = string_buffers(texts)
    if not len(data):
        none = np.empty(0, dtype=np.int64)
        return Words(data, none, none, np.zeros(len(offsets), dtype=np.int64))
    solid = ~_IS_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    opens = solid.copy()
    opens[1:] &= ~solid[:-1] | edge[1:-1]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:] | edge[1:-1]
    starts = np.flatnonzero(opens)
    return Words(data, starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets))


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch whose texts hold about `limit` bytes; one longer text makes a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(sizes):
        total, end = int(sizes[at]), at + 1
        while end < len(sizes) and total + sizes[end] <= limit:
            total += int(sizes[end])
            end += 1
        yield batch.slice(at, end - at)
        at = end


def windows(hashes: np.ndarray, width: int, base: int = 0xA0761D6478BD642F) -> np.ndarray:
    """Hashes of all runs of `width` hashes, by doubling; ends of texts are the caller's concern."""
    if len(hashes) < width:
        return np.empty(0, dtype=np.uint64)
    n, power = len(hashes) - width + 1, base
    block, size = hashes, 1
    out, done, shift = np.zeros(n, dtype=np.uint64), 0, 1
    while True:
        if width & size:
            out += block[done : done + n] * np.uint64(shift)
            done += size
            shift = shift * pow(base, size, 1 << 64) % (1 << 64)
        if size * 2 > width:
            return mix64(out)
        block = block[: len(block) - size] + block[size:] * np.uint64(pow(base, size, 1 << 64))
        size *= 2


def within_texts(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the windows that lie in one text, and their texts."""
    counts = np.maximum(words.counts - width + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    return words.first[owner] + np.arange(len(owner)) - begin[owner], owner
