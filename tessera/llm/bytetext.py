"""Vectorised word scanning over the raw buffers of Arrow string arrays.

Every operator that needs words at corpus scale works on the UTF-8 bytes of a chunk of texts at
once: no Python string is made per document or per word. Chunks are bounded by bytes and rows, so
memory follows these bounds (or the longest single text), never the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
CHUNK_ROWS = 1 << 12

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash multiplier and of its inverse modulo 2^64, at least n of them."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for key, base in (("up", _MULTIPLIER), ("down", _INVERSE)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[key] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two xor-multiply rounds); wraps by design."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def alnum_table() -> np.ndarray:
    """Byte map of the folded word rule: A-Z lower-cased; digits, letters and non-ASCII bytes kept; 0 elsewhere."""
    table = np.zeros(256, dtype=np.uint8)
    for b in range(256):
        if 0x41 <= b <= 0x5A:
            table[b] = b + 32
        elif 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80:
            table[b] = b
    return table


def space_table() -> np.ndarray:
    """Byte map of the white-space word rule: bytes unchanged, 0 for white space.

    NUL is word material by that rule, so it is mapped to a byte that UTF-8 never uses.
    """
    table = np.arange(256, dtype=np.uint8)
    table[0] = 0xFF
    table[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
    return table


ALNUM = alnum_table()
SPACE = space_table()


@dataclass
class Chunk:
    """Some whole texts: their bytes, and where each begins and ends."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def scan(self, table: np.ndarray) -> Words:
        return Words.of(self, table)


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES, rows: int = CHUNK_ROWS) -> Iterator[Chunk]:
    """Cut an Arrow string array into runs of whole texts, `rows` at most, of about `limit` bytes; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), len(texts), row + rows)
        yield Chunk(row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end


@dataclass
class Words:
    """The words of a chunk in order: byte spans, the document each stands in, and words per document."""

    chunk: Chunk
    mapped: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, chunk: Chunk, table: np.ndarray) -> Words:
        mapped = table[chunk.data]
        inside = mapped != 0
        n = len(mapped)
        opens = inside.copy()
        closes = inside.copy()
        if n:
            opens[1:] &= ~inside[:-1]
            closes[:-1] &= ~inside[1:]
            edges = chunk.offsets[(chunk.offsets > 0) & (chunk.offsets < n)]
            opens[edges] = inside[edges]
            closes[edges - 1] = inside[edges - 1]
        start = np.flatnonzero(opens)
        end = np.flatnonzero(closes) + 1
        bounds = np.searchsorted(start, chunk.offsets)
        counts = np.diff(bounds)
        return cls(chunk, mapped, start, end, np.repeat(np.arange(chunk.rows), counts), counts)

    def _prefix(self) -> np.ndarray:
        up, _ = _power_table(len(self.mapped) + 1)
        sums = np.zeros(len(self.mapped) + 1, dtype=np.uint64)
        np.cumsum(self.mapped.astype(np.uint64) * up[: len(self.mapped)], out=sums[1:])
        return sums

    def span_hashes(self, lengths: list[int | None]) -> list[np.ndarray]:
        """A 64-bit hash of every word's first so many bytes (None: the whole word)."""
        sums = self._prefix()
        _, down = _power_table(len(self.mapped) + 1)
        out = []
        for length in lengths:
            end = self.end if length is None else np.minimum(self.start + length, self.end)
            raw = (sums[end] - sums[self.start]) * down[self.start]
            out.append(mix(raw + (end - self.start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
        return out

    def hashes(self) -> np.ndarray:
        return self.span_hashes([None])[0]
