"""A wavelet matrix of token ids: bit-planes with rank and select in one compressed file.

Plane by plane, from the highest bit on, the ids are parted stably into those without and those with the bit. A
plane's bits are kept in chunks, compressed each by itself, with the number of ones before every chunk: a look at
one place opens one chunk of each plane. ``access`` gives the id at a place, ``rank`` how often an id occurs
before a place, ``select`` the place of its k-th occurrence; ``decode`` gives all ids at once.

File: magic, length of the header, header (JSON: counts and places of the sections), sections.
"""

from __future__ import annotations

import json
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa

MAGIC = b"QUILWM01"
#: Bits of a chunk.
CHUNK = 1 << 15


class WaveletMatrix:
    """Over n ids of ``bits`` bits, read from the sections of a file."""

    def __init__(self, n: int, bits: int, zeros: list[int], planes: list[tuple[np.ndarray, np.ndarray, memoryview]]):
        self.n, self.bits, self.zeros, self.planes = n, bits, zeros, planes
        self._chunk = lru_cache(maxsize=4 * max(1, bits))(self._open)

    def _open(self, level: int, chunk: int) -> np.ndarray:
        """The bits of a chunk as 0 and 1."""
        _, ends, data = self.planes[level]
        start, end = (int(ends[chunk - 1]) if chunk else 0), int(ends[chunk])
        size = min(CHUNK, self.n - chunk * CHUNK)
        packed = pa.decompress(pa.py_buffer(data[start:end]), -(-size // 8), codec="zstd", asbytes=True)
        return np.unpackbits(np.frombuffer(packed, np.uint8), count=size)

    def _bit(self, level: int, at: int) -> int:
        return int(self._chunk(level, at // CHUNK)[at % CHUNK])

    def _ones(self, level: int, at: int) -> int:
        """Ones before place ``at``."""
        chunk, rest = divmod(at, CHUNK)
        return int(self.planes[level][0][chunk]) + (int(self._chunk(level, chunk)[:rest].sum()) if rest else 0)

    def _place(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of this value."""
        ones = self.planes[level][0].astype(np.int64)
        before = ones if bit else np.arange(len(ones), dtype=np.int64) * CHUNK - ones
        if not bit:
            before[-1] = self.n - ones[-1]
        chunk = int(np.searchsorted(before, k, side="right")) - 1
        return chunk * CHUNK + int(np.flatnonzero(self._chunk(level, chunk) == bit)[k - before[chunk]])

    def access(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, at), self._ones(level, at)
            value, at = value << 1 | bit, (self.zeros[level] + ones if bit else at - ones)
        return value

    def _span(self, value: int, start: int, end: int) -> tuple[int, int]:
        """Where the occurrences of ``value`` within [start, end) stand below the last plane."""
        for level in range(self.bits):
            a, b = self._ones(level, start), self._ones(level, end)
            start, end = (self.zeros[level] + a, self.zeros[level] + b) if value >> (self.bits - 1 - level) & 1 else (start - a, end - b)
        return start, end

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        """How often ``value`` occurs within [start, end)."""
        if not 0 <= value < 1 << self.bits:
            return 0
        a, b = self._span(value, start, self.n if end is None else end)
        return b - a

    def rank(self, value: int, at: int) -> int:
        """How often ``value`` occurs before place ``at``."""
        return self.count(value, 0, at)

    def select(self, value: int, k: int) -> int:
        """Place of the k-th occurrence of ``value``, from 0; IndexError if there are not so many."""
        if not 0 <= k < self.count(value):
            raise IndexError(k)
        at = self._span(value, 0, self.n)[0] + k
        for level in reversed(range(self.bits)):
            bit = value >> (self.bits - 1 - level) & 1
            at = self._place(level, bit, at - self.zeros[level] if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids in order: the partings undone, last plane first."""
        values = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in reversed(range(self.bits)):
            ones, ends, data = self.planes[level]
            parts, start = [], 0
            for chunk, end in enumerate(ends):
                size = min(CHUNK, self.n - chunk * CHUNK)
                parts.append(pa.decompress(pa.py_buffer(data[start : int(end)]), -(-size // 8), codec="zstd", asbytes=True))
                start = int(end)
            mask = np.unpackbits(np.frombuffer(b"".join(parts), np.uint8), count=self.n).view(bool)
            before, zeros = np.empty_like(values), self.zeros[level]
            before[np.flatnonzero(~mask)] = values[:zeros]
            before[np.flatnonzero(mask)] = values[zeros:] | values.dtype.type(1 << (self.bits - 1 - level))
            values = before
        return values


def write_shard(ids: np.ndarray, bits: int, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """A file of ``ids`` (unsigned, below 2**bits), which are those of documents of these ids and lengths, one after another."""
    if len(ids) != int(lengths.sum()):
        raise ValueError("the lengths do not add up to the ids")
    n, sections, places, at = len(ids), [], {}, 0

    def add(name: str, data: bytes) -> None:
        nonlocal at
        places[name] = [at, len(data)]
        sections.append(data)
        at += len(data)

    zeros = []
    chunks = -(-n // CHUNK)
    for level in range(bits):
        mask = (ids >> ids.dtype.type(bits - 1 - level) & ids.dtype.type(1)).astype(bool)
        low, high = np.flatnonzero(~mask), np.flatnonzero(mask)
        zeros.append(len(low))
        ids = np.concatenate([ids.take(low), ids.take(high)])
        packed = np.packbits(mask)
        ones = np.zeros(chunks + 1, "<u4")
        ones[1:] = np.cumsum(np.add.reduceat(np.bitwise_count(packed).astype(np.int64), np.arange(0, len(packed), CHUNK // 8))) if n else 0
        told = [pa.compress(packed[c * CHUNK // 8 : (c + 1) * CHUNK // 8].tobytes(), codec="zstd", asbytes=True) for c in range(chunks)]
        add(f"ones{level}", ones.tobytes())
        add(f"ends{level}", np.cumsum([len(x) for x in told], dtype="<u4").tobytes() if told else b"")
        add(f"bits{level}", b"".join(told))
    null = np.packbits([d is None for d in doc_ids])
    add("null", null.tobytes())
    for name, values in (("docs", np.array([d or 0 for d in doc_ids], "<i8")), ("lengths", np.asarray(lengths, "<u4"))):
        raw = values.tobytes()
        add(name, pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")
    header = json.dumps({"n": n, "bits": bits, "docs": len(doc_ids), "zeros": zeros, "at": places}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *sections])


class Shard:
    """A file opened: its documents and its wavelet matrix. Nothing is decompressed before it is asked for."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token shard")
        (size,) = struct.unpack_from("<I", data, 8)
        self.header = json.loads(bytes(data[12 : 12 + size]))
        self._data, self._base = memoryview(data), 12 + size
        if self._base + max(a + n for a, n in self.header["at"].values()) != len(data):
            raise ValueError("the token shard is cut short")
        bits = self.header["bits"]
        planes = [(np.frombuffer(self._part(f"ones{i}"), "<u4"), np.frombuffer(self._part(f"ends{i}"), "<u4"), self._part(f"bits{i}")) for i in range(bits)]
        self.ids = WaveletMatrix(self.header["n"], bits, self.header["zeros"], planes)

    def _part(self, name: str) -> memoryview:
        at, size = self.header["at"][name]
        return self._data[self._base + at : self._base + at + size]

    def _numbers(self, name: str, kind: str) -> np.ndarray:
        n = self.header["docs"]
        return np.frombuffer(pa.decompress(pa.py_buffer(self._part(name)), n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind) if n else np.zeros(0, kind)

    def doc_ids(self) -> list[int | None]:
        null = np.unpackbits(np.frombuffer(self._part("null"), np.uint8), count=self.header["docs"])
        return [None if x else int(d) for d, x in zip(self._numbers("docs", "<i8"), null, strict=True)]

    def lengths(self) -> np.ndarray:
        return self._numbers("lengths", "<u4").astype(np.int64)
