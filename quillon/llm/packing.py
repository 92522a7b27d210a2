"""Packing along a space-filling curve: neighbouring documents share sequences.

A document's hashed word vector is projected to a few dimensions, quantised and turned into a Hilbert key.
Documents are range-sorted by that key and laid one after another into sequences; a document is cut where a
sequence is full. So all sequences of a range are full but its last, whose tokens are laid out in sequences
of powers of two, which need no padding.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, slices

SEQUENCE = 4096
#: Dimensions of the projection and bits of each in the Hilbert key.
DIMS, BITS = 3, 10
#: Words a worker process keeps encoded; then it starts anew. Bounds its memory to some 100 MB.
CACHE_WORDS = 400_000
#: Documents whose keys and sizes set the ranges, about; so many for each range at least.
SAMPLE_DOCS, SAMPLE_PER_RANGE = 4000, 16
#: Ranges at least, and bytes of text in a range, about.
MIN_RANGES, RANGE_BYTES = 64, 128 << 20
_END_ID = 2
_BUCKETS = 4096


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each point, integer coordinates [n, dims] below 2**bits (Skilling, 2004)."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where(x[-1] & q, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write for each byte: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordCoder(dict):
    """Packed ids of words, encoded when first asked for: the tokenizer never joins text across white space.

    ids() is exactly ``tokenizer.encode(text, add_special_tokens=False)`` for a byte-level BPE with word ends
    that lower-cases and drops white space. A word of Latin-1 letters with a tail of ASCII marks goes straight
    to the merges, letters and marks being separate there; every other word takes the whole tokenizer.
    """

    _PLAIN = re.compile("([a-z\u00df-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\\[-`{-~]*)")
    #: str.split() takes these for white space, the tokenizer does not.
    _ODD = re.compile("[\x1c-\x1f]")

    def __init__(self, file: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(file)
        self.model = self.tokenizer.model
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.pack = struct.Struct(self.kind.replace("u2", "H").replace("u4", "I")).pack
        self.letters = _byte_letters()

    def _merge(self, part: str) -> bytes:
        text = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
        return b"".join([self.pack(t.id) for t in self.model.tokenize(text)])

    def __missing__(self, word: str) -> bytes:
        plain = self._PLAIN.fullmatch(word.lower())
        if plain:
            core, tail = plain.groups()
            packed = self._merge(core) + (self._merge(tail) if tail else b"")
        else:
            packed = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.kind).tobytes()
        self[word] = packed
        return packed

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed as little-endian unsigned numbers of ``kind``."""
        if len(self) > CACHE_WORDS:
            self.clear()
        get = self.__getitem__
        return [b"".join(map(get, re.split(r"[ \t\r\n]+", t) if self._ODD.search(t) else t.split())) for t in texts]


@lru_cache(maxsize=1)
def coder(file: str) -> WordCoder:
    """One per worker process, so the cache outlives a task."""
    return WordCoder(file)


def _projection() -> np.ndarray:
    """Fixed pseudo-random projection of hashed id buckets, [buckets, dims]."""
    return np.random.default_rng(8).standard_normal((_BUCKETS, DIMS))


def _keys(ids: list[bytes], kind: str, matrix: np.ndarray) -> np.ndarray:
    """Hilbert key of each document: mean projected bucket of its ids, each coordinate squashed to a grid."""
    points = np.zeros((len(ids), DIMS))
    for i, own in enumerate(ids):
        if own:
            bucket = (np.frombuffer(own, kind).astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(20)
            counts = np.bincount(bucket, minlength=_BUCKETS)
            points[i] = np.sqrt(counts) @ matrix / np.sqrt(counts.sum())
    grid = ((np.tanh(points / 2) + 1) / 2 * (1 << BITS)).astype(np.int64)
    return hilbert_key(np.clip(grid, 0, (1 << BITS) - 1))


def _sequences(total: int, size: int) -> list[int]:
    """Lengths of the sequences for ``total`` tokens: full ones, then powers of two."""
    rest = total % size
    return [size] * (total // size) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, *, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids end with an end id, so empty and null texts have one token. Repeated ids are repeated
    rows, each packed; rows without id are packed with id null. A text of any length is encoded whole and cut
    into as many pieces as it needs. Extra columns are ignored. An empty table gives an empty result.
    ``tokenizer`` is the path of a tokenizers file of a kind that drops white space.
    """
    docs = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, matrix = coder(tokenizer), _projection()
        end = np.array([_END_ID], own.kind).tobytes()
        for batch in slices(batches, "text", 2 << 20):
            ids = own.ids(batch.column("text").to_pylist())
            # equal places on the curve (copies) are told apart by a hash, so that ranges can part them
            keys = (_keys(ids, own.kind, matrix) << 32) | batch.column("spread").to_numpy()
            at = np.searchsorted(bounds, keys, side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys), pa.array(at), pa.array([x + end for x in ids], pa.binary())], names=["doc_id", "key", "at", "ids"])

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        kind = coder(tokenizer).kind
        wide = np.dtype(kind).itemsize
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        at, sequence, out, held = 0, TaskContext.get().partitionId() << 32, [], []

        def piece(doc: int | None, ids: bytes, start: int, n: int, seq: int, offset: int) -> tuple:
            crc = zlib.crc32(np.frombuffer(ids, kind, n, start * wide).astype("<u4"))
            return doc, start, n, crc, len(ids) // wide, seq, offset

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[]] * 7
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                ids = ids.as_py()
                start, n = 0, len(ids) // wide
                while start < n:
                    take = min(n - start, size - at)
                    held.append((doc, ids, start, take))
                    start, at = start + take, at + take
                    if at == size:
                        offset = 0
                        for d, i, s, k in held:
                            out.append(piece(d, i, s, k, sequence, offset))
                            offset += k
                        at, sequence, held = 0, sequence + 1, []
            if out:
                yield flush()
        lengths, offset = iter(_sequences(at, size)), 0
        room = next(lengths, 0)
        for doc, ids, start, n in held:
            while n:
                take = min(n, room - offset)
                out.append(piece(doc, ids, start, take, sequence, offset))
                start, n, offset = start + take, n - take, offset + take
                if offset == room:
                    room, offset, sequence = next(lengths, 0), 0, sequence + 1
        if out:
            yield flush()

    # range bounds from a sample by id: they only balance the partitions, every document is packed in any case
    docs = docs.withColumn("spread", F.shiftrightunsigned(F.xxhash64("doc_id", F.length("text")), 32))
    found = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).first()
    n = partitions or max(MIN_RANGES, -(-(found["size"] or 0) // RANGE_BYTES))
    share = min(1.0, max(SAMPLE_DOCS, SAMPLE_PER_RANGE * n) / max(1, found["n"]))
    bounds, coded = np.zeros(0, np.int64), "doc_id long, key long, at int, ids binary"
    drawn = docs.where(F.shiftrightunsigned(F.xxhash64(F.lit(8), "doc_id", F.length("text")), 32) < int(share * (1 << 32)) + 1)
    sample = drawn.mapInArrow(encode, coded).select("key", F.octet_length("ids").alias("size")).orderBy("key").toPandas()
    if len(sample):
        weight = sample["size"].cumsum().to_numpy()
        bounds = sample["key"].to_numpy()[np.searchsorted(weight, weight[-1] * np.arange(1, n) / n)]
    coded = docs.mapInArrow(encode, coded).repartitionById(n, "at").sortWithinPartitions("key", "doc_id")
    return coded.select("doc_id", "ids").mapInArrow(lay, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
