"""Token ids in binary files: encode, write in the order of the ids, read back, look up.

Documents are encoded where they are read; the packed ids go to ranges of doc_id, and every range is written, in
order, as shards of a bounded number of tokens, each a wavelet matrix in one file (``wavelet``). A file is written under another
name first and then renamed, and its name and bytes depend on nothing but the range, so a task that runs twice
writes the same files. A manifest has the tokens of every shard; what lies before a shard is a sum over the manifest.
"""

from __future__ import annotations

import os
import re
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pick, shared_path, slices, table
from .wavelet import Shard, write_shard

#: Tokens of a shard, about (documents are never split between shards); bytes of text in a range; ranges at least and at most.
SHARD_TOKENS, RANGE_BYTES, MIN_RANGES, MOST_RANGES = 1 << 20, 32 << 20, 24, 50_000
#: Words that a worker keeps encoded, twice: when so many are new, those from before make room.
CACHE_WORDS = 400_000
_TIES = 1 << 20


class ByteCoder(dict):
    """ids() is exactly ``tokenizer.encode(text, add_special_tokens=False)`` of a byte-level BPE, packed.

    Such a tokenizer parts a text into words by a fixed pattern and merges each by itself; words are merged when
    first met and kept. For texts of ASCII and Latin letters the pattern is spelled out for their characters, for further
    letters up to U+04FF and common marks it is the pattern itself. Other texts, and those that hold the name of a special token, are parted only
    before a space and an ASCII letter or digit, where every word begins anew, and go through the whole tokenizer.
    """

    _SAFE = bytes([10, *range(32, 127), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])
    _WORDS = re.compile("'(?:[stmd]|re|ve|ll)| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[!-/:-@\\[-`{-~]+|\\s+(?!\\S)|\\s+")
    _ANY = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")  # fixed: the vocabulary's own pattern
    _RARE = re.compile("[^\t-\r -\u04ff\u2010-\u2027\u2030-\u205e\u20ac]")
    _PARTS = re.compile(r"(?= [0-9A-Za-z])")

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(file)
        self.model = self.tokenizer.model
        size = self.tokenizer.get_vocab_size()
        self.bits = max(1, (size - 1).bit_length())
        self.kind, self.code = ("<u2", "H") if size <= 1 << 16 else ("<u4", "I")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed: bytes that stand for themselves in such vocabularies
        rest = (b for b in range(256) if b not in plain)
        self.letters = str.maketrans({chr(b): chr(b) for b in plain} | {chr(b): chr(256 + i) for i, b in enumerate(rest)})
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: What was kept before the words became too many: a word that is met again comes back from there.
        self.older: dict[str, bytes] = {}

    def _pack(self, ids: list[int]) -> bytes:
        packed = array(self.code, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def __missing__(self, word: str) -> bytes:
        packed = self.older.get(word)
        if packed is None:
            mapped = word.encode().decode("latin-1").translate(self.letters)
            packed = self._pack([t.id for t in self.model.tokenize(mapped)])
        if len(self) >= CACHE_WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = packed
        return packed

    def _words(self, text: str) -> list[str] | None:
        if any(s in text for s in self.special):
            return None
        try:
            if not text.encode("latin-1").translate(None, self._SAFE):
                return self._WORDS.findall(text)
        except UnicodeEncodeError:
            pass
        return None if self._RARE.search(text) else self._ANY.findall(text)

    def ids(self, text: str) -> bytes:
        words = self._words(text)
        if words is None:
            return b"".join([self._pack(self.tokenizer.encode(part, add_special_tokens=False).ids) for part in self._PARTS.split(text)])
        return b"".join(map(self.__getitem__, words))


@lru_cache(maxsize=1)
def coder(file: str) -> ByteCoder:
    """One per worker process, so that the words outlive a task."""
    return ByteCoder(file)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS, ranges: int | None = None) -> tuple[str, DataFrame]:
    """(folder, manifest): the ids of all ``docs``, each document ended by ``end_id``, in ascending order of its id, as shards.

    The manifest has a row per shard: range, shard, docs, tokens. Documents without an id come first; documents that share an
    id stand next to each other in an order of no meaning. Null texts are empty: they have the end id alone. A
    text of any length is encoded whole and lies in one shard, however long. Extra columns are ignored. No rows:
    no shards. ``path`` (by default below spark.checkpoint.dir) must be one that pyarrow's file systems reach from everywhere.
    """
    docs = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    # rows of one id, and rows without, may be many: they are spread by where they were read
    docs = docs.withColumn("tie", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(_TIES)))
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)).cast("long")).cast("double") * _TIES + F.col("tie")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = ranges or max(MIN_RANGES, min(MOST_RANGES, -(-size // RANGE_BYTES)))
    cuts = docs.agg(F.percentile_approx(key, [i / n for i in range(1, n)], max(10_000, 10 * n))).first()[0] if n > 1 else None
    bounds = np.array(sorted(cuts or []), float)
    path = path or shared_path(docs.sparkSession, "tokens")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(tokenizer)
        end = np.array([end_id], own.kind).tobytes()
        for batch in slices(batches, "text", 2 << 20):
            ids = [own.ids(t) + end for t in batch.column("text").to_pylist()]
            at = np.searchsorted(bounds, batch.column("key").to_numpy(), side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(at), pa.array(ids, pa.binary())], names=["doc_id", "tie", "at", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, at, done = coder(tokenizer), TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, bytes]] = []
        tokens, wide = 0, np.dtype(own.kind).itemsize

        def close() -> pa.RecordBatch:
            nonlocal tokens, done
            ids = np.frombuffer(b"".join(x for _, x in held), own.kind)
            _put(f"{path}/shard-{at:06d}-{done:06d}.wm", write_shard(ids, own.bits, [d for d, _ in held], np.array([len(x) // wide for _, x in held])))
            row = [[at], [done], [len(held)], [tokens]]
            tokens, done = 0, done + 1
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in row], names=["range", "shard", "docs", "tokens"])

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                ids = ids.as_py()
                held.append((doc, ids))
                tokens += len(ids) // wide
                if tokens >= shard_tokens:
                    yield close()
        if held:
            yield close()

    coded = docs.withColumn("key", key).mapInArrow(encode, "doc_id long, tie long, at int, ids binary")
    dealt = coded.repartitionById(n, "at").sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie").select("doc_id", "ids")
    return path, table(dealt.mapInArrow(write, "range long, shard long, docs long, tokens long"), "tokens-manifest")


def _put(path: str, data: bytes) -> None:
    """Write a file whole or not at all."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
    own = f"{at}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(own) as out:
        out.write(data)
    store.move(own, at)


def _bases(manifest: DataFrame) -> DataFrame:
    """(range, shard, base): the tokens of all shards before. Ranges are summed first; only their sums are put in one order."""
    per = manifest.groupBy("range").agg(F.sum("tokens").alias("tokens"))
    before = F.sum("tokens").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = per.select("range", F.coalesce(before, F.lit(0)).alias("first"))  # MOST_RANGES rows at most
    own = F.sum("tokens").over(Window.partitionBy("range").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return manifest.withColumn("own", F.coalesce(own, F.lit(0))).join(ranges, "range").select("range", "shard", (F.col("first") + F.col("own")).alias("base"))


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(range, shard, content) of the shards of a folder."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.wm").load(path)
    name = lambda i: F.regexp_extract("path", r"shard-(\d+)-(\d+)\.wm$", i).cast("long")
    return found.select(name(1).alias("range"), name(2).alias("shard"), "content")


def read_tokens(spark: SparkSession, path: str, manifest: DataFrame, *, with_ids: bool = True) -> DataFrame:
    """One row per document of the files below ``path``: doc_id, start, n_tokens, ids_crc32 and ids (binary, little-endian unsigned 32-bit).

    ``start`` is the number of ids of all documents before it. A manifest without rows gives an empty result; a
    damaged file is an error.
    """
    kind = "doc_id long, local long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    if not manifest.head(1):
        return spark.createDataFrame([], kind.replace("local", "start"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["range", "shard", "doc_id", "local", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch.column("content")[i].as_buffer())
                ids, lengths = shard.ids.decode().astype("<u4"), shard.lengths()
                ends = np.cumsum(lengths)
                starts, docs = ends - lengths, shard.doc_ids()
                for a in range(0, len(docs), 10_000):
                    part = slice(a, a + 10_000)
                    own = [ids[s:e] for s, e in zip(starts[part], ends[part], strict=True)]
                    cols = [pa.array([batch.column(c)[i].as_py()] * len(own), pa.int64()) for c in ("range", "shard")]
                    cols += [pa.array(docs[part], pa.int64()), pa.array(starts[part]), pa.array(lengths[part]), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols + [pa.array([x.tobytes() for x in own], pa.binary())] * with_ids, names=names)

    rows = _files(spark, path).mapInArrow(scan, f"range long, shard long, {kind}")
    # the bases, three numbers a shard of a million tokens, meet the documents' numbers, not the files
    return rows.join(_bases(manifest), ["range", "shard"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def token_digest(docs: DataFrame, tokenizer: str, end_id: int, **options: int) -> DataFrame:
    """Write all ``docs`` as token files and read the files back: doc_id, start, n_tokens, ids_crc32 of each document (cases: see ``write_tokens``)."""
    path, manifest = write_tokens(docs, tokenizer, end_id, **options)
    return read_tokens(docs.sparkSession, path, manifest, with_ids=False)


def count_tokens(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """(token, n) over the files below ``path`` by rank alone: nothing is decoded. Tokens that never occur have 0."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch.column("content")[i].as_buffer())
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([shard.ids.count(t) for t in tokens], pa.int64())], names=["token", "n"])

    return _files(spark, path).select("content").mapInArrow(scan, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def find_tokens(spark: SparkSession, path: str, manifest: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, doc_id, at): every occurrence of ``tokens``, by select; ``at`` counts from the start of its document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch.column("content")[i].as_buffer())
                ends, docs = np.cumsum(shard.lengths()), shard.doc_ids()
                for token in tokens:
                    for first in range(0, n := shard.ids.count(token), 10_000):
                        places = np.array([shard.ids.select(token, k) for k in range(first, min(n, first + 10_000))])
                        doc = np.searchsorted(ends, places, side="right")
                        starts = np.where(doc > 0, ends[doc - 1], 0)
                        yield pa.RecordBatch.from_arrays([pa.array([token] * len(places), pa.int64()), pa.array([docs[d] for d in doc], pa.int64()), pa.array(places - starts, pa.int64())], names=["token", "doc_id", "at"])

    if not manifest.head(1):
        return spark.createDataFrame([], "token long, doc_id long, at long")
    return _files(spark, path).select("content").mapInArrow(scan, "token long, doc_id long, at long")
