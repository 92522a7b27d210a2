"""Flat token files: little-endian 16-bit ids, nothing else, as a Spark data source.

``spark.read.format("flat_tokens").load(path)`` gives (file, pos, ids) in blocks; a file is read by byte ranges, each by a
task of its own. ``df.write.format("flat_tokens").option("vocab_size", n).save(path)`` takes rows (ids) and writes a file a task;
files count only once the whole job has committed, and ``_tokens.json`` then names them, in order, with their numbers of tokens.
Call ``register(spark)`` first.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from quillon.operators.order import in_ranges

BLOCK, SPLIT = 1024, 32 << 20
LIST = "_tokens.json"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


def _list(uri: str) -> list[tuple[str, int]]:
    """(URI, bytes) of a file, or of the token files right below a folder in the order of their names."""
    store, at = _open(uri)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    lead = uri.rstrip("/").removesuffix(at.rstrip("/"))
    found = [info] if info.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(at)) if f.base_name.endswith(".bin")]
    return sorted((lead + f.path, f.size) for f in found)


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, block: int, split: int, vocab: int | None) -> None:
        self.path, self.block, self.vocab = path, block, vocab
        self.split = max(1, split // (2 * block)) * 2 * block  # ranges end where blocks end

    def partitions(self) -> list[Range]:
        files = _list(self.path)
        odd = [f for f, n in files if n % 2]
        if odd:
            raise ValueError(f"a token file has two bytes a token: {odd[0]}")
        return [Range(f, a, min(a + self.split, n)) for f, n in files for a in range(0, n, self.split)] or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.file:
            return
        store, at = _open(part.file)
        with store.open_input_file(at) as f:
            f.seek(part.start)
            for a in range(part.start, part.end, 2 * self.block * 256):
                flat = np.frombuffer(f.read(min(2 * self.block * 256, part.end - a)), "<u2").astype(np.int32)
                if self.vocab and len(flat) and flat.max() >= self.vocab:
                    raise ValueError(f"{part.file}: id {flat.max()} outside the vocabulary of {self.vocab}")
                cuts = np.append(np.arange(0, len(flat), self.block), len(flat))
                ids = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat))
                n = len(cuts) - 1
                yield pa.RecordBatch.from_arrays([pa.array([part.file] * n, pa.string()), pa.array(a // 2 + cuts[:-1], pa.int64()), ids], names=["file", "pos", "ids"])


@dataclass
class Part(WriterCommitMessage):
    number: int
    name: str
    tokens: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, vocab: int, overwrite: bool) -> None:
        if not 0 < vocab <= 1 << 16:
            raise ValueError("ids must fit 16 bits: give vocab_size, 65536 at most")
        self.path, self.vocab, self.run = path.rstrip("/"), vocab, uuid.uuid4().hex
        store, at = _open(self.path)
        if not overwrite and any(x.base_name == LIST for x in store.get_file_info(_selector(at))):
            raise FileExistsError(f"{path} holds token files")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        number, tokens = TaskContext.get().partitionId(), 0
        name = f"{uuid.uuid4().hex}.part"
        store, at = _open(self.path)
        store.create_dir(f"{at}/_{self.run}", recursive=True)
        with store.open_output_stream(f"{at}/_{self.run}/{name}") as out:
            for batch in batches:
                column = batch.column("ids")
                flat = column.flatten() if column.null_count == 0 else column.drop_null().flatten()
                if flat.null_count:
                    raise ValueError("an id is null")
                values = flat.to_numpy(zero_copy_only=False)
                if len(values) and (values.min() < 0 or values.max() >= self.vocab):
                    raise ValueError(f"an id is outside the vocabulary of {self.vocab}")
                out.write(values.astype("<u2").tobytes())
                tokens += len(values)
        return Part(number, name, tokens)

    def commit(self, messages: list[Part | None]) -> None:
        store, at = _open(self.path)
        store.create_dir(at, recursive=True)
        told = []
        for m in sorted((m for m in messages if m), key=lambda m: m.number):
            name = f"part-{m.number:06d}-{self.run}.bin"
            store.move(f"{at}/_{self.run}/{m.name}", f"{at}/{name}")
            told.append({"file": name, "tokens": m.tokens})
        for old in store.get_file_info(_selector(at)):
            if old.base_name.endswith(".bin") and self.run not in old.base_name:
                store.delete_file(old.path)
        with store.open_output_stream(f"{at}/{LIST}") as out:
            out.write(json.dumps({"vocab_size": self.vocab, "tokens": sum(x["tokens"] for x in told), "files": told}, indent=2, sort_keys=True).encode())
        self.abort([])

    def abort(self, messages: list[Part | None]) -> None:
        store, at = _open(self.path)
        if store.get_file_info(f"{at}/_{self.run}").type.name == "Directory":
            store.delete_dir(f"{at}/_{self.run}")


def _selector(at: str) -> fs.FileSelector:
    return fs.FileSelector(at, allow_not_found=True)


class FlatTokens(DataSource):
    @classmethod
    def name(cls) -> str:
        return "flat_tokens"

    def schema(self) -> str:
        return "file string, pos long, ids array<int>"

    def reader(self, schema: StructType) -> DataSourceReader:
        o = self.options
        return _Reader(o["path"], int(o.get("block", BLOCK)), int(o.get("split", SPLIT)), int(o["vocab_size"]) if "vocab_size" in o else None)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], int(self.options.get("vocab_size", 0)), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FlatTokens)


def write_tokens(rows: DataFrame, ids: str, order: list[str], path: str, vocab_size: int, mode: str = "append") -> int:
    """Write the arrays of column ``ids`` one after another, in ``order``, as flat token files; the number of tokens.

    Null arrays are left out. An id that is null or outside the vocabulary is an error, and so are files that are already there,
    unless ``mode`` is overwrite. Files in the order of their names, and ids within, stand in ``order``.
    """
    spark = rows.sparkSession
    register(spark)
    cut = in_ranges(rows.select(*(F.col(c).alias(f"__o{i}") for i, c in enumerate(order)), F.col(ids).cast("array<int>").alias("ids")), [f"__o{i}" for i in range(len(order))])
    n = (cut.agg(F.max("__range")).first()[0] or 0) + 1
    dealt = cut.repartitionById(n, F.col("__range").cast("int")).sortWithinPartitions("__at").select("ids")
    dealt.write.format("flat_tokens").option("vocab_size", vocab_size).mode(mode).save(path)
    return token_count(path)


def token_count(path: str) -> int:
    store, at = _open(path)
    with store.open_input_file(f"{at.rstrip('/')}/{LIST}") as f:
        return json.loads(f.read())["tokens"]


def read_tokens(spark: SparkSession, path: str, block: int = BLOCK, split: int = SPLIT, vocab_size: int | None = None) -> DataFrame:
    """(file, pos, ids) in blocks of ``block`` ids (the last of a file may be shorter); pos counts tokens from the start of the file."""
    register(spark)
    options = {"block": block, "split": split} | ({"vocab_size": vocab_size} if vocab_size else {})
    return spark.read.format("flat_tokens").options(**options).load(path)


def write_split(rows: DataFrame, text: str, order: list[str], encode: Column | None, path: str, val_fraction: float, vocab_size: int) -> dict[str, int]:
    """Each text cut in two (``corpus.contiguous_split``), both parts encoded and written to train and val below ``path``; tokens of each.

    ``encode`` makes ids from a column called ``part``; by default its UTF-8 bytes.
    """
    from quillon.operators.corpus import byte_ids, contiguous_split

    encode = byte_ids(F.col("part")) if encode is None else encode
    both = contiguous_split(rows.select(*order, F.col(text).alias("__text")), "__text", val_fraction)
    return {side: write_tokens(both.withColumn("part", F.col(side)).withColumn("__ids", encode).select(*order, "__ids"), "__ids", order, f"{path.rstrip('/')}/{side}", vocab_size) for side in ("train", "val")}
