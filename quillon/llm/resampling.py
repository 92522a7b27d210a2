"""Importance resampling towards a target distribution, by an external sort and count.

Every text is read once: its hashed n-gram features, buckets of 16 bits, are written as packed streams with the
documents' offsets into them. A stream is sorted and run-length encoded for its counts; the runs of all streams
are summed by bucket. The gains of the buckets, log ratios of target to source frequency, are then gathered along
the same streams and summed between the offsets. Perturbed by Gumbel noise from a document's id, the sums rank the
documents: the highest are a sample without replacement by importance.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.order import global_position

from .common import pick, slices, table

BUCKETS, LONGEST, SEED = 10_000, 3, 42
#: Words that a document needs to be drawn; percent of those documents that are drawn.
LEAST_WORDS, PERCENT = 20, 5
#: Features of a packed stream, about; a longer document has a stream of its own.
STREAM_FEATURES = 1 << 21
#: Bytes of words as they are (A-Z become a-z), all others as spaces: a word is digits, letters and whatever is not ASCII.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_STREAMS = "ids binary, nulls binary, words binary, offsets binary, stream binary"


def buckets(text: bytes, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[int, np.ndarray]:
    """(words, bucket of every run of 1 to ``longest`` words) of a text in UTF-8: crc32 of the run, words joined by a space.

    The checksum of a longer run goes on from that of the shorter one before its last word.
    """
    words = text.translate(_FOLD).split()
    if not words:
        return 0, np.zeros(0, np.uint16)
    run = list(map(zlib.crc32, words))
    sums, later = [run], [b" " + w for w in words]
    for k in range(1, min(longest, len(words))):
        run = list(map(zlib.crc32, later[k:], run))
        sums.append(run)
    return len(words), np.concatenate([np.fromiter(s, np.uint32, len(s)) for s in sums]) % np.uint32(buckets)


def write_streams(texts: DataFrame, name: str, buckets_: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """The packed streams of ``texts`` (doc_id long, text): a row holds the features of some documents and where each one's begin."""
    kind = np.dtype("<u2" if buckets_ <= 1 << 16 else "<u4")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, sizes, streams, held = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held
            parts = [np.array([i or 0 for i in ids], "<i8"), np.packbits([i is None for i in ids]), np.array(words, "<i8"), np.cumsum([0, *sizes], dtype="<i8"), np.concatenate(streams)]
            for x in (ids, words, sizes, streams):
                x.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], names=["ids", "nulls", "words", "offsets", "stream"])

        for batch in slices(batches, "text", 2 << 20):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                n, found = buckets((text or "").encode(), buckets_, longest)
                ids.append(doc)
                words.append(n)
                sizes.append(len(found))
                streams.append(found.astype(kind))
                held += len(found)
                if held >= STREAM_FEATURES or len(ids) >= 100_000:
                    yield flush()
        if ids:
            yield flush()

    return table(texts.mapInArrow(scan, _STREAMS), name)


def count_streams(streams: DataFrame, buckets_: int = BUCKETS) -> DataFrame:
    """(bucket, n): every stream is sorted and run-length encoded, the runs of all are summed."""
    kind = "<u2" if buckets_ <= 1 << 16 else "<u4"

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column("stream"):
                ordered = np.sort(np.frombuffer(packed.as_py(), kind), kind="stable")
                first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])
                yield pa.RecordBatch.from_arrays([pa.array(ordered[first].astype(np.int64)), pa.array(np.diff(np.append(first, len(ordered))).astype(np.int64))], names=["bucket", "n"])

    return streams.select("stream").mapInArrow(runs, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets_: int = BUCKETS) -> np.ndarray:
    """A bucket's gain: 1000 times the log ratio of its smoothed frequencies in ``target`` and ``source``, rounded down."""
    s, t = np.zeros(buckets_, np.int64), np.zeros(buckets_, np.int64)
    for counts, rows in ((s, source), (t, target)):
        for r in rows.collect():  # a row a bucket at most
            counts[r["bucket"]] = r["n"]
    all_s, all_t = int(s.sum()), int(t.sum())
    return np.array([math.floor(1000 * math.log((int(b) + 1) * (all_s + buckets_) / ((int(a) + 1) * (all_t + buckets_)))) for a, b in zip(s, t, strict=True)], np.int64)


def weigh_streams(streams: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, words, n_features, weight): the gains along the streams, summed between the documents' offsets."""
    kind = "<u2" if len(gain) <= 1 << 16 else "<u4"

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, nulls, words, offsets, stream = (np.frombuffer(batch.column(c)[i].as_py(), k) for c, k in (("ids", "<i8"), ("nulls", np.uint8), ("words", "<i8"), ("offsets", "<i8"), ("stream", kind)))
                sizes = np.diff(offsets)
                weight = np.zeros(len(ids), np.int64)
                some = np.flatnonzero(sizes)  # reduceat would give an empty span the entry at its start
                if len(some):
                    weight[some] = np.add.reduceat(gain[stream], offsets[some])
                null = np.unpackbits(nulls, count=len(ids)).astype(bool)
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=null), pa.array(words), pa.array(sizes), pa.array(weight)], names=["doc_id", "words", "n_features", "weight"])

    return streams.mapInArrow(gather, "doc_id long, words long, n_features long, weight long")


def _noise(seed: int) -> Column:
    """1000 times a Gumbel variable from the id, rounded down."""
    told = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(told, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets_: int = BUCKETS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score, rank (from 1, the highest score first; null if not drawn).

    Drawn are floor(percent * N / 100) of the N documents with at least ``least_words`` words, ties to the
    smaller doc_id (null before all). Null and empty texts, and texts without a word, have no feature and weight 0.
    Repeated rows are documents of their own, with equal scores. Texts of any length are read whole; extra columns are ignored. An
    empty ``docs`` gives an empty result; an empty ``target`` has frequency 0 everywhere.
    """
    docs = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    wanted = pick(target, text=target_col).select(F.lit(None).cast("long").alias("doc_id"), "text")
    streams = write_streams(docs, "resample-streams", buckets_, longest)
    gain = gains(count_streams(streams, buckets_), count_streams(write_streams(wanted, "resample-target", buckets_, longest), buckets_), buckets_)
    scored = table(weigh_streams(streams, gain).withColumn("score", F.col("weight") + _noise(seed)), "resample-scores")
    fit = scored.where(F.col("words") >= least_words)
    ranked = global_position(fit, [F.desc("score"), F.asc_nulls_first("doc_id")], "rank")
    drawn = percent * fit.count() // 100
    ranked = ranked.withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1))
    rest = scored.where(F.col("words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
