"""Paired comparison of two models over the same examples."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.stats import Floors, gate, mcnemar_exact


def pair_up(baseline: DataFrame, candidate: DataFrame, key: str, value: str) -> DataFrame:
    """(key, baseline, candidate, difference); a key on one side only, or twice on one, is an error."""
    a = baseline.select(F.col(key), F.col(value).alias("baseline")).groupBy(key).agg(F.count("*").alias("__a"), F.first("baseline").alias("baseline"))
    b = candidate.select(F.col(key), F.col(value).alias("candidate")).groupBy(key).agg(F.count("*").alias("__b"), F.first("candidate").alias("candidate"))
    both = a.join(b, key, "full_outer")
    same = (F.col("__a") == 1) & (F.col("__b") == 1)
    checked = F.when(F.coalesce(same, F.lit(False)), F.col("candidate").cast("double") - F.col("baseline").cast("double")).otherwise(F.raise_error(F.concat(F.lit("key not paired one to one: "), F.col(key).cast("string"))).cast("double"))
    return both.select(key, "baseline", "candidate", checked.alias("difference"))


def discordant(pairs: DataFrame, group: list[str] | None = None) -> DataFrame:
    """(lost, gained) of boolean sides."""
    return pairs.groupBy(*(group or [])).agg(F.count_if(F.col("baseline") & ~F.col("candidate")).alias("lost"), F.count_if(~F.col("baseline") & F.col("candidate")).alias("gained"), F.count("*").alias("n"))


def dense_index(rows: DataFrame, key: str, block: int = 10_000) -> DataFrame:
    """``rows`` with idx, 0, 1, .. in the order of the whole-number ``key``.

    Rows are numbered within blocks of keys; only the blocks' sizes are summed in one task.
    """
    rows = rows.withColumn("__block", F.floor(F.col(key) / block))
    sizes = rows.groupBy("__block").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__block", F.coalesce(before, F.lit(0)).alias("__offset"))
    at = F.row_number().over(Window.partitionBy("__block").orderBy(key)) - 1
    return rows.withColumn("__at", at).join(offsets, "__block").withColumn("idx", F.col("__offset") + F.col("__at")).drop("__block", "__at", "__offset")


#: Indices of a block, numbered in 16 bits; indices drawn at a time; resamples whose draws meet a block's values in one group.
BLOCK, DRAWS, TOGETHER = 1 << 16, 50_000, 128


def _drawn(rows: DataFrame, n: int, resamples: int, seed: int) -> DataFrame:
    """(resample, block, drawn): the indices that each resample draws from n, in pieces, packed as 16-bit places within their block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, numbers, edges = None, [], np.arange(0, n + BLOCK, BLOCK)
        for batch in batches:
            for unit in batch.column("id").to_pylist():
                stretch, resample = divmod(unit, resamples)
                if stretch != at:
                    at, numbers = stretch, [str(i).encode() for i in range(stretch * DRAWS, min(n, (stretch + 1) * DRAWS))]
                head = f"{seed}:{resample}:".encode()
                # the draw of functions.draws: the first eight hexadecimal digits of an MD5
                told = np.frombuffer(b"".join([hashlib.md5(head + i, usedforsecurity=False).digest() for i in numbers]), ">u4")[::4].astype(np.int64) % n
                told.sort()
                ends = np.searchsorted(told, edges)
                blocks = np.flatnonzero(np.diff(ends))
                packed = (told % BLOCK).astype("<u2")
                pieces = [packed[ends[k] : ends[k + 1]].tobytes() for k in blocks]
                yield pa.RecordBatch.from_arrays([pa.array([resample] * len(blocks), pa.int64()), pa.array(blocks, pa.int64()), pa.array(pieces, pa.binary())], names=["resample", "block", "drawn"])

    return rows.mapInArrow(run, "resample long, block long, drawn binary")


def _met(draws: pa.Table, values: pa.Table) -> pa.Table:
    """(resample, s, k): sum and number of the values that draws of one block meet; a place without a value adds nothing."""
    v, there = np.zeros(BLOCK), np.zeros(BLOCK, np.int64)
    places = values["at"].to_numpy()
    v[places], there[places] = values["v"].to_numpy(), 1
    found = [np.frombuffer(piece.as_buffer(), "<u2") for piece in draws["drawn"]]
    return pa.table({"resample": draws["resample"], "s": pa.array([float(v[i].sum()) for i in found], pa.float64()), "k": pa.array([int(there[i].sum()) for i in found], pa.int64())})


def bootstrap_interval(rows: DataFrame, value: str, index: str, resamples: int, confidence: float, seed: int) -> DataFrame:
    """(point, low, high): percentile bootstrap of the mean with drawn indices; ``index`` numbers the rows from 0.

    Each draw is made once and goes to the block of its index in two bytes, where it meets the block's values. A group
    is a block and some resamples, so neither values nor draws are ever whole in one place. Null values do not count.
    """
    spark, n = rows.sparkSession, rows.count()
    units = resamples * -(-n // DRAWS)
    tasks = max(spark.sparkContext.defaultParallelism, resamples * n // 2_000_000 + 1)
    part = F.floor(F.col("resample") / TOGETHER).alias("part")
    draws = _drawn(spark.range(0, units, 1, tasks), n, resamples, seed).select("*", part)
    held = rows.select(F.col(index).cast("long").alias("i"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    held = held.select(F.floor(F.col("i") / BLOCK).alias("block"), F.pmod("i", F.lit(BLOCK)).alias("at"), "v")
    held = held.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((resamples - 1) // TOGETHER).cast("long"))))
    sums = draws.groupBy("block", "part").cogroup(held.groupBy("block", "part")).applyInArrow(_met, "resample long, s double, k long")
    means = sums.groupBy("resample").agg((F.sum("s") / F.nullif(F.sum("k"), F.lit(0))).alias("m"))
    tail = (1 - confidence) / 2
    ends = means.agg(F.percentile("m", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"))
    return rows.agg(F.avg(F.col(value).cast("double")).alias("point")).join(F.broadcast(ends), how="inner").select("point", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


#: Cumulative probabilities of a Poisson variable of mean 1, times 2^32 and rounded down.
_POISSON = [1580030168, 3160060337, 3950075421, 4213413783, 4279248373, 4292415291, 4294609777, 4294923276, 4294962463, 4294966817, 4294967252, 4294967292]


def _poisson(head: Column) -> Column:
    """The weight that eight hexadecimal digits stand for; of fixed width they compare like the number they write."""
    weight = F.when(head < f"{_POISSON[0]:08x}", 0)
    for i, c in enumerate(_POISSON[1:], 1):
        weight = weight.when(head < f"{c:08x}", i)
    return weight.otherwise(len(_POISSON))


def poisson_weight(key: Column) -> Column:
    """How often a row stands in a resample, drawn by the MD5 of ``key``: about Poisson of mean 1, 12 at most."""
    return _poisson(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8))


def bootstrap_metric(rows: DataFrame, key: str, metric: Callable[[Column], Column], resamples: int, confidence: float, seed: int) -> DataFrame:
    """(point, low, high): percentile bootstrap of any metric that sums over weighted rows.

    ``metric`` makes an aggregate from a column of weights, for instance ``sum(w * ok) / sum(w)``. A row's weight
    in a resample is drawn from its ``key`` alone, so no index, no join and no exchange of rows is needed: tasks
    aggregate each resample and send one row of it. Resamples without rows or with an undefined metric drop out.
    """
    point = rows.agg(metric(F.lit(1)).alias("point"))
    # a small table comes in one piece, but is drawn from many times: it is spread over the cores, some ten million draws a task
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() * resamples // 10_000_000)
    drawn = rows.repartition(parts).withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    # a column of its own, so that the digest is taken once a row and resample; rows of weight 0 add nothing to a sum
    told = F.concat_ws(":", F.lit(str(seed)), F.col("__b").cast("string"), F.col(key).cast("string"))
    drawn = drawn.withColumn("__u", F.substring(F.md5(told.cast("binary")), 1, 8)).withColumn("__w", _poisson(F.col("__u")))
    tail = (1 - confidence) / 2
    ends = drawn.groupBy("__b").agg(metric(F.col("__w")).alias("m")).agg(F.percentile("m", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"))
    return point.join(F.broadcast(ends), how="inner").select("point", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def slice_deltas(pairs: DataFrame, slice_col: str, tolerance: float) -> DataFrame:
    """Means of both sides per slice; regressed if the difference falls short by more than ``tolerance``."""
    out = pairs.groupBy(slice_col).agg(F.count("*").alias("n"), F.avg(F.col("baseline").cast("double")).alias("baseline_rate"), F.avg(F.col("candidate").cast("double")).alias("candidate_rate"))
    delta = F.col("candidate_rate") - F.col("baseline_rate")
    return out.withColumn("delta", delta).withColumn("regressed", delta < -tolerance)


def field_deltas(baseline: DataFrame, candidate: DataFrame, least_support: int, tolerance: float) -> DataFrame:
    """Recall per field of both sides (columns stem, expected, recall); regressed only with enough support."""
    a = baseline.select("stem", F.col("expected").alias("e0"), F.col("recall").alias("baseline_recall"))
    b = candidate.select("stem", F.col("expected").alias("e1"), F.col("recall").alias("candidate_recall"))
    out = a.join(b, "stem").withColumn("support", F.least("e0", "e1")).drop("e0", "e1")
    return out.withColumn("regressed", (F.col("support") >= least_support) & (F.col("baseline_recall") - F.col("candidate_recall") > tolerance))


def decide(summary: DataFrame, floors: Floors = Floors()) -> DataFrame:
    """``summary`` (n, json_rate, schema_rate, slices_down, fields_down, low, lost, gained) with p_value, decision, reasons."""
    out = summary.withColumn("p_value", mcnemar_exact(F.col("lost"), F.col("gained")))
    decision, reasons = gate(*(F.col(c) for c in ("n", "json_rate", "schema_rate", "slices_down", "fields_down", "low", "p_value")), floors)
    return out.withColumn("decision", decision).withColumn("reasons", reasons)


def verdict(low: Column, high: Column, margin: float) -> tuple[Column, Column, Column]:
    """(non-inferior, superior, inferior) from an interval."""
    return low > -margin, low > 0, high <= -margin
