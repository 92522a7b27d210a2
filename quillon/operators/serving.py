"""Serving: latencies, histograms, throughput, micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.order import entering, in_ranges, join_few, quantiles, within
from quillon.shared import table

#: Upper bounds of the exported histograms.
LATENCY_BUCKETS = [0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0]
BATCH_BUCKETS = [1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0]


def latency_summary(rows: DataFrame, value: str, group: str) -> DataFrame:
    """Mean, median, 95th percentile (linear), extremes."""
    out = rows.groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    out = join_few(out, quantiles(rows, value, [0.5, 0.95], [group]).select(group, "q"), [group])
    return out.select(group, "n", "mean", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"), "low", "high")


def cumulative_histogram(rows: DataFrame, value: str, bounds: list[float], group: str) -> DataFrame:
    """(group, le, n) with n the rows up to each bound, and +Inf. One pass; rows are not multiplied."""
    counts = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = rows.groupBy(group).agg(*counts, F.count("*").alias("inf"))
    cells = [F.struct(F.lit(repr(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)] + [F.struct(F.lit("+Inf").alias("le"), F.col("inf").alias("n"))]
    return wide.select(group, F.explode(F.array(*cells)).alias("c")).select(group, "c.le", "c.n")


class Closer:
    """Numbers the batches of rising arrivals: a batch closes when full or ``window_s`` after its first."""

    def __init__(self, window_s: float, most: int) -> None:
        self.window_s, self.most = window_s, most
        self.batch, self.first, self.size = -1, 0.0, 0

    def place(self, t: float) -> int:
        if self.batch < 0 or self.size == self.most or t > self.first + self.window_s:
            self.batch, self.first, self.size = self.batch + 1, t, 0
        self.size += 1
        return self.batch


def close_batches(arrivals: list[float], window_s: float, most: int) -> list[int]:
    """Batch of each arrival (rising times)."""
    closer = Closer(window_s, most)
    return [closer.place(t) for t in arrivals]


def microbatches(rows: DataFrame, shard: str, ts: str, key: str, window_s: float, most: int, **options: int) -> DataFrame:
    """The batching policy per ``shard`` (a server) over all its arrivals: (shard, key, batch), batches numbered from 0 by server.

    A pause longer than the window closes a batch whatever came before, so it parts a server's arrivals into
    stretches that do not depend on each other; each is one sorted stream, and stretches of one server run in many tasks. Where they begin, and how
    many batches lie before them, are sums over ranges. Arrivals at one time count by ``key``. Rows without a shard are a shard of
    their own; times must not be null.
    """

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, closer = None, None
        for batch in batches:
            out = []
            for place, t in zip(zip(batch.column("shard").to_pylist(), batch.column("stretch").to_pylist(), strict=True), batch.column("t").to_pylist(), strict=True):
                if closer is None or place != now:
                    now, closer = place, Closer(window_s, most)
                out.append(closer.place(t))
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("key"), batch.column("stretch"), pa.array(out, pa.int64())], names=["shard", "key", "stretch", "batch"])

    slim = rows.select(F.col(shard).cast("string").alias("shard"), F.unix_micros(F.col(ts).cast("timestamp")).cast("double").alias("us"), F.col(key).cast("long").alias("key")).withColumn("t", F.col("us") / 1e6).drop("us")
    cut = in_ranges(slim, ["shard", "t", "key"], **options)
    cut = entering(cut, "shard", {"__t": F.max_by("t", "__at")}, {"__last": F.last("__t")})
    before = F.coalesce(F.lag("t").over(within("shard")), "__last")
    cut = cut.withColumn("__starts", (before.isNull() | (F.col("t") > before + window_s)).cast("long")).drop("__last")
    cut = entering(cut, "shard", {"__n": F.sum("__starts")}, {"__earlier": F.sum("__n")})
    stretch = F.coalesce("__earlier", F.lit(0)) + F.sum("__starts").over(within("shard").rowsBetween(Window.unboundedPreceding, 0))
    dealt = cut.select("shard", "key", "t", stretch.alias("stretch")).repartition("shard", "stretch").sortWithinPartitions("shard", "stretch", "t", "key")
    closed = table(dealt.mapInArrow(replay, "shard string, key long, stretch long, batch long"), "stretches")
    # batches before a stretch: sums of blocks of stretches, then within a block
    per = closed.groupBy("shard", "stretch").agg((F.max("batch") + 1).alias("n")).withColumn("block", F.floor(F.col("stretch") / 10_000))
    blocks = per.groupBy("shard", "block").agg(F.sum("n").alias("all"))
    earlier = lambda c, *by: F.coalesce(F.sum(c).over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("shard", "block", earlier("all", "shard", "block").alias("base"))
    bases = join_few(per, blocks, ["shard", "block"]).select("shard", "stretch", (F.col("base") + earlier("n", "shard", "block", "stretch")).alias("base"))
    return join_few(closed, bases, ["shard", "stretch"]).select("shard", "key", (F.col("batch") + F.col("base")).alias("batch"))


def admitted(requests: DataFrame, context: int) -> DataFrame:
    """``requests`` (prompt_tokens, most_new) with status: ok, or too_long where prompt and answer do not fit the context."""
    fits = F.col("prompt_tokens") + F.col("most_new") <= context
    return requests.withColumn("status", F.when(fits & (F.col("most_new") > 0), "ok").otherwise("too_long"))


def finished(rows: DataFrame, ids: str, eos: int, most: str = "most_new") -> DataFrame:
    """Generated ids cut at the end id or at the row's own limit, with finish_reason (stop, length) and completion_tokens.

    The end id is part of what was generated but not of the answer; a row that reaches neither had its batch cut
    short and has reason length.
    """
    end = F.array_position(ids, F.lit(eos))
    stops = (end > 0) & (end <= F.col(most))
    kept = F.when(stops, F.slice(ids, F.lit(1), F.greatest(end - 1, F.lit(0)).cast("int"))).otherwise(F.slice(ids, F.lit(1), F.col(most)))
    return rows.withColumn("finish_reason", F.when(stops, "stop").otherwise("length")).withColumn("answer", kept).withColumn("completion_tokens", F.size("answer"))


def settled(rows: DataFrame, batch: list[str], error: str, started: str, ended: str) -> DataFrame:
    """Batches as their members see them: one member's ``error`` fails the whole batch, all share the batch's latency in seconds.

    Batches are small, so each is aggregated and joined back by its key.
    """
    per = rows.groupBy(*batch).agg(F.min(error).alias("__error"), (F.max(ended).cast("double") - F.min(started).cast("double")).alias("latency_s"))
    out = rows.join(per, batch)
    return out.withColumn("status", F.when(F.col("__error").isNull(), "done").otherwise("failed")).withColumn("reason", F.col("__error")).drop("__error")


def prometheus(rows: DataFrame, name: str, labels: list[str], value: str, kind: str = "counter", told: str = "") -> str:
    """A small result as exposition text: samples in the order of their labels, integers without a point."""
    escape = lambda x: str(x).replace("\\", r"\\").replace('"', r"\"").replace("\n", r"\n")
    show = lambda x: str(int(x)) if float(x).is_integer() else repr(float(x))
    lines = [f"# HELP {name} {told or name}", f"# TYPE {name} {kind}"]
    for r in rows.select(*labels, value).orderBy(*labels).collect():
        inner = ",".join(f'{k}="{escape(r[k])}"' for k in labels)
        lines.append(f"{name}{{{inner}}} {show(r[value])}" if inner else f"{name} {show(r[value])}")
    return "\n".join(lines) + "\n"
