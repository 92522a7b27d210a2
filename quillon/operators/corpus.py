"""Corpus preparation: splits, windows, word and byte-pair counts, dataset digests."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.draws import draw
from quillon.operators.order import join_few, quantiles
from quillon.shared import table

#: Fixed value: words with a leading space, numbers, marks, white space (all but its last before a word).
PRETOKENS = r" ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"


def contiguous_split(rows: DataFrame, text: str, val_fraction: float) -> DataFrame:
    """Each text cut at int(characters * (1 - val_fraction)): columns train and val."""
    if not 0 < val_fraction < 1:
        raise ValueError("val_fraction lies between 0 and 1")
    cut = (F.length(text) * F.lit(1 - val_fraction)).cast("int")
    return rows.withColumn("train", F.col(text).substr(F.lit(1), cut)).withColumn("val", F.col(text).substr(cut + 1, F.length(text)))


def stratified_split(rows: DataFrame, key: str, label: str, val_fraction: float, test_fraction: float, seed: int) -> DataFrame:
    """``rows`` with a column split: per label, in an order drawn by the key, first test, then val, the rest train.

    Sizes round half to even. The order is that of an MD5 of seed and key. Rows are numbered within the 4,096
    blocks of a label that share the first digits of it; only the blocks' sizes are summed by label.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    drawn = rows.withColumn("__order", order).withColumn("__block", F.coalesce(F.substring("__order", 1, 3), F.lit("")))
    sizes = drawn.groupBy(F.col(label).alias("__label"), F.col("__block").alias("__of")).agg(F.count("*").alias("__rows"))
    w = Window.partitionBy("__label")
    before = F.sum("__rows").over(w.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("__label", "__of", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__rows").over(w).alias("__all"))
    drawn = drawn.withColumn("__at", F.row_number().over(Window.partitionBy(label, "__block").orderBy("__order", key)))
    placed = drawn.join(sizes, F.col(label).eqNullSafe(F.col("__label")) & (F.col("__block") == F.col("__of")))
    at, n = F.col("__before") + F.col("__at"), F.col("__all")
    test, val = F.bround(n * F.lit(test_fraction)).cast("long"), F.bround(n * F.lit(val_fraction)).cast("long")
    out = placed.withColumn("split", F.when(at <= test, "test").when(at <= test + val, "val").otherwise("train"))
    return out.drop("__order", "__block", "__label", "__of", "__before", "__all", "__at")


def even_allocation(total: int, bucket: Column, buckets: int) -> Column:
    """Size of a bucket (numbered from 0) when ``total`` is dealt evenly, the remainder to the first."""
    return F.lit(total // buckets) + F.when(bucket < total % buckets, 1).otherwise(0)


def context_windows(tokens: Column, block: int) -> Column:
    """All (start, x, y) of ``block`` tokens, y one further than x; there are size - block of them."""
    count = F.size(tokens) - block
    starts = F.when(count > 0, F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(tokens, s + 1, block).alias("x"), F.slice(tokens, s + 2, block).alias("y")))


def sampled_starts(key: Column, count: Column, draws: int, seed: int) -> Column:
    """``draws`` window starts below ``count``, drawn by key and number."""
    return F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda i: draw(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), i.cast("string")), count))


def word_frequencies(rows: DataFrame, text: str, pattern: str = PRETOKENS) -> DataFrame:
    """(word, n): how often each pretoken occurs; partial sums run before the shuffle."""
    return rows.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def byte_ids(word: Column) -> Column:
    """The bytes of a word as numbers: read as Latin-1, every byte is one character of the same number."""
    chars = F.filter(F.split(F.decode(word.cast("binary"), "ISO-8859-1"), ""), lambda c: c != "")
    return F.transform(chars, F.ascii)


def pair_counts(words: DataFrame) -> DataFrame:
    """(left, right, n) of adjacent ids over ``words`` (ids, n)."""
    pairs = F.explode(F.arrays_zip(F.slice("ids", F.lit(1), F.size("ids") - 1), F.slice("ids", F.lit(2), F.size("ids") - 1)))
    return words.where(F.size("ids") > 1).select(pairs.alias("p"), "n").groupBy(F.col("p")["0"].alias("left"), F.col("p")["1"].alias("right")).agg(F.sum("n").alias("n"))


def byte_pair_counts(words: DataFrame) -> DataFrame:
    """pair_counts over the bytes of ``words`` (word, n), without arrays: all of it stays in generated code."""
    chars = words.select(F.decode(F.col("word").cast("binary"), "ISO-8859-1").alias("w"), "n").where(F.length("w") > 1)
    at = chars.select("w", "n", F.explode(F.sequence(F.lit(1), F.length("w") - 1)).alias("i"))
    one = lambda k: F.ascii(F.col("w").substr(F.col("i") + k, F.lit(1)))
    return at.groupBy(one(0).alias("left"), one(1).alias("right")).agg(F.sum("n").alias("n"))


def first_appearance(rows: DataFrame, text: str, order: str) -> DataFrame:
    """Of rows with equal text only the first by ``order``; the many of one text are pre-aggregated where they are read."""
    first = rows.groupBy(text).agg(F.min_by(F.struct(*rows.columns), order).alias("__r"))
    return first.select("__r.*")


class Unsettled(RuntimeError):
    """Values still collide after the last round."""


def settle(rows: DataFrame, key: str, value: Callable[[Column, int], Column], rounds: int = 8) -> DataFrame:
    """(key, attempt, value): a value of its own for every ``key`` (unique, not null), drawn again where it is taken.

    In every round the keys that have none draw ``value(key column, attempt)``. A value goes to the first key that
    draws it, unless an earlier round gave it away; all others draw again. Keys left after ``rounds`` rounds are an error. What a round gives
    depends on no other order, so the outcome is the same however rows are dealt out.
    """
    waiting, settled = rows.select(key), None
    for attempt in range(rounds):
        drawn = waiting.withColumn("value", value(F.col(key), attempt))
        # one row a value before anything is joined: a value that all draw gathers nowhere
        first = drawn.groupBy("value").agg(F.min(key).alias(key))
        first = first if settled is None else first.join(settled.select("value"), "value", "left_anti")
        first = first.select(key, F.lit(attempt).alias("attempt"), "value")
        settled = table(first if settled is None else settled.unionByName(first), "settled")
        waiting = table(waiting.join(settled.select(key), key, "left_anti"), "waiting")
        if not waiting.head(1):
            return settled
    raise Unsettled(f"{waiting.count()} keys collide still after {rounds} rounds")


def split_digest(rows: DataFrame, split: str, key: str, line: Column) -> DataFrame:
    """(split, digest): SHA-256 over the digests of a split's lines in the order of ``key``; moving a row changes both.

    The hash is of a sequence, so a split is one sorted stream through one task: sixty-four bytes a row, a batch
    in memory at a time. A null split has a null digest; null lines do not count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[str | None, str | None]] = []
        now, state, first = None, None, True
        for batch in batches:
            for name, told in zip(batch.column("s").to_pylist(), batch.column("d").to_pylist(), strict=True):
                if state is None or name != now:
                    done += [(now, None if now is None else state.hexdigest())] if state is not None else []
                    now, state, first = name, hashlib.sha256(f"{name}\n".encode()), True
                if told is not None:
                    state.update((told if first else "\n" + told).encode())
                    first = False
        done += [(now, None if now is None else state.hexdigest())] if state is not None else []
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.string()), pa.array([x for _, x in done], pa.string())], names=["s", "digest"])

    lines = rows.select(F.col(split).cast("string").alias("s"), F.col(key).alias("k"), F.sha2(line, 256).alias("d"))
    dealt = lines.repartition("s").sortWithinPartitions("s", "k", "d").select("s", "d")
    return dealt.mapInArrow(run, "s string, digest string").select(F.col("s").alias(split), "digest")


def length_stats(rows: DataFrame, group: str, length: Column) -> DataFrame:
    """Rows, extremes, quartiles (linear) and mean of ``length`` per group."""
    rows = table(rows.select(F.col(group), length.alias("__length")), "lengths")
    out = rows.groupBy(group).agg(F.count("*").alias("n"), F.min("__length").alias("shortest"), F.max("__length").alias("longest"), F.avg("__length").alias("mean"))
    out = join_few(out, quantiles(rows, "__length", [0.25, 0.5, 0.75], [group]).select(group, "q"), [group])
    return out.select(group, "n", "shortest", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "longest", "mean")
