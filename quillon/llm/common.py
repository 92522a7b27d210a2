"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.shared import forget, shared_dir, shared_path, table  # noqa: F401  (operators take them from here)

#: A key is hot if it holds more than this share of all rows; so there are fewer than 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 256


def place(df: DataFrame, name: str) -> int:
    """Where column ``name`` stands; by its exact name, or else by the only one that differs in case."""
    found = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"need exactly one column {name!r}, have {df.columns}")
    return found[0]


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ..: whatever they were called, no name clashes."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns (new name = old name); extra columns of the input fall away here, whatever their names."""
    return numbered(df).select(*(F.col(f"c{place(df, old)}").alias(new) for new, old in columns.items()))


def skew_join(rows: DataFrame, classes: DataFrame, key: str, weight: str) -> DataFrame:
    """Left join of many ``rows`` to ``classes`` (one row per ``key``, of ``weight`` rows).

    Hot keys, fewer than 1 / HOT_SHARE by their definition, are broadcast; their rows take a key of
    their own into the shuffled join, so none of its partitions gathers a hot key.
    """
    total = classes.agg(F.sum(weight)).first()[0] or 0
    rest = [c for c in classes.columns if c != key]
    hot = classes.where(F.col(weight) > max(1, int(total * HOT_SHARE)))
    hot = hot.select(F.col(key), *(F.col(c).alias(f"__hot_{c}") for c in rest))
    spread = rows.join(F.broadcast(hot), key, "left")
    is_hot = F.col(f"__hot_{weight}").isNotNull()
    # identical hot rows part by their place in the task that read them: where a row goes changes no result
    own = F.concat(F.lit("~"), F.monotonically_increasing_id().cast("string"))
    spread = spread.withColumn("__key", F.when(is_hot, own).otherwise(F.col(key).cast("string")))
    cold = classes.select(F.col(key).cast("string").alias("__key"), *(F.col(c).alias(f"__cold_{c}") for c in rest))
    joined = spread.join(cold, "__key", "left")
    return joined.select(*rows.columns, *(F.coalesce(f"__hot_{c}", f"__cold_{c}").alias(c) for c in rest))


def slices(batches: Iterator[pa.RecordBatch], name: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the strings of column ``name`` take about ``most`` bytes (one long row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
        cuts = np.cumsum(sizes, dtype=np.int64) // most
        at = np.flatnonzero(np.diff(cuts)) + 1
        for a, b in zip([0, *at], [*at, n], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "cc") -> DataFrame:
    """(node, component) of every node of ``edges``: component is the smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each halves the depth, hubs are
    pre-aggregated, and the lineage is cut after every round.
    """
    now = edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("u <> v").distinct()
    path = shared_path(now.sparkSession, name)
    now.write.parquet(path)
    now = now.sparkSession.read.schema(now.schema).parquet(path)
    mark = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, path = path, shared_path(now.sparkSession, name)
        small.write.parquet(path)
        now = now.sparkSession.read.schema(small.schema).parquet(path)
        forget(before)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(new) == mark:
            break
        mark = tuple(new)
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def keep_once(docs: DataFrame, kept: DataFrame, at: int, digest: Column, *, name: str) -> DataFrame:
    """The rows of ``docs`` (columns numbered) whose id, column ``at``, and ``digest`` stand in ``kept`` (id, digest, n rows of both): one row of each.

    Texts move once, to meet the decision. Rows that repeat both id and digest are rare; only where ``kept``
    counts some (n > 1) are those few rows reduced to one each, pre-aggregated in every task.
    """
    kept = table(kept, name)
    marked = docs.withColumn("digest", digest).withColumn("id", F.col(f"c{at}").cast("long"))
    same = marked["id"].eqNullSafe(kept["id"]) & (marked["digest"] == kept["digest"])
    once = marked.join(kept.where("n = 1"), same, "left_semi")
    if kept.where("n > 1").head(1):
        more = kept.where("n > 1")
        same = marked["id"].eqNullSafe(more["id"]) & (marked["digest"] == more["digest"])
        once = once.unionByName(marked.join(more, same, "left_semi").dropDuplicates(["id", "digest"]))
    return once.drop("id", "digest")
