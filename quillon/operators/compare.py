"""Comparison of two result tables, key by key, within a tolerance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a key can come to.
AGREE, EXPLAINED, DISAGREE, UNAVAILABLE = "agree", "explained", "disagree", "unavailable"


def within(left: Column, right: Column, relative: float, absolute: float) -> Column:
    """|left - right| <= absolute + relative * max(|left|, |right|); equal infinities and two NaN agree."""
    near = F.abs(left - right) <= absolute + relative * F.greatest(F.abs(left), F.abs(right))
    finite = ~(F.isnan(left) | F.isnan(right) | (F.abs(left) == float("inf")) | (F.abs(right) == float("inf")))
    return F.when(finite, near).otherwise(left == right)


def tolerance_diff(left: DataFrame, right: DataFrame, keys: list[str], value: str, relative: float = 1e-9, absolute: float = 0.0, explained: Column | None = None) -> DataFrame:
    """(keys, left, right, difference, status) of every key of either table.

    agree: both values are there and lie within the tolerance; explained: they do not, but ``explained`` (a condition on the
    keys and the columns left and right) says why; unavailable: a side has no row, or null; disagree: the rest. Keys may be null; a
    key that a table holds twice is an error. Two empty tables give an empty result.
    """
    sides = []
    for side, rows in (("left", left), ("right", right)):
        own = rows.groupBy(*(F.col(k).alias(f"__{side}{i}") for i, k in enumerate(keys))).agg(F.count("*").alias(f"__{side}_n"), F.first(F.col(value).cast("double")).alias(side))
        told = F.concat(F.lit(f"key twice on the {side}: "), *(F.concat(F.coalesce(F.col(f"__{side}{i}").cast("string"), F.lit("null")), F.lit(" ")) for i in range(len(keys))))
        sides.append(own.withColumn(side, F.when(F.col(f"__{side}_n") > 1, F.raise_error(told).cast("double")).otherwise(F.col(side))))
    on = F.lit(True)
    for i in range(len(keys)):
        on = on & F.col(f"__left{i}").eqNullSafe(F.col(f"__right{i}"))
    both = sides[0].join(sides[1], on, "full_outer").select(*(F.coalesce(f"__left{i}", f"__right{i}").alias(k) for i, k in enumerate(keys)), "left", "right")
    a, b = F.col("left"), F.col("right")
    why = F.coalesce(explained, F.lit(False)) if explained is not None else F.lit(False)
    status = F.when(a.isNull() | b.isNull(), UNAVAILABLE).when(within(a, b, relative, absolute), AGREE).when(why, EXPLAINED).otherwise(DISAGREE)
    return both.withColumn("difference", b - a).withColumn("status", status)


def agreement(diff: DataFrame) -> DataFrame:
    """(status, n, worst): keys of each status, all four always there, and their largest difference."""
    names = diff.sparkSession.createDataFrame([(i, s) for i, s in enumerate([AGREE, EXPLAINED, DISAGREE, UNAVAILABLE])], "place int, status string")
    counts = diff.groupBy("status").agg(F.count("*").alias("n"), F.max(F.abs("difference")).alias("worst"))
    return names.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"), "worst")
