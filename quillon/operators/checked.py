"""Joins that refuse bad keys: what does not match is an error that names the key, never a row left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _require(ok: Column, value: Column, kind: str, message: str) -> Column:
    """``value`` where ``ok`` holds, else an error with the message and the key."""
    told = F.concat(F.lit(f"{message}: "), F.coalesce(value.cast("string"), F.lit("null")))
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(told).cast(kind))


def _once(rows: DataFrame, key: str) -> DataFrame:
    """One row a key with all other columns, and how many rows it had."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.count("*").alias("__n"), *(F.first(c).alias(c) for c in rest))


def matched(samples: DataFrame, examples: DataFrame, key: str) -> DataFrame:
    """Every row of ``samples`` with the columns of its example (many to one).

    An example that occurs twice, and a sample without example (a null key too), is an error; examples without
    samples are left out. Names that both sides have are those of the samples. Empty samples give no rows.
    """
    kind = samples.schema[key].dataType.simpleString()
    known = _once(examples.select(key, *(c for c in examples.columns if c not in samples.columns)), key)
    joined = samples.join(known, key, "left")
    found = _require(F.col("__n").isNotNull(), F.col(key), kind, "no example of this id")
    joined = joined.withColumn(key, F.when(F.col("__n") > 1, _require(F.lit(False), F.col(key), kind, "example occurs twice")).otherwise(found))
    return joined.drop("__n")


def one_to_one(samples: DataFrame, examples: DataFrame, key: str) -> DataFrame:
    """``matched`` with one sample an example: a second sample of an id is an error as well."""
    kind = samples.schema[key].dataType.simpleString()
    own = _once(samples, key)
    own = own.withColumn(key, _require(F.col("__n") == 1, F.col(key), kind, "a second sample of this id"))
    return matched(own.drop("__n"), examples, key)


def complete(replies: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Replies and what they answer, one to one and whole: an unknown, missing or repeated key on either side is an error."""
    kind = wanted.schema[key].dataType.simpleString()
    a = _once(replies.select(key, *(c for c in replies.columns if c not in wanted.columns)), key).withColumnRenamed("__n", "__a")
    b = _once(wanted, key).withColumnRenamed("__n", "__b")
    joined = b.join(a, key, "full_outer")
    ok = (F.col("__a") == 1) & (F.col("__b") == 1)
    message = "reply unknown, missing or given twice"
    return joined.withColumn(key, _require(ok, F.col(key), kind, message)).drop("__a", "__b")


def sole_label(rows: DataFrame, column: str, given: str | None = None) -> str:
    """The label that all rows share, or the one given; several labels and none given is an error."""
    if given is not None:
        return given
    found = [r[0] for r in rows.select(column).distinct().limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"{column} must be the same in all rows or be given, found {sorted(map(str, found))}")
    return found[0]


#: Which variants are compared with which.
COMPARISONS = [("base", "sft"), ("sft", "dpo"), ("base", "dpo")]


def compared(rates: DataFrame, variant: str, value: str, pairs: list[tuple[str, str]] = COMPARISONS) -> DataFrame:
    """(baseline, candidate, difference) of each pair of variants that both have a row in ``rates``."""
    wanted = rates.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "place int, baseline string, candidate string")
    one = rates.select(F.col(variant).alias("baseline"), F.col(value).alias("__a"))
    two = rates.select(F.col(variant).alias("candidate"), F.col(value).alias("__b"))
    return wanted.join(one, "baseline").join(two, "candidate").select("place", "baseline", "candidate", (F.col("__b") - F.col("__a")).alias("difference"))
