"""The registry of queries: each has a name, a function of (spark, sf_dir) and, where SQL can say it, DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.order import join_few, quantiles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with its oracle."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """A plain scan in as many partitions as there are cores at least.

    A small file of one row group cannot be split, and Python work on it would run in one task. Tables with
    more splits than cores come back as they are, so large ones are never shuffled here.
    """
    n = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(n) if rows.rdd.getNumPartitions() < n else rows


def deal(rows: DataFrame) -> DataFrame:
    """Narrow rows dealt out evenly, for work that costs far more than moving them.

    However many splits a file has, its rows come with the splits that its row groups begin in: with large row groups, few.
    """
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()))


@query("""
SELECT lang, count(*) AS n, sum(quality) AS good, quantile_cont(n_chars, 0.25) AS p25,
       quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.75) AS p75
FROM documents JOIN labels USING (doc_id) GROUP BY lang
""")
def corpus_stats_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents, good ones and length quartiles per language."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    known = docs.select("doc_id", "lang", "n_chars").join(labels, "doc_id")
    stats = known.groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").alias("good"))
    parts = quantiles(known, "n_chars", [0.25, 0.5, 0.75], ["lang"]).select("lang", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"))
    return join_few(stats, parts, ["lang"])
