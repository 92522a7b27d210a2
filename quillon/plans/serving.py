"""Queries: the request stream. Events are requests, ``value`` their latency in milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.catalogue import query, read
from quillon.operators import serving as S
from quillon.operators.order import join_few, quantiles


@query("""
SELECT event_type, count(*) AS n, round(avg(value), 9) AS mean, round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.95), 9) AS p95, min(value) AS low, max(value) AS high
FROM events GROUP BY event_type
""")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.latency_summary(read(spark, sf_dir, "events"), "value", "event_type")
    return rows.select("event_type", "n", *(F.round(c, 9).alias(c) for c in ("mean", "p50", "p95")), "low", "high")


@query("""
SELECT event_type, le, count(*) FILTER (le = '+Inf' OR value / 1000 <= TRY_CAST(le AS DOUBLE)) AS n
FROM events, (VALUES ('0.01'), ('0.025'), ('0.05'), ('0.1'), ('0.25'), ('0.5'), ('1.0'), ('2.5'), ('5.0'), ('10.0'), ('30.0'), ('+Inf')) b(le) GROUP BY ALL
""")
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").withColumn("s", F.col("value") / 1000)
    return S.cumulative_histogram(rows, "s", S.LATENCY_BUCKETS, "event_type")


@query("""
SELECT event_type, CAST(sum(user_id % 64 + 1) AS BIGINT) AS tokens, round(CASE WHEN sum(value) <= 0 THEN 0 ELSE sum(user_id % 64 + 1) / (sum(value) / 1000) END, 6) AS tokens_per_second,
       round(quantile_cont(value, 0.5) / 64, 9) AS ms_per_token
FROM events GROUP BY event_type
""")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens, wall = F.sum(F.col("user_id") % 64 + 1), F.sum("value")
    rate = F.when(wall <= 0, 0.0).otherwise(tokens / (wall / 1000))
    events = read(spark, sf_dir, "events")
    sums = events.groupBy("event_type").agg(tokens.alias("tokens"), F.round(rate, 6).alias("tokens_per_second"))
    middle = quantiles(events, "value", [0.5], ["event_type"]).select("event_type", "q")
    return join_few(sums, middle, ["event_type"]).select("event_type", "tokens", "tokens_per_second", F.round(F.col("q")[0] / 64, 9).alias("ms_per_token"))


@query("SELECT event_type AS status, count(*) AS total FROM events GROUP BY 1")
def request_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("total"))


_REPLAY = """
WITH RECURSIVE e AS MATERIALIZED (SELECT event_type AS shard, event_id AS key, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT shard, i, key, CAST(0 AS BIGINT) AS batch, t AS first, 1 AS size FROM e WHERE i = 1
  UNION ALL SELECT e.shard, e.i, e.key, r.batch + (size = 8 OR e.t > first + 7200)::BIGINT, CASE WHEN size = 8 OR e.t > first + 7200 THEN e.t ELSE first END, CASE WHEN size = 8 OR e.t > first + 7200 THEN 1 ELSE size + 1 END
  FROM r JOIN e ON e.shard = r.shard AND e.i = r.i + 1)
"""


@query(_REPLAY + "SELECT shard, key, batch FROM r")
def microbatch_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches that close at eight requests or two hours after their first, per event type as server."""
    return S.microbatches(read(spark, sf_dir, "events"), "event_type", "ts", "event_id", 7200.0, 8)


@query("SELECT event_type AS shard, count(*) AS requests FROM events GROUP BY 1")
def microbatch_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request lands in exactly one batch."""
    return microbatch_replay(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("requests"))


@query(_REPLAY + "SELECT shard, count(*) AS batches, CAST(sum(n) AS BIGINT) AS requests, avg(n) AS mean_size, max(n) AS largest FROM (SELECT shard, batch, count(*) AS n FROM r GROUP BY ALL) GROUP BY shard")
def batcher_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches, requests and mean batch size per server, with the batch size histogram's sum."""
    sizes = microbatch_replay(spark, sf_dir).groupBy("shard", "batch").agg(F.count("*").alias("size"))
    return sizes.groupBy("shard").agg(F.count("*").alias("batches"), F.sum("size").alias("requests"), F.avg("size").alias("mean_size"), F.max("size").alias("largest"))
