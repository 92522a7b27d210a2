"""Queries: training logs. Orders are log lines: o_custkey mod 20 the run, o_orderkey the step, o_totalprice the loss."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.catalogue import query, read
from quillon.operators import logs as L


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("run"), F.col("o_orderkey").alias("step"), F.col("o_totalprice").alias("loss"))


_LOG = "WITH l AS (SELECT o_custkey % 20 AS run, o_orderkey AS step, o_totalprice AS loss FROM orders)\n"


@query(_LOG + "SELECT run, step, best IS NULL OR loss < best AS is_best FROM (SELECT *, min(loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM l)")
def running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.running_best(_log(spark, sf_dir), "run", "step", "loss").select("run", "step", "is_best")


@query(_LOG + """
, b AS (SELECT *, max(loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM l),
i AS (SELECT *, sum(CASE WHEN top IS NULL OR loss > top THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY step) AS island FROM b),
n AS (SELECT *, row_number() OVER (PARTITION BY run, island ORDER BY step) - 1 AS bad FROM i),
e AS (SELECT run, coalesce(min(step) FILTER (bad >= 5), max(step)) AS stop_epoch FROM n GROUP BY run)
SELECT run, arg_max(step, (loss, -step)) AS best_epoch, max(loss) AS best_score, max(step) AS stop_epoch FROM n JOIN e USING (run) WHERE step <= e.stop_epoch GROUP BY run
""")
def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patience of five without a new highest score."""
    return L.early_stop(_log(spark, sf_dir), "run", "step", "loss", 5)


_LINES = """
WITH l AS (SELECT o_custkey % 20 AS run, o_orderdate AS day, o_orderkey AS step, CASE WHEN o_custkey % 20 % 3 = 0 AND o_orderkey % 50 = 0 THEN 'nan'::DOUBLE ELSE o_totalprice END AS loss FROM orders),
b AS (SELECT *, step < lag(step) OVER w AS back, row_number() OVER w AS first, row_number() OVER (PARTITION BY run ORDER BY day DESC, step DESC) AS last FROM l WINDOW w AS (PARTITION BY run ORDER BY day, step))
"""


@query(_LINES + """
SELECT run, count(*) FILTER (back) AS backwards, bool_or(isnan(loss)) AS diverged, max(step) FILTER (last = 1) AS total_tokens,
       max(loss) FILTER (first = 1) AS first_loss, max(loss) FILTER (last = 1) AS last_loss, max(loss) FILTER (first = 1) - max(loss) FILTER (last = 1) AS gain
FROM b GROUP BY run
""")
def log_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in the order of their day: steps go back, and a third of the runs holds losses that are no numbers."""
    loss = F.when((F.col("o_custkey") % 20 % 3 == 0) & (F.col("o_orderkey") % 50 == 0), float("nan")).otherwise(F.col("o_totalprice"))
    lines = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("run"), F.col("o_orderdate").alias("day"), F.col("o_orderkey").alias("step"), loss.alias("loss"))
    return L.log_check(lines, "run", ["day", "step"], "step", "loss", "step")


@query(_LOG + "SELECT run, round(coalesce(regr_slope(loss, step), 0), 6) AS slope FROM l GROUP BY run")
def margin_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.slope(_log(spark, sf_dir), "step", "loss", ["run"]).select("run", F.round("slope", 6).alias("slope"))


@query(_LOG + "SELECT run, round(sum(loss * (step % 7 + 1)) / sum(step % 7 + 1), 6) AS weighted_loss, round(exp(avg(loss) / 100000), 9) AS perplexity, round(stddev_samp(loss), 6) AS sd, max(abs(loss)) AS absmax FROM l GROUP BY run")
def weighted_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-weighted mean loss, perplexity of the scaled mean, spread."""
    w = F.col("step") % 7 + 1
    return _log(spark, sf_dir).groupBy("run").agg(F.round(F.sum(F.col("loss") * w) / F.sum(w), 6).alias("weighted_loss"), F.round(F.exp(F.avg("loss") / 100000), 9).alias("perplexity"), F.round(F.stddev_samp("loss"), 6).alias("sd"), F.max(F.abs("loss")).alias("absmax"))


@query("SELECT sum(p_size) FILTER (p_size % 2 = 0) AS trainable, sum(p_size) AS total, round(100.0 * sum(p_size) FILTER (p_size % 2 = 0) / sum(p_size), 9) AS pct, sum(p_size * 4) AS bytes FROM part")
def parameter_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional sums over a parameter catalogue (parts as tensors)."""
    some = F.sum(F.when(F.col("p_size") % 2 == 0, F.col("p_size")))
    return read(spark, sf_dir, "part").agg(some.alias("trainable"), F.sum("p_size").alias("total"), F.round(100.0 * some / F.sum("p_size"), 9).alias("pct"), F.sum(F.col("p_size") * 4).alias("bytes"))
