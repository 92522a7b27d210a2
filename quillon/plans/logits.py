"""Queries: transforms of logits (each embedding is a row of 64 logits) and preference losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.catalogue import query, read
from quillon.functions import logits as L
from quillon.functions.draws import draw


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double") * 10).alias("l"))


_L = """
WITH l AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 10) AS l FROM embeddings),
u AS (SELECT vec_id, unnest(range(len(l))) AS i, unnest(l) AS x, list_max(l) AS top FROM l),
s AS (SELECT vec_id, i, x, exp(x - top) / sum(exp(x - top)) OVER (PARTITION BY vec_id) AS p FROM u)
"""


@query(_L + "SELECT vec_id, CAST(arg_max(i, (p, -i)) AS INT) AS best, round(max(p), 9) AS top, round(sum(p * p), 9) AS energy FROM s GROUP BY vec_id")
def softmax_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _logits(spark, sf_dir).select("vec_id", L.softmax(F.col("l")).alias("p"))
    energy = F.aggregate("p", F.lit(0.0), lambda a, q: a + q * q)
    return rows.select("vec_id", L.argmax(F.col("p")).alias("best"), F.round(F.array_max("p"), 9).alias("top"), F.round(energy, 9).alias("energy"))


def _kept(values: F.Column) -> F.Column:
    at = F.transform(values, lambda x, i: F.when(x > float("-inf"), i))
    return F.filter(at, lambda i: i.isNotNull())


@query(_L + "SELECT vec_id, list(CAST(i AS INT) ORDER BY i) AS kept FROM (SELECT vec_id, i, rank() OVER (PARTITION BY vec_id ORDER BY x DESC) AS r FROM u) WHERE r <= 5 GROUP BY vec_id")
def top_k_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logits(spark, sf_dir).select("vec_id", _kept(L.top_k(F.col("l"), 5)).alias("kept"))


@query(_L + "SELECT vec_id, list(CAST(i AS INT) ORDER BY i) AS kept FROM (SELECT vec_id, i, p, sum(p) OVER (PARTITION BY vec_id ORDER BY p DESC, i ROWS UNBOUNDED PRECEDING) AS c FROM s) WHERE c - p <= 0.8 GROUP BY vec_id")
def top_p_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logits(spark, sf_dir).select("vec_id", _kept(L.top_p(F.col("l"), 0.8)).alias("kept"))


@query(_L + "SELECT l.vec_id, round(sum(CASE WHEN i % 10 = l.label THEN CASE WHEN x > 0 THEN x / 1.3 ELSE x * 1.3 END ELSE x END), 6) AS total FROM u JOIN l USING (vec_id) GROUP BY l.vec_id")
def repetition_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids whose last digit is the label count as seen."""
    seen = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: i % 10 == F.col("label"))
    rows = _logits(spark, sf_dir).select("vec_id", L.repetition_penalty(F.col("l"), seen, 1.3).alias("l"))
    return rows.select("vec_id", F.round(F.aggregate("l", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(_L + """
, r AS (SELECT vec_id, i, x, rank() OVER (PARTITION BY vec_id ORDER BY x DESC) AS r, top FROM u), k AS (SELECT vec_id, i, exp(x - top) AS e FROM r WHERE r <= 5),
c AS (SELECT vec_id, i, sum(e) OVER (PARTITION BY vec_id ORDER BY i ROWS UNBOUNDED PRECEDING) / sum(e) OVER (PARTITION BY vec_id) AS c FROM k)
SELECT vec_id, CAST(coalesce(min(i) FILTER (('0x' || substr(md5('5:' || vec_id), 1, 8))::BIGINT % 1000000 / 1000000 < c), max(i)) AS INT) AS token FROM c GROUP BY vec_id
""")
def sampled_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded draw from the five likeliest tokens."""
    uniform = draw(F.concat(F.lit("5:"), F.col("vec_id").cast("string")), 1_000_000) / 1_000_000
    return _logits(spark, sf_dir).select("vec_id", L.sample(F.col("l"), uniform, 1.0, 5).alias("token"))


@query("""
WITH e AS (SELECT vec_id, list_transform(range(4), lambda k: coalesce(list_reduce(list_transform(range(k, len(embedding), 4), lambda i: CAST(embedding[CAST(i + 1 AS INT)] AS DOUBLE)), lambda a, x: a + x), 0)) AS e FROM embeddings),
h AS (SELECT vec_id, (e[1] - e[2]) * 20 - (e[3] - e[4]) * 20 AS h FROM e),
s AS (SELECT vec_id, h, least(0.1 * h, 0) - ln(1 + exp(-abs(0.1 * h))) AS up, least(-0.1 * h, 0) - ln(1 + exp(-abs(0.1 * h))) AS down FROM h)
SELECT vec_id, round(-up, 7) AS sigmoid, round(pow(h - 5, 2), 5) AS ipo, round(-0.9 * up - 0.1 * down, 7) AS cdpo, round(0.1 * h, 7) AS margin, h > 0 AS hit FROM s
""")
def dpo_loss_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of pairs whose four log-probabilities are sums of every fourth component of the embeddings; ties are misses."""
    e = L.folded(F.transform("embedding", lambda x: x.cast("double")), 4)
    rows = read(spark, sf_dir, "embeddings").select("vec_id", L.let(e, lambda e: (e[0] - e[1]) * 20 - (e[2] - e[3]) * 20).alias("h"))
    h = F.col("h")
    loss = lambda v, s=0.0, d=7: F.round(L.preference_loss(h, 0.1, v, s), d)
    return rows.select("vec_id", loss("sigmoid").alias("sigmoid"), loss("ipo", 0.0, 5).alias("ipo"), loss("cdpo", 0.1).alias("cdpo"), F.round(h * 0.1, 7).alias("margin"), (h > 0).alias("hit"))


@query("""
WITH t AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding) AS x FROM embeddings)
SELECT vec_id, round(coalesce(sum(CAST(x AS DOUBLE)) FILTER (i >= 4), 0), 7) AS total, round(coalesce(avg(CAST(x AS DOUBLE)) FILTER (i >= 4), 0), 7) AS mean FROM t GROUP BY vec_id
""")
def sequence_logprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of a vector as token log-probabilities, the first four masked."""
    p = F.transform("embedding", lambda x: x.cast("double"))
    labels = F.transform("embedding", lambda _, i: F.when(i < 4, -100).otherwise(i))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(L.sequence_logprob(p, labels), 7).alias("total"), F.round(L.sequence_logprob(p, labels, average=True), 7).alias("mean"))


@query("""
SELECT o_orderkey, s AS step, round(CASE WHEN s < 10 THEN s / 10 ELSE 0.5 * (1 + cos(pi() * least((s - 10) / 90, 1))) END, 9) AS warm_cosine,
       round(CASE WHEN s < 10 THEN 0.001 * (s + 1) / 10 ELSE 0.0001 + 0.5 * 0.0009 * (1 + cos(pi() * least((s - 10) / 90, 1))) END, 9) AS floor_cosine,
       round(CASE WHEN s < 10 THEN s / 10 ELSE greatest(0, (100 - s) / 90) END, 9) AS linear
FROM (SELECT o_orderkey, o_orderkey % 130 AS s FROM orders)
""")
def lr_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three schedules at the steps of a log (orders as its lines); they differ at their first step, and some steps lie past their end."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 130).alias("step"))
    s = F.col("step")
    return rows.select("o_orderkey", "step", F.round(L.cosine_with_warmup(s, 100, 10), 9).alias("warm_cosine"), F.round(L.cosine_to_floor(s, 0.001, 10, 100, 0.0001), 9).alias("floor_cosine"), F.round(L.linear_decay(s, 100, 10), 9).alias("linear"))
