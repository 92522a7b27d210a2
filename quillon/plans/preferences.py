"""Queries: ranking and mining. A source is a prompt, its documents are completions, n_chars mod 101 their reward."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.catalogue import query, read
from quillon.operators import preferences as P


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.concat_ws("-", "source", "lang").alias("example_id"), F.col("doc_id").alias("sample_index"), F.md5("text").alias("text"), ((F.col("n_chars") % 101) / 100).alias("reward"))


_RANKED = """
WITH s AS (SELECT source || '-' || lang AS example_id, doc_id AS sample_index, md5(text) AS text, (n_chars % 101) / 100 AS reward FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY reward DESC, md5('3:' || example_id || ':' || sample_index), sample_index, text) AS rank, count(*) OVER (PARTITION BY example_id) AS size FROM s),
p AS (SELECT a.example_id, a.rank, a.text AS chosen, b.text AS rejected, a.reward AS chosen_reward, b.reward AS rejected_reward, a.reward - b.reward AS margin
      FROM r a JOIN r b ON a.example_id = b.example_id AND a.rank = b.size + 1 - b.rank WHERE a.rank < a.size + 1 - a.rank),
m AS (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY rank) AS pair FROM p WHERE margin >= 0.015 AND chosen <> rejected),
k AS (SELECT * FROM m WHERE pair <= 2),
o AS (SELECT example_id, coalesce(pairs, 0) AS pairs, CASE WHEN pairs > 0 THEN 'paired' WHEN n < 2 THEN 'single_sample' WHEN low >= 1 - 1e-9 THEN 'saturated' WHEN low = high THEN 'flat' ELSE 'no_pair' END AS outcome
      FROM (SELECT example_id, count(*) AS n, min(reward) AS low, max(reward) AS high FROM s GROUP BY 1) LEFT JOIN (SELECT example_id, count(*) AS pairs FROM k GROUP BY 1) USING (example_id))
"""


@query(_RANKED + "SELECT example_id, sample_index, CAST(rank AS INT) AS rank FROM r")
def rank_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.rank(_samples(spark, sf_dir), 3).select("example_id", "sample_index", "rank")


@query(_RANKED + "SELECT example_id, CAST(pair AS INT) AS pair, chosen, rejected, round(margin, 9) AS margin FROM k")
def mine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.mine_pairs(_samples(spark, sf_dir), 3).select("example_id", "pair", "chosen", "rejected", F.round("margin", 9).alias("margin"))


@query(_RANKED + "SELECT example_id, outcome, pairs FROM o")
def mining_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _samples(spark, sf_dir)
    return P.outcomes(samples, P.mine_pairs(samples, 3))


@query(_RANKED + "SELECT outcome, count(*) AS prompts, CAST(sum(pairs) AS BIGINT) AS pairs, round(sum(pairs) / count(*), 9) AS per_prompt FROM o GROUP BY outcome")
def mining_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining_outcomes(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("prompts"), F.sum("pairs").alias("pairs"), F.round(F.avg("pairs"), 9).alias("per_prompt"))


@query(_RANKED + """
, d AS (SELECT *, row_number() OVER (PARTITION BY example_id, text ORDER BY reward, sample_index) AS nth FROM s WHERE trim(text) <> ''),
g AS (SELECT example_id, md5('gold:' || example_id) AS gold FROM (SELECT DISTINCT example_id FROM s)),
f AS (SELECT example_id, gold, text, reward, row_number() OVER (PARTITION BY example_id ORDER BY reward, sample_index) AS pair FROM d JOIN g USING (example_id) WHERE nth = 1 AND text <> gold AND 1 - reward >= 0.1)
SELECT example_id, CAST(pair AS INT) AS pair, gold AS chosen, text AS rejected, round(reward, 9) AS rejected_reward FROM f WHERE pair <= 2
""")
def gold_fallback_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _samples(spark, sf_dir)
    golds = samples.select("example_id").distinct().withColumn("gold", F.md5(F.concat(F.lit("gold:"), F.col("example_id"))))
    return P.fallback_pairs(golds, samples, 0.1, 2).withColumn("rejected_reward", F.round("rejected_reward", 9))


@query(_RANKED + "SELECT count(*) AS candidates, count(*) FILTER (margin < 0.015) AS low_margin, count(*) FILTER (margin >= 0.015 AND chosen = rejected) AS identical, (SELECT count(*) FROM m WHERE pair > 2) AS capped, (SELECT count(*) FROM k) AS kept FROM p")
def mining_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.mining_losses(_samples(spark, sf_dir), 3)


@query(_RANKED + """
SELECT coalesce(list_extract([NULL, 'missing_field', 'bad_enum', 'unparseable'], CAST(b.sample_index % 4 AS INT) + 1), 'none') AS violation, count(*) AS n
FROM k JOIN r b ON b.example_id = k.example_id AND b.rank = b.size + 1 - k.rank GROUP BY 1
""")
def rejected_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rejected completions of the mined pairs break first (here by their number)."""
    at = F.col("sample_index") % 4
    samples = _samples(spark, sf_dir).withColumn("violation", F.when(at == 1, "missing_field").when(at == 2, "bad_enum").when(at == 3, "unparseable"))
    return P.rejected_violations(P.mine_pairs(samples.drop("violation"), 3), samples, "violation")


@query(_RANKED + "SELECT k.example_id, CAST(pair AS INT) AS pair, chosen, rejected, 'Continue as ' || k.example_id AS prompt FROM k")
def mined_with_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mined pairs with the prompts of their examples; a completion of an unknown example would be an error."""
    samples = _samples(spark, sf_dir)
    examples = samples.select("example_id").distinct().withColumn("prompt", F.concat(F.lit("Continue as "), "example_id"))
    return P.mine(samples, examples, 3).select("example_id", "pair", "chosen", "rejected", "prompt")
