"""Ranking completions and mining preference pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .checked import matched

MIN_MARGIN, MOST_PAIRS = 0.015, 2


def rank(samples: DataFrame, seed: int) -> DataFrame:
    """``samples`` (example_id, sample_index, text, reward) with best-first rank; ties in an order drawn per prompt."""
    tie = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("example_id").cast("string"), F.col("sample_index").cast("string")).cast("binary"))
    w = Window.partitionBy("example_id")
    return samples.withColumn("rank", F.row_number().over(w.orderBy(F.desc("reward"), tie, "sample_index", "text"))).withColumn("size", F.count("*").over(w))


def candidate_pairs(samples: DataFrame, seed: int = 0, min_margin: float = MIN_MARGIN) -> DataFrame:
    """Best with worst, then inwards: every pair of a prompt with its margin and status (eligible, low_margin, identical)."""
    if not 0 < min_margin < float("inf"):
        raise ValueError("min_margin must be finite and positive")
    ranked = rank(samples, seed)
    best = ranked.where(F.col("rank") < F.col("size") + 1 - F.col("rank")).select("example_id", "rank", F.col("sample_index").alias("chosen_index"), F.col("text").alias("chosen"), F.col("reward").alias("chosen_reward"))
    worst = ranked.select("example_id", (F.col("size") + 1 - F.col("rank")).cast("int").alias("rank"), F.col("sample_index").alias("rejected_index"), F.col("text").alias("rejected"), F.col("reward").alias("rejected_reward"))
    pairs = best.join(worst, ["example_id", "rank"]).withColumn("margin", F.col("chosen_reward") - F.col("rejected_reward"))
    return pairs.withColumn("status", F.when(~F.coalesce(F.col("margin") >= min_margin, F.lit(False)), "low_margin").when(F.col("chosen") != F.col("rejected"), "eligible").otherwise("identical"))


def mine_pairs(samples: DataFrame, seed: int = 0, min_margin: float = MIN_MARGIN, most: int = MOST_PAIRS) -> DataFrame:
    """Best with worst, then inwards while the margin holds; identical texts are skipped, the rest capped per prompt."""
    if most < 1:
        raise ValueError("most is at least 1")
    good = candidate_pairs(samples, seed, min_margin).where("status = 'eligible'").drop("status")
    at = F.row_number().over(Window.partitionBy("example_id").orderBy("rank"))
    return good.withColumn("pair", at).where(F.col("pair") <= most)


def mine(samples: DataFrame, examples: DataFrame, seed: int = 0, min_margin: float = MIN_MARGIN, most: int = MOST_PAIRS) -> DataFrame:
    """``mine_pairs`` with the columns of each pair's example; a sample of an unknown example, or an example given twice, is an error."""
    known = [c for c in examples.columns if c != "example_id"]
    joined = matched(samples.select("example_id", "sample_index", "text", "reward"), examples, "example_id")
    pairs = mine_pairs(joined, seed, min_margin, most)
    return matched(pairs, examples.select("example_id", *known), "example_id")


def mining_losses(samples: DataFrame, seed: int = 0, min_margin: float = MIN_MARGIN, most: int = MOST_PAIRS) -> DataFrame:
    """One row: candidates, low_margin, identical, capped (eligible, but beyond ``most`` of their prompt) and kept pairs; they add up."""
    pairs = candidate_pairs(samples, seed, min_margin)
    per = pairs.groupBy("example_id").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("eligible", "low_margin", "identical")))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    kept = F.least(F.col("eligible"), F.lit(most))
    return per.agg(total(F.col("eligible") + F.col("low_margin") + F.col("identical"), "candidates"), total(F.col("low_margin"), "low_margin"), total(F.col("identical"), "identical"), total(F.col("eligible") - kept, "capped"), total(kept, "kept"))


def rejected_violations(pairs: DataFrame, samples: DataFrame, violation: str) -> DataFrame:
    """(violation, n): the mined pairs by the ``violation`` of their rejected sample; none for a rejected sample without one."""
    own = samples.select("example_id", F.col("sample_index").alias("rejected_index"), F.col(violation).alias("__violation"))
    found = pairs.select("example_id", "rejected_index").join(own, ["example_id", "rejected_index"])
    return found.groupBy(F.coalesce("__violation", F.lit("none")).alias("violation")).agg(F.count("*").alias("n"))


def outcomes(samples: DataFrame, pairs: DataFrame) -> DataFrame:
    """(example_id, outcome): paired, single_sample, saturated, flat or no_pair."""
    per = samples.groupBy("example_id").agg(F.count("*").alias("n"), F.min("reward").alias("low"), F.max("reward").alias("high"))
    found = pairs.groupBy("example_id").agg(F.count("*").alias("pairs"))
    kind = F.when(F.col("pairs") > 0, "paired").when(F.col("n") < 2, "single_sample").when(F.col("low") >= 1 - 1e-9, "saturated").when(F.col("high") == F.col("low"), "flat").otherwise("no_pair")
    return per.join(found, "example_id", "left").select("example_id", kind.alias("outcome"), F.coalesce("pairs", F.lit(0)).alias("pairs"))


def fallback_pairs(examples: DataFrame, samples: DataFrame, min_margin: float, most: int) -> DataFrame:
    """Gold as chosen against each prompt's worst distinct completions; gold itself is worth 1."""
    w = Window.partitionBy("example_id", "text").orderBy("reward", "sample_index")
    distinct = samples.where(F.trim("text") != "").withColumn("__at", F.row_number().over(w)).where("__at = 1").drop("__at")
    joined = distinct.join(examples.select("example_id", "gold"), "example_id").where((F.col("text") != F.col("gold")) & (1.0 - F.col("reward") >= min_margin))
    at = F.row_number().over(Window.partitionBy("example_id").orderBy("reward", "sample_index"))
    return joined.withColumn("pair", at).where(F.col("pair") <= most).select("example_id", "pair", F.col("gold").alias("chosen"), F.col("text").alias("rejected"), F.col("reward").alias("rejected_reward"))


def mining_report(samples: DataFrame, pairs: DataFrame, group: str | None = None) -> DataFrame:
    """Counters of a mining run, in all or by a column of the prompts: prompts, samples, pairs, prompts of each outcome, mean margin, yields, saturation rate.

    ``group`` must be a column of ``samples`` that is the same for all samples of a prompt. Outcomes must add up
    to the prompts and their pairs to the pairs mined, else the run was miscounted and this is an error.
    """
    per = outcomes(samples, pairs).withColumnRenamed("pairs", "own")
    sizes = samples.groupBy("example_id").agg(F.count("*").alias("samples"), *([F.first(group).alias(group)] if group else []))
    margins = pairs.groupBy("example_id").agg(F.sum("margin").alias("margin"))
    rows = per.join(sizes, "example_id").join(margins, "example_id", "left")
    kinds = ["paired", "single_sample", "saturated", "flat", "no_pair"]
    out = rows.groupBy(*([group] if group else [])).agg(F.count("*").alias("prompts"), F.sum("samples").alias("samples"), F.sum("own").alias("pairs"), *(F.count_if(F.col("outcome") == k).alias(k) for k in kinds), F.sum("margin").alias("margin"))
    whole = sum((F.col(k) for k in kinds[1:]), F.col(kinds[0]))
    prompts = F.when(whole == F.col("prompts"), F.col("prompts")).otherwise(F.raise_error(F.lit("outcomes do not add up to the prompts")).cast("long"))
    n = F.col("prompts").cast("double")
    return out.select(*([group] if group else []), prompts.alias("prompts"), "samples", "pairs", *kinds, (F.col("margin") / F.when(F.col("pairs") > 0, F.col("pairs"))).alias("mean_margin"), (F.col("pairs") / n).alias("pair_yield"), (F.col("paired") / n).alias("prompt_yield"), (F.col("saturated") / n).alias("saturation_rate"))
