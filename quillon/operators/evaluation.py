"""Classification and completion metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(rows: DataFrame, actual: str, predicted: str, classes: list[int]) -> DataFrame:
    """(actual, predicted, n), zero-filled; a label outside ``classes`` is an error."""
    spark = rows.sparkSession
    inside = F.col(actual).isin(classes) & F.col(predicted).isin(classes)
    counted = rows.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"), F.bool_and(inside).alias("ok"))
    counted = counted.where(F.when(F.col("ok"), True).otherwise(F.raise_error("label out of range").isNull()))
    # every combination of the few declared classes: one row each
    grid = spark.range(len(classes) ** 2).select(F.element_at(F.lit(classes), (F.col("id") / len(classes)).cast("int") + 1).alias("actual"), F.element_at(F.lit(classes), (F.col("id") % len(classes)).cast("int") + 1).alias("predicted"))
    return grid.join(counted.drop("ok"), ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def class_metrics(matrix: DataFrame) -> DataFrame:
    """(class, precision, recall, f1, support) from a confusion matrix; 0 / 0 is 0."""
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    rows = matrix.select(F.explode(F.array(F.struct(F.col("actual").alias("class"), hit.alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("told")), F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("n").alias("told")))).alias("s")).select("s.*")
    sums = rows.groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("told").alias("told"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return sums.select("class", ratio(F.col("tp"), F.col("told")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(2 * F.col("tp"), F.col("told") + F.col("support")).alias("f1"), "support")


def negative_log_likelihood(probs: Column, label: Column) -> Column:
    """Aggregate: mean of -ln of the true class's probability, clipped to [1e-12, 1]."""
    return F.avg(-F.ln(F.greatest(F.least(F.element_at(probs, label.cast("int") + 1), F.lit(1.0)), F.lit(1e-12))))


def calibration_error(rows: DataFrame, confidence: str, correct: str, bins: int = 15) -> DataFrame:
    """One row ece: equal bins, closed on the right, the first also at 0."""
    edges = F.lit([i / bins for i in range(bins)])
    at = F.greatest(F.size(F.filter(edges, lambda e: e < F.col(confidence))), F.lit(1))
    per = rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("double")).alias("acc"), F.avg(confidence).alias("conf"))
    return per.agg((F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n")).alias("ece"))


def metric_blocks(outcomes: DataFrame) -> DataFrame:
    """Rates and means overall, per slice and per headline violation in one pass (grouping sets).

    ``outcomes``: slice, violation (null for clean), parsed, schema_valid, exact_match, field_f1, value.
    """
    rate = lambda c: F.avg(F.col(c).cast("double"))
    sets = outcomes.groupingSets([[], [F.col("slice")], [F.col("violation")]], F.col("slice"), F.col("violation"))
    blocks = sets.agg(F.grouping_id().alias("gid"), F.count("*").alias("n"), rate("parsed").alias("json_rate"), rate("schema_valid").alias("schema_rate"), rate("exact_match").alias("exact_rate"), F.avg("field_f1").alias("mean_f1"), F.avg("value").alias("mean_reward"))
    block = F.when(F.col("gid") == 3, "overall").when(F.col("gid") == 1, "slice").otherwise("violation")
    return blocks.where((F.col("gid") != 2) | F.col("violation").isNotNull()).select(block.alias("block"), "slice", "violation", "n", "json_rate", "schema_rate", "exact_rate", "mean_f1", "mean_reward")


def parse_gap(outcomes: DataFrame) -> DataFrame:
    """Strict and lenient parse rates, their gap, and rows that only repair saved."""
    s, t = F.avg(F.col("strict").cast("double")), F.avg(F.col("lenient").cast("double"))
    return outcomes.agg(F.count("*").alias("n"), s.alias("strict_rate"), t.alias("lenient_rate"), (t - s).alias("gap"), F.count_if(F.col("lenient") & ~F.col("strict")).alias("repaired"))


def coverage(fields: DataFrame, stem: str = "stem") -> DataFrame:
    """Recall and precision per field from rows (stem, correct, expected, emitted); 1 where nothing was due."""
    sums = fields.groupBy(stem).agg(F.count_if("expected").alias("expected"), F.count_if("emitted").alias("emitted"), F.count_if("correct").alias("correct"))
    share = lambda n: F.when(F.col(n) == 0, 1.0).otherwise(F.col("correct") / F.col(n))
    return sums.withColumn("recall", share("expected")).withColumn("precision", share("emitted"))


#: What a list field of a reply can come to against gold.
MEMBER_CLASSES = ["unparseable", "key_absent", "both_empty", "invented", "dropped_every_member", "exact", "partial_or_wrong"]


def member_class(parsed: Column, reply: Column, gold: Column, field: str) -> Column:
    """One of MEMBER_CLASSES for the list ``field`` of two JSON texts; order and repeats make no difference, and a key that gold lacks is an empty list there."""
    held = lambda c: F.from_json(F.get_json_object(c, f"$.{field}"), "array<string>")
    none = F.array().cast("array<string>")
    mine, own = F.array_distinct(F.coalesce(held(reply), none)), F.array_distinct(F.coalesce(held(gold), none))
    shared = F.size(F.array_intersect(mine, own))
    absent = F.get_json_object(reply, f"$.{field}").isNull()
    return (
        F.when(~F.coalesce(parsed, F.lit(False)), "unparseable")
        .when(absent, "key_absent")
        .when((F.size(mine) == 0) & (F.size(own) == 0), "both_empty")
        .when(F.size(own) == 0, "invented")
        .when(F.size(mine) == 0, "dropped_every_member")
        .when((shared == F.size(own)) & (shared == F.size(mine)), "exact")
        .otherwise("partial_or_wrong")
    )
