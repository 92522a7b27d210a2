"""Training logs: running bests, early stopping, checks, slopes.

A log may be one run of any length. Its rows are cut into ranges of their order; a range of a run is summed up
(least value, rows, last entry), the sums are combined over the ranges before, and a row then only needs its own range. No task
holds a run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.order import entering, in_ranges, join_few, within


def running_best(rows: DataFrame, run: str, step: str, loss: str, **options: int) -> DataFrame:
    """``rows`` with best (running minimum) and is_best (a strict improvement on all before)."""
    cut = in_ranges(rows, [run, step], **options)
    cut = entering(cut, run, {"__m": F.min(loss)}, {"__best": F.min("__m")})
    before = F.least("__best", F.min(loss).over(within(run).rowsBetween(Window.unboundedPreceding, -1)))
    out = cut.withColumn("__before", before).withColumn("is_best", F.col("__before").isNull() | (F.col(loss) < F.col("__before")))
    return out.withColumn("best", F.least("__before", loss)).drop("__before", "__best", "__range", "__at")


def early_stop(rows: DataFrame, run: str, epoch: str, score: str, patience: int, **options: int) -> DataFrame:
    """(run, best_epoch, best_score, stop_epoch): stops once ``patience`` epochs in a row did not improve."""
    if patience < 1:
        raise ValueError("patience is at least 1")
    slim = rows.select(F.col(run), F.col(epoch), F.col(score))
    cut = in_ranges(slim, [run, epoch], **options)
    cut = entering(cut, run, {"__m": F.max(score), "__n": F.count("*")}, {"__top": F.max("__m"), "__rows": F.sum("__n")})
    w = within(run)
    before = F.greatest("__top", F.max(score).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    cut = cut.withColumn("__nth", F.coalesce("__rows", F.lit(0)) + F.row_number().over(w)).withColumn("__before", before)
    cut = cut.withColumn("__better", F.when(F.col("__before").isNull() | (F.col(score) > F.col("__before")), F.col("__nth")))
    cut = cut.drop("__top", "__rows", "__before")
    # the last improvement before a range, then within it
    cut = entering(cut, run, {"__b": F.max("__better")}, {"__last": F.max("__b")})
    since = F.col("__nth") - F.greatest("__last", F.max("__better").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cut = cut.withColumn("__bad", since)
    stops = cut.groupBy(run).agg(F.min(F.when(F.col("__bad") >= patience, F.col(epoch))).alias("__stop"), F.max(epoch).alias("__end"))
    seen = join_few(cut, stops, [run]).where(F.col(epoch) <= F.coalesce("__stop", "__end"))
    return seen.groupBy(run).agg(F.max_by(epoch, F.struct(F.col(score), -F.col(epoch))).alias("best_epoch"), F.max(score).alias("best_score"), F.max(epoch).alias("stop_epoch"))


def log_check(rows: DataFrame, run: str, order: list[str], step: str, loss: str, tokens: str, **options: int) -> DataFrame:
    """(run, backwards, diverged, total_tokens, first_loss, last_loss, gain) of logs whose lines stand in ``order``.

    backwards: lines whose step is less than the one before; diverged: a loss that is infinite or no number;
    gain: how far the loss fell from the first line to the last.
    """
    cut = in_ranges(rows.select(*dict.fromkeys([run, *order, step, loss, tokens])), [run, *order], **options)
    cut = entering(cut, run, {"__s": F.max_by(step, "__at")}, {"__step": F.last("__s")})
    back = F.col(step) < F.coalesce(F.lag(step).over(within(run)), "__step")
    bad = F.isnan(loss) | (F.abs(F.col(loss)) == float("inf"))
    at = F.struct("__range", "__at")
    out = cut.withColumn("__back", back).groupBy(run).agg(F.count_if("__back").alias("backwards"), F.coalesce(F.bool_or(bad), F.lit(False)).alias("diverged"), F.max_by(tokens, at).alias("total_tokens"), F.min_by(loss, at).alias("first_loss"), F.max_by(loss, at).alias("last_loss"))
    return out.withColumn("gain", F.col("first_loss") - F.col("last_loss"))


def slope(rows: DataFrame, x: str, y: str, group: list[str] | None = None) -> DataFrame:
    """Least-squares slope; 0 for fewer than two points or a constant x."""
    return rows.groupBy(*(group or [])).agg(F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("slope"))
