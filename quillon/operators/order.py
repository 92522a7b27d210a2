"""Places in a global order, and exact quantiles, without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quillon.shared import table

#: Rows of a range, about; ranges at most (beyond, they hold more rows).
RANGE_ROWS, MOST_RANGES = 1_000_000, 100_000
#: Rows of a bucket of values below which a quantile is read off directly; buckets a round.
FEW, BUCKETS = 10_000, 1024
#: Values of a group, at most, that an aggregate may hold.
FEW_IN_ALL = 1_000_000
#: Rows that may be broadcast; larger tables are exchanged.
SMALL = 50_000


def in_ranges(rows: DataFrame, order: list[Column | str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with __range and __at: ranges of about ``range_rows`` rows follow each other in ``order``, places count from 0 in each.

    The table is written once, so both numbers are the same whoever reads it. Rows that tie in ``order`` are dealt out by
    where they were read, so that no value, however frequent, has a range to itself; name further columns in ``order`` where ties must be
    settled. Nulls come first in ascending order.
    """
    n = rows.count()
    least = rows.sparkSession.sparkContext.defaultParallelism if n > 10_000 else 1
    ranges = max(least, min(-(-n // range_rows), MOST_RANGES))
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(ranges, *keys, "__tie").sortWithinPartitions(*keys, "__tie").drop("__tie")
    placed = table(dealt.withColumn("__id", F.monotonically_increasing_id()), "ordered")
    return placed.withColumn("__range", F.shiftright("__id", 33)).withColumn("__at", F.col("__id") % (1 << 33)).drop("__id")


def global_position(rows: DataFrame, order: list[Column | str], name: str = "pos", range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with ``name``: 0, 1, .. in ``order``, over all rows (ties: see ``in_ranges``).

    A row's place is its place in its range plus the sizes of the ranges before, which are the only thing that is
    gathered: one number a range. Empty in, empty out.
    """
    placed = in_ranges(rows, order, range_rows)
    sizes = placed.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__range", F.coalesce(before, F.lit(0)).alias("__before"))
    # MOST_RANGES rows of two numbers at most, so they may be broadcast
    out = placed.join(F.broadcast(offsets), "__range")
    return out.withColumn(name, F.col("__before") + F.col("__at")).drop("__range", "__before", "__at")


def entering(rows: DataFrame, run: str, sums: dict[str, Column], before: dict[str, Column]) -> DataFrame:
    """``rows`` of ranges with what a range of a run is entered with: aggregates ``sums`` of each range, and windows ``before`` over those of the ranges before."""
    w = Window.partitionBy(run).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy(run, "__range").agg(*(c.alias(n) for n, c in sums.items()))  # a row for each range of a run
    return join_few(rows, per.select(run, "__range", *(c.over(w).alias(n) for n, c in before.items())), [run, "__range"])


def within(run: str) -> WindowSpec:
    """The rows of a range of a run, in order."""
    return Window.partitionBy(run, "__range").orderBy("__at")


def quantiles(rows: DataFrame, value: Column | str, probabilities: list[float], group: list[str] | None = None) -> DataFrame:
    """One row a group: its columns, n (values that are neither null nor NaN) and q (array: linear quantiles), exactly.

    Groups of up to FEW_IN_ALL values are sorted as they are aggregated, a state of bounded size. If any group is larger,
    all go by selection: a round counts, in one pre-aggregated pass, how many values of every group fall into
    each of BUCKETS equal cells of the intervals that still hold a wanted rank, and keeps the cells that hold one. A
    cell of FEW values or less is read, one of a single distinct value is known. So no state grows with the number of
    distinct values. A group without a value has n 0 and nulls; without ``group`` there is always one row.
    """
    group = group or []
    keys = [f"__g{i}" for i in range(len(group) or 1)]
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    names = [F.col(g).alias(k) for g, k in zip(group, keys, strict=True)] if group else [F.lit(0).alias("__g0")]
    slim = rows.select(*names, F.when(~F.isnan(v), v).alias("__v"))
    most = slim.groupBy(*keys).agg(F.count("__v").alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= FEW_IN_ALL:
        sums = slim.groupBy(*keys) if group else slim
        out = sums.agg(F.count("__v").alias("n"), F.percentile("__v", F.array(*map(F.lit, probabilities))).alias("q"))
        none = F.array(*([F.lit(None).cast("double")] * len(probabilities)))
        return out.select(*(F.col(k).alias(g) for g, k in zip(group, keys, strict=False) if group), "n", F.coalesce("q", none).alias("q"))
    slim = table(slim, "quantile-values")
    heads = table(slim.groupBy(*keys).agg(F.count("__v").alias("n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")), "quantile-groups")
    slim = slim.where("__v IS NOT NULL")
    # the ranks, from 0, that linear quantiles lie between
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(x), F.ceil(x)) for x in ((F.col("n") - 1) * F.lit(p) for p in probabilities)))))
    # intervals [__lo, __hi] of a group: __low of its values lie below, __n inside; a row for each wanted rank inside
    open_ = heads.where("n > 0").select(*keys, "__lo", "__hi", F.lit(0).cast("long").alias("__low"), F.col("n").alias("__n"), F.explode(ranks).alias("__rank"))
    done = None
    while True:
        known = open_.where("__lo = __hi").select(*keys, "__rank", F.col("__lo").alias("__x"))
        open_ = open_.where("__lo < __hi")
        few, many = open_.where(F.col("__n") <= FEW), open_.where(F.col("__n") > FEW)
        read = join_few(slim, few.drop("__rank").distinct(), keys).where("__v BETWEEN __lo AND __hi")
        at = F.row_number().over(Window.partitionBy(*keys, "__lo").orderBy("__v")) - 1 + F.col("__low")
        read = read.select(*keys, at.alias("__at"), F.col("__v").alias("__x"))
        known = known.unionByName(join_few(read, few.select(*keys, "__rank"), keys).where("__rank = __at").select(*keys, "__rank", "__x"))
        done = known if done is None else done.unionByName(known)
        if not many.head(1):
            break
        done = table(done, "quantile-found")
        wide = F.col("__hi") / 2 - F.col("__lo") / 2
        cell = F.least(F.floor((F.col("__v") / 2 - F.col("__lo") / 2) / wide * BUCKETS), F.lit(BUCKETS - 1))
        inside = join_few(slim, many.drop("__rank").distinct(), keys).where("__v BETWEEN __lo AND __hi")
        cells = inside.groupBy(*keys, F.col("__lo").alias("__from"), "__low", cell.alias("__cell")).agg(F.count("*").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
        below = F.sum("__n").over(Window.partitionBy(*keys, "__from").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1))
        cells = cells.withColumn("__low", F.col("__low") + F.coalesce(below, F.lit(0)))
        held = join_few(cells, many.select(*keys, "__rank"), keys).where("__rank >= __low AND __rank < __low + __n")
        open_ = table(held.select(*keys, "__lo", "__hi", "__low", "__n", "__rank"), "quantile-open")
    found = done.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__x"))).alias("__m"))  # two ranks a probability at most
    both = join_few(heads, found, keys, "left")

    def linear(p: float) -> Column:
        at = (F.col("n") - 1) * F.lit(p)
        low, high = F.col("__m")[F.floor(at)], F.col("__m")[F.ceil(at)]
        return F.when(F.col("n") > 0, low + (high - low) * (at - F.floor(at)))

    q = F.array(*(linear(p) for p in probabilities)).alias("q")
    if group:
        return both.select(*(F.col(k).alias(g) for g, k in zip(group, keys, strict=True)), "n", q)
    none = rows.sparkSession.range(1).select(F.lit(0).alias("__g0"))
    return none.join(both, "__g0", "left").select(F.coalesce("n", F.lit(0)).alias("n"), q)


def join_few(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on group columns that may be null. ``b`` has a few rows a group: if that is SMALL in all, it is broadcast, else both are exchanged."""
    some = b.limit(SMALL + 1).toArrow()
    b = F.broadcast(b.sparkSession.createDataFrame(some, schema=b.schema)) if some.num_rows <= SMALL else b
    b = b.select(*(F.col(k).alias(f"{k}b") for k in keys), *(c for c in b.columns if c not in keys))
    on = F.col(keys[0]).eqNullSafe(F.col(f"{keys[0]}b"))
    for k in keys[1:]:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}b"))
    return a.join(b, on, how).drop(*(f"{k}b" for k in keys))
