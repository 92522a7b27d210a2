"""Statistics of paired comparisons: intervals, exact tests, the promotion gate."""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Discordant pairs up to which the exact test runs on integers.
EXACT_PAIRS = 100_000


def z_for(confidence: float) -> float:
    """Two-sided normal quantile."""
    if not 0 < confidence < 1:
        raise ValueError("confidence lies between 0 and 1")
    return NormalDist().inv_cdf(0.5 + confidence / 2)


def mcnemar_exact_p(lost: int, gained: int) -> float:
    """Two-sided exact binomial p-value of discordant counts; 1 without any.

    Up to EXACT_PAIRS by integers and one rounding division. Beyond, the terms are summed from the largest one,
    whose logarithm comes from Stirling's series and so loses no digits to differences of huge numbers.
    """
    n, low = lost + gained, min(lost, gained)
    if low < 0:
        raise ValueError("discordant counts are not negative")
    if not n:
        return 1.0
    if n <= EXACT_PAIRS:
        term = tail = 1
        for i in range(1, low + 1):
            term = term * (n - i + 1) // i
            tail += term
        return min(1.0, 2 * tail / (1 << n))
    if low < EXACT_PAIRS // 4:  # below 2^-1074 by far: n * (1 - entropy(1/4)) is over 18,000 bits
        return 0.0
    rest = lambda k: 1 / (12 * k) - 1 / (360 * k**3)  # noqa: E731  (of ln k! after Stirling's formula)
    off = (n - 2 * low) / n
    far = n / 2 * ((1 - off) * math.log1p(-off) + (1 + off) * math.log1p(off)) if off < 1 else math.inf
    term = math.exp(rest(n) - rest(low) - rest(n - low) - far) * math.sqrt(n / (2 * math.pi * low * (n - low)))
    tail, i = term, low
    while i and term > tail * 1e-18:
        term *= i / (n - i + 1)
        tail += term
        i -= 1
    return min(1.0, 2 * tail)


def mcnemar_corrected_p(lost: int, gained: int, exact_below: int = 25) -> float:
    """Exact for few discordant pairs, else chi-square with continuity correction."""
    n = lost + gained
    if n < exact_below:
        return mcnemar_exact_p(lost, gained)
    return math.erfc(math.sqrt((abs(lost - gained) - 1) ** 2 / n / 2))


@F.pandas_udf(DoubleType())
def _exact_p(lost: pd.Series, gained: pd.Series) -> pd.Series:
    return pd.Series([mcnemar_exact_p(int(b), int(c)) for b, c in zip(lost, gained, strict=True)], dtype="float64")


def mcnemar_exact(lost: Column, gained: Column) -> Column:
    """mcnemar_exact_p of each (aggregated) row; a null count is none."""
    count = lambda c: F.coalesce(c.cast("long"), F.lit(0).cast("long"))
    return _exact_p(count(lost), count(gained))


@F.pandas_udf(DoubleType())
def _rule_p(lost: pd.Series, gained: pd.Series) -> pd.Series:
    return pd.Series([mcnemar_corrected_p(int(b), int(c)) for b, c in zip(lost, gained, strict=True)], dtype="float64")


def mcnemar_rule(lost: Column, gained: Column) -> Column:
    """mcnemar_corrected_p of each (aggregated) row: exact below 25 discordant pairs, else chi-square corrected; a null count is none."""
    count = lambda c: F.coalesce(c.cast("long"), F.lit(0).cast("long"))
    return _rule_p(count(lost), count(gained))


@F.pandas_udf(DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    """Probability of a standard normal variable below x; null stays null."""
    return x.map(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)), na_action="ignore").astype("float64")


@F.pandas_udf(DoubleType())
def normal_inverse(p: pd.Series) -> pd.Series:
    """The standard normal quantile; outside (0, 1) the infinities and NaN."""
    inv = NormalDist().inv_cdf
    return p.map(lambda v: inv(v) if 0 < v < 1 else -math.inf if v == 0 else math.inf if v == 1 else math.nan, na_action="ignore").astype("float64")


def wilson(successes: Column, n: Column, z: float) -> tuple[Column, Column]:
    """Wilson score interval, widened to hold the point itself."""
    p = successes / n
    scale = 1 + z * z / n
    centre, half = (p + z * z / (2 * n)) / scale, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    return F.least(F.greatest(centre - half, F.lit(0.0)), p), F.greatest(F.least(centre + half, F.lit(1.0)), p)


@dataclass(frozen=True)
class Floors:
    """Limits of the promotion gate."""

    json: float = 0.95
    schema: float = 0.0
    slice_drop: float = 0.05
    field_drop: float = 0.10
    margin: float = 0.02
    alpha: float = 0.05


def gate(n: Column, json_rate: Column, schema_rate: Column, slices_down: Column, fields_down: Column, low: Column, p_value: Column, floors: Floors = Floors()) -> tuple[Column, Column]:
    """(decision, reasons): REJECT for any reason, PROMOTE if superior and significant, else HOLD."""
    checks = [
        (n == 0, "no paired examples"),
        (json_rate < floors.json, "json validity below floor"),
        (schema_rate < floors.schema, "schema validity below floor"),
        (slices_down > 0, "slice regression"),
        (fields_down > 0, "field recall regression"),
        (~(low > -floors.margin), "not non-inferior"),
    ]
    reasons = F.array_compact(F.array(*(F.when(c, F.lit(r)) for c, r in checks)))
    return F.when(F.size(reasons) > 0, "REJECT").when((low > 0) & (p_value <= floors.alpha), "PROMOTE").otherwise("HOLD"), reasons
