"""Transforms of logit arrays and losses of preference pairs, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _neg_inf() -> Column:
    return F.lit("-Infinity").cast("double")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once: inside a lambda a plain column is evaluated for every element."""
    return F.transform(F.array(value), body)[0]


def folded(values: Column, n: int) -> Column:
    """``n`` sums: of every n-th element from the first on, from the second on, and so on."""

    def at(k: int) -> Callable[[Column, Column], Column]:
        return lambda _, i: i % n == k

    return F.array(*(F.aggregate(F.filter(values, at(k)), F.lit(0.0), lambda a, x: a + x) for k in range(n)))


def softmax(logits: Column) -> Column:
    """Probabilities, stable against large logits."""
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda a, b: a + b)
    shifted = let(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))
    return let(shifted, lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def argmax(values: Column) -> Column:
    """Index (from 0) of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def top_k(logits: Column, k: int) -> Column:
    """All below the k-th largest become -inf; ties with it stay; k <= 0 or >= size changes nothing."""
    if k <= 0:
        return logits
    floor = F.element_at(F.sort_array(logits, asc=False), k)
    return F.when(F.size(logits) <= k, logits).otherwise(let(floor, lambda f: F.transform(logits, lambda x: F.when(x >= f, x).otherwise(_neg_inf()))))


def top_p(logits: Column, p: float) -> Column:
    """Keeps a token while the mass before it, by falling probability, is at most ``p``; the first always stays."""
    if p >= 1:
        return logits
    ranked = F.array_sort(F.transform(softmax(logits), lambda q, i: F.struct((-q).alias("q"), i.alias("i"))))
    start = F.struct(F.lit(0.0).alias("mass"), F.array().cast("array<int>").alias("keep"))
    kept = F.aggregate(ranked, start, lambda a, r: F.struct((a["mass"] - r["q"]).alias("mass"), F.when(a["mass"] <= p, F.concat(a["keep"], F.array(r["i"]))).otherwise(a["keep"]).alias("keep")), lambda a: a["keep"])
    return let(kept, lambda own: F.transform(logits, lambda x, i: F.when(F.array_contains(own, i), x).otherwise(_neg_inf())))


def repetition_penalty(logits: Column, seen: Column, penalty: float) -> Column:
    """Logits of seen ids shrink towards less likely: divided if positive, multiplied otherwise."""
    return F.transform(logits, lambda x, i: F.when(F.array_contains(seen, i), F.when(x > 0, x / penalty).otherwise(x * penalty)).otherwise(x))


def sample(logits: Column, uniform: Column, temperature: float = 1.0, k: int = 0, p: float = 1.0) -> Column:
    """Token drawn from softmax(top_p(top_k(logits / temperature))) by a uniform number; temperature 0: argmax."""
    if temperature == 0:
        return argmax(logits)
    probs = softmax(top_p(top_k(F.transform(logits, lambda x: x / temperature), k), p))
    start = F.struct(F.lit(0.0).alias("mass"), F.lit(-1).alias("at"), F.lit(0).alias("n"))
    step = lambda a, q: F.struct((a["mass"] + q).alias("mass"), F.when((a["at"] < 0) & (uniform < a["mass"] + q), a["n"]).otherwise(a["at"]).alias("at"), (a["n"] + 1).alias("n"))
    # mass that rounding leaves over goes to the likeliest token
    return let(probs, lambda own: let(F.aggregate(own, start, step, lambda a: a["at"]), lambda at: F.when(at >= 0, at).otherwise(argmax(own))))


def log_sigmoid(u: Column) -> Column:
    return F.least(u, F.lit(0.0)) - F.log1p(F.exp(-F.abs(u)))


def preference_loss(h: Column, beta: float, variant: str, smoothing: float = 0.0) -> Column:
    """Loss of a pair whose log-ratio difference is ``h``: sigmoid, ipo or cdpo."""
    if variant == "sigmoid":
        return -log_sigmoid(h * beta)
    if variant == "ipo":
        return F.pow(h - F.lit(1 / (2 * beta)), 2)
    if variant == "cdpo":
        return -(1 - smoothing) * log_sigmoid(h * beta) - smoothing * log_sigmoid(-h * beta)
    raise ValueError(f"unknown variant {variant!r}")


def sequence_logprob(token_logprobs: Column, labels: Column, average: bool = False) -> Column:
    """Sum (or mean) of the log-probabilities whose label is not -100; 0 if there is none."""
    kept = F.filter(F.zip_with(token_logprobs, labels, lambda p, y: F.when(y != -100, p)), lambda p: p.isNotNull())
    total = F.aggregate(kept, F.lit(0.0), lambda a, b: a + b)
    return F.when(F.size(kept) == 0, 0.0).otherwise(total / F.size(kept)) if average else total


def cosine_with_warmup(step: Column, total: int, warmup: int) -> Column:
    """step / warmup, then a half cosine to 0."""
    progress = (step - warmup) / F.lit(float(max(1, total - warmup)))
    return F.when(step < warmup, step / F.lit(float(max(1, warmup)))).otherwise(F.greatest(F.lit(0.0), 0.5 * (1 + F.cos(F.lit(3.141592653589793) * F.least(progress, F.lit(1.0))))))


def cosine_to_floor(step: Column, base: float, warmup: int, total: int, floor: float) -> Column:
    """base * (step + 1) / warmup, then a half cosine from base to floor."""
    progress = F.least((step - warmup) / F.lit(float(max(1, total - warmup))), F.lit(1.0))
    return F.when(step < warmup, base * (step + 1) / F.lit(float(max(1, warmup)))).otherwise(floor + 0.5 * (base - floor) * (1 + F.cos(F.lit(3.141592653589793) * progress)))


def linear_decay(step: Column, total: int, warmup: int) -> Column:
    """step / warmup, then linearly to 0."""
    return F.when(step < warmup, step / F.lit(float(max(1, warmup)))).otherwise(F.greatest(F.lit(0.0), (total - step) / F.lit(float(max(1, total - warmup)))))
