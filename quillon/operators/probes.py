"""Probes of general instruction following: families of predicates over replies, a table of probes, their scores."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import list_items, word_count

from .checked import complete

_MARKS = r"[^\p{L}\p{N}\s]"


def _bare(text: Column) -> Column:
    """The text with marks turned into blanks, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, _MARKS, " "), r"^\s+|\s+$", ""))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


#: The families: name -> (text, argument, limit) -> does the reply have the property?
FAMILIES: dict[str, Callable[[Column, str, int], Column]] = {
    "single_word": lambda t, a, n: word_count(_bare(t)) == 1,
    "item_count": lambda t, a, n: F.size(list_items(t)) == n,
    "one_of": lambda t, a, n: F.lower(_bare(t)).isin([x.lower() for x in a.split("|")]),
    "starts_within": lambda t, a, n: F.startswith(F.lower(_stripped(t)), F.lit(a.lower())) & (word_count(t) <= n),
    "word_limit": lambda t, a, n: word_count(t).between(1, n),
    "letter_free": lambda t, a, n: (_stripped(t) != "") & ~F.contains(F.lower(t), F.lit(a.lower())),
    "exactly": lambda t, a, n: _stripped(t) == a,
}

#: (probe_id, kind, family, argument, limit, instruction)
PROBES = [
    ("word_metal", "one_word", "single_word", "", 0, "Name one metal. Use a single word."),
    ("word_sum", "one_word", "single_word", "", 0, "What is four plus five? Answer in one word."),
    ("word_animal", "one_word", "single_word", "", 0, "Which animal barks? One word, please."),
    ("word_month", "one_word", "single_word", "", 0, "Which month comes after May? Give just the word."),
    ("rule_true_false", "constraint", "one_of", "true|false", 0, "True or false, and nothing else: ice floats on water."),
    ("rule_opening", "constraint", "starts_within", "since", 25, "Why do birds sing? Start with the word Since; 25 words at most."),
    ("rule_short", "constraint", "word_limit", "", 6, "Say what a bridge is for, in six words or fewer."),
    ("rule_no_a", "constraint", "letter_free", "a", 0, "Write a sentence on the moon that never uses the letter a."),
    ("rule_echo", "constraint", "exactly", "17", 0, "Print the number 17 and stop."),
    ("list_trees", "list_length", "item_count", "", 4, "Name four trees, each on its own line."),
    ("list_rivers", "list_length", "item_count", "", 3, "Name three rivers, each on its own line."),
    ("list_tools", "list_length", "item_count", "", 2, "Name two garden tools, each on its own line."),
]
_SCHEMA = "probe_id string, kind string, family string, argument string, limit int, instruction string"


def probes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROBES, _SCHEMA)


def passed(text: Column, probe: Column, table: list[tuple] = PROBES) -> Column:
    """Does the reply satisfy the probe of this id? Null texts count as empty, unknown ids give null."""
    text, out = F.coalesce(text, F.lit("")), None
    for name, _, family, argument, limit, _ in table:
        ok = FAMILIES[family](text, argument, limit)
        out = F.when(probe == name, ok) if out is None else out.when(probe == name, ok)
    return out


def score_probes(replies: DataFrame, table: list[tuple] = PROBES) -> DataFrame:
    """(probe_id, kind, passed) of the replies (probe_id, text): one reply to each probe, or an error."""
    known = replies.sparkSession.createDataFrame(table, _SCHEMA).select("probe_id", "kind")
    return complete(replies.select("probe_id", "text"), known, "probe_id").select("probe_id", "kind", passed(F.col("text"), F.col("probe_id"), table).alias("passed"))


def respond(rows: DataFrame, prompt: str, answer: Callable[[list[str]], list[str]], size: int = 32, out: str = "text") -> DataFrame:
    """``rows`` with a model's answers in column ``out``: the boundary to a batch function, called in the tasks.

    ``answer`` gets at most ``size`` prompts at once and must return as many answers. What it needs (a model)
    it makes itself at its first call in a worker, so it must be picklable.
    """

    @F.pandas_udf("string")
    def call(prompts: pd.Series) -> pd.Series:
        found: list[str] = []
        for a in range(0, len(prompts), size):
            part = prompts.iloc[a : a + size].tolist()
            got = list(answer(part))
            if len(got) != len(part):
                raise ValueError(f"{len(got)} answers to {len(part)} prompts")
            found += got
        return pd.Series(found, index=prompts.index, dtype="object")

    return rows.withColumn(out, call(prompt))
