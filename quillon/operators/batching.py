"""Chats, prompt and answer, truncation, padding, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.order import global_position

IGNORED = -100
ROLES = ["system", "user", "assistant"]


def chatml(rows: DataFrame, conversation: str, turn: str, role: str, text: str, add_generation_prompt: bool = False) -> DataFrame:
    """(conversation, n_turns, rendered): the turns in order; a role that is none of ROLES is an error."""
    known = F.when(F.col(role).isin(ROLES), F.col(role)).otherwise(F.raise_error(F.concat(F.lit("unknown chat role "), F.col(role))))
    one = F.struct(F.col(turn).alias("t"), known.alias("r"), F.coalesce(text, F.lit("")).alias("x"))
    turns = F.array_sort(F.collect_list(one))
    body = F.array_join(F.transform(turns, lambda s: F.concat(F.lit("<|im_start|>"), s["r"], F.lit("\n"), s["x"], F.lit("<|im_end|>\n"))), "")
    out = F.concat(body, F.lit("<|im_start|>assistant\n")) if add_generation_prompt else body
    return rows.groupBy(conversation).agg(F.count("*").alias("n_turns"), out.alias("rendered"))


def prompt_and_answer(rows: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """(conversation, turn, prompt, completion) for each assistant turn right after a user turn."""
    w = Window.partitionBy(conversation).orderBy(turn)
    before = rows.withColumn("__role", F.lag(role).over(w)).withColumn("prompt", F.lag(text).over(w))
    return before.where((F.col(role) == "assistant") & (F.col("__role") == "user")).select(conversation, turn, "prompt", F.col(text).alias("completion"))


def common_prefix(left: Column, right: Column) -> Column:
    """Number of leading elements that agree."""
    agree = F.zip_with(left, right, lambda a, b: F.coalesce(a == b, F.lit(False)))
    first = F.array_position(agree, F.lit(False))
    return F.when(first == 0, F.size(agree)).otherwise(first - 1).cast("int")


def truncate(ids: Column, prompt_len: Column, most: int) -> tuple[Column, Column]:
    """(status, ids): kept, truncated at the tail, or dropped (null ids) if the prompt alone fills the room."""
    status = F.when(F.size(ids) <= most, "kept").when(prompt_len >= most, "dropped").otherwise("truncated")
    return status, F.when(status != "dropped", F.slice(ids, 1, most))


def padded_width(longest: Column, multiple: int | None = None) -> Column:
    return longest if not multiple else (F.ceil(longest / multiple) * multiple).cast("int")


def pad_right(values: Column, width: Column, fill: int) -> Column:
    return F.concat(values, F.array_repeat(F.lit(fill), F.greatest(width - F.size(values), F.lit(0))))


def pad_left(values: Column, width: Column, fill: int) -> Column:
    return F.concat(F.array_repeat(F.lit(fill), F.greatest(width - F.size(values), F.lit(0))), values)


def masked_labels(ids: Column, prompt_len: Column, width: Column) -> Column:
    """Labels of a right-padded row: IGNORED on the prompt and the padding."""
    return pad_right(F.transform(ids, lambda x, i: F.when(i < prompt_len, F.lit(IGNORED)).otherwise(x)), width, IGNORED)


def supervised(labels: Column) -> Column:
    return F.size(F.filter(labels, lambda y: y != IGNORED))


def until_stop(ids: Column, stops: Column) -> Column:
    """The ids before the first stop id."""
    at = F.aggregate(ids, F.struct(F.lit(0).alias("i"), F.lit(-1).alias("at")), lambda a, x: F.struct((a["i"] + 1).alias("i"), F.when((a["at"] < 0) & F.array_contains(stops, x), a["i"]).otherwise(a["at"]).alias("at")), lambda a: a["at"])
    return F.when(at < 0, ids).otherwise(F.slice(ids, F.lit(1), F.greatest(at, F.lit(0))))


def answer_length(ids: Column, eos: int, pad: int) -> Column:
    """Ids up to and with the end id, or before the first padding, else all."""
    end, fill = F.array_position(ids, F.lit(eos)), F.array_position(ids, F.lit(pad))
    return F.when(end > 0, end).when(fill > 0, fill - 1).otherwise(F.size(ids)).cast("int")


def in_batches(rows: DataFrame, order: list[str], size: int, accumulation: int = 1) -> DataFrame:
    """``rows`` with batch and step: chunks of ``size`` in the given order over all rows, ``accumulation`` batches a step.

    Places come from ranges of the order and the sizes of those before; no task holds all rows.
    """
    placed = global_position(rows, order, "__pos")
    return placed.withColumn("batch", F.floor(F.col("__pos") / size).cast("long")).withColumn("step", F.floor(F.col("__pos") / size / accumulation).cast("long")).drop("__pos")


def checked_feature(ids: Column, prompt_len: Column) -> Column:
    """``ids``, or an error unless 0 <= prompt_len < length: a feature without an answer teaches nothing."""
    ok = F.coalesce((prompt_len >= 0) & (prompt_len < F.size(ids)), F.lit(False))
    return F.when(ok, ids).otherwise(F.raise_error(F.lit("a feature needs an answer behind its prompt")).cast("array<int>"))


def checked_pair(chosen: Column, rejected: Column, prompt_len: Column) -> Column:
    """Number of leading ids that both sides share, or an error if it is less than the prompt."""
    shared = common_prefix(chosen, rejected)
    return F.when(shared >= prompt_len, shared).otherwise(F.raise_error(F.lit("the sides of a pair have different prompts")).cast("int"))


def collate_pairs(pairs: DataFrame, most: int, fill: int, multiple: int | None = None) -> DataFrame:
    """Preference pairs (batch, chosen, rejected, prompt_len) padded for a step: a pair survives only if both sides do.

    Columns: batch, chosen_ids, chosen_labels, rejected_ids, rejected_labels, width (one for both sides of all
    pairs of a batch), truncated (either side). A batch without a surviving pair is an error.
    """
    for side in ("chosen", "rejected"):
        status, ids = truncate(F.col(side), F.col("prompt_len"), most)
        pairs = pairs.withColumn(f"__{side}_status", status).withColumn(f"__{side}", ids)
    lives = (F.col("__chosen_status") != "dropped") & (F.col("__rejected_status") != "dropped")
    pairs = pairs.withColumn("__lives", lives)
    w = Window.partitionBy("batch")
    longest = F.max(F.when(F.col("__lives"), F.greatest(F.size("__chosen"), F.size("__rejected")))).over(w)
    pairs = pairs.withColumn("width", padded_width(longest, multiple))
    pairs = pairs.withColumn("width", F.when(F.col("width").isNull(), F.raise_error(F.lit("no pair of the batch survives")).cast("int")).otherwise(F.col("width")))
    # the error is of the batch, so the width is read before the dropped pairs go
    pairs = pairs.where(F.col("width").isNotNull() & F.col("__lives"))
    sides = [c for s in ("chosen", "rejected") for c in (pad_right(F.col(f"__{s}"), F.col("width"), fill).alias(f"{s}_ids"), masked_labels(F.col(f"__{s}"), F.col("prompt_len"), F.col("width")).alias(f"{s}_labels"))]
    truncated = (F.col("__chosen_status") == "truncated") | (F.col("__rejected_status") == "truncated")
    return pairs.select("batch", *(c for c in pairs.columns if c not in ("batch", "chosen", "rejected", "width") and not c.startswith("__")), *sides, "width", truncated.alias("truncated"))


def survival(pairs: DataFrame, most: int) -> DataFrame:
    """Per batch: pairs, kept, truncated and dropped ones, either side counting."""
    status = [truncate(F.col(s), F.col("prompt_len"), most)[0] for s in ("chosen", "rejected")]
    dropped, cut = (status[0] == "dropped") | (status[1] == "dropped"), (status[0] == "truncated") | (status[1] == "truncated")
    return pairs.groupBy("batch").agg(F.count("*").alias("pairs"), F.count_if(~dropped & ~cut).alias("kept"), F.count_if(~dropped & cut).alias("truncated"), F.count_if(dropped).alias("dropped"))


def sequences_digest(rows: DataFrame, group: str, order: list[str], ids: str) -> DataFrame:
    """(group, digest): SHA-256 over the ordered sequences of a group, each with its length in front so that boundaries count.

    Every sequence becomes a digest of its own before anything is gathered: 64 letters a row.
    """
    own = F.sha2(F.concat(F.size(ids).cast("string"), F.lit(":"), F.array_join(ids, ",")), 256)
    listed = F.array_sort(F.collect_list(F.struct(*order, own.alias("__digest"))))
    return rows.groupBy(group).agg(F.sha2(F.array_join(F.transform(listed, lambda s: s["__digest"]), ""), 256).alias("digest"))
