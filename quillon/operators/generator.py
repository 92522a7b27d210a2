"""A generator source: synthetic adviser notes with their gold records, reproducible from a seed.

Every value is drawn by a hash of (seed, split, slice, index, name), so any partition can be made anywhere, in
any order, and a row never depends on another. Slices share the same facts and differ in how a note tells them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from quillon.functions.draws import draw
from quillon.functions.text import basis_points, dollars, ordinal, spell_number

from .corpus import even_allocation

#: Slices in their order, splits in theirs.
SLICES = ["clean", "distractor", "mixed_formats", "absent_fields", "long_context", "many_items"]
SPLITS = ["train", "val", "test"]
_FIRST = ["Ada", "Ben", "Chloe", "Dev", "Elena", "Farid", "Grace", "Hugo", "Iris", "Jonah"]
_LAST = ["Abbott", "Baker", "Chen", "Dorsey", "Evans", "Fischer", "Gupta", "Hansen", "Ito", "Jansen"]
_RISKS = ["conservative", "moderate", "balanced", "growth", "high_growth"]
_PRODUCTS = ["Harbour Equity", "Term Deposit Ladder", "Granite Bonds", "Warehouse Trust", "Broad Market Basket", "Annuity One"]
_ACTIONS = ["buy", "sell", "hold", "switch"]
_GOALS = ["retire early", "repay the mortgage", "pay for university", "travel each year", "build a buffer"]
_FLAGS = ["passport unseen", "signature missing", "partner not present"]
_FILLER = "We also spoke about the weather, the football and the new office."


def _one(options: list[str], at: Column) -> Column:
    return F.element_at(F.lit(options), (at + 1).cast("int"))


def generate(spark: SparkSession, sizes: dict[str, int], seed: int = 1) -> DataFrame:
    """example_id, split, slice, note, gold (JSON): ``sizes`` rows per split, dealt evenly over the slices.

    Notes are unique over the corpus: a repeated note names its file number.
    """
    grid = None
    for split in SPLITS:
        if sizes.get(split):
            own = spark.range(len(SLICES)).select(F.lit(split).alias("split"), F.col("id").alias("s"), even_allocation(sizes[split], F.col("id"), len(SLICES)).alias("n"))
            own = own.where("n > 0").select("split", "s", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("index"))
            grid = own if grid is None else grid.union(own)
    if grid is None:
        raise ValueError("no rows asked for")
    rows = grid.withColumn("slice", _one(SLICES, F.col("s")))
    pull = lambda name, n: draw(F.concat_ws(":", F.lit(str(seed)), "split", "slice", F.col("index").cast("string"), F.lit(name)), n)
    many = F.when(F.col("slice") == "many_items", 5).otherwise(2)
    start = pull("product", len(_PRODUCTS))
    amount = lambda i: (pull(f"amount{i}", 90) + 5) * 1000 + F.when(F.col("slice") == "mixed_formats", 500).otherwise(0)
    facts = rows.select(
        "split",
        "slice",
        "index",
        F.concat_ws(" ", _one(_FIRST, pull("first", 10)), _one(_LAST, pull("last", 10))).alias("client"),
        F.date_add(F.lit("2026-01-01").cast("date"), pull("day", 360).cast("int")).alias("day"),
        _one(_RISKS, pull("risk", 5)).alias("risk"),
        F.array(_one(_GOALS, pull("goal", 5)), _one(_GOALS, (pull("goal", 5) + 1 + pull("goal2", 4)) % 5)).alias("goals"),
        # products without repetition: consecutive places of a circle
        F.slice(F.array(*(F.struct(_one(_PRODUCTS, (start + i) % len(_PRODUCTS)).alias("product"), _one(_ACTIONS, pull(f"action{i}", 4)).alias("action"), amount(i).cast("double").alias("amount")) for i in range(5))), F.lit(1), many).alias("advice"),
        ((pull("fee", 40) + 10) * 100).cast("double").alias("fee"),
        ((pull("pct", 150) + 20) / 100).alias("pct"),
        (pull("months", 4) * 3 + 3).cast("int").alias("months"),
        F.when(F.col("slice") == "absent_fields", F.array().cast("array<string>")).otherwise(F.array(_one(_FLAGS, pull("flag", 3)))).alias("flags"),
    )
    told = F.when(F.col("slice") == "mixed_formats", F.date_format("day", "d/M/yyyy")).otherwise(F.concat(ordinal(F.dayofmonth("day")), F.lit(" of "), F.date_format("day", "MMMM yyyy")))
    money = lambda x: F.when(F.col("slice") == "mixed_formats", F.concat(F.coalesce(spell_number(x), F.lit("")), F.lit(" dollars"))).otherwise(dollars(x))
    deals = F.array_join(F.transform("advice", lambda a: F.concat(a["action"], F.lit(" "), money(a["amount"]), F.lit(" of "), a["product"])), "; ")
    rate = F.when(F.col("slice") == "mixed_formats", basis_points(F.col("pct"))).otherwise(F.concat(F.col("pct").cast("string"), F.lit("%")))
    body = F.concat_ws(" ", F.concat(F.lit("Met "), F.col("client"), F.lit(" on the "), told, F.lit(".")), F.concat(F.lit("Risk profile "), F.regexp_replace("risk", "_", " "), F.lit("; wants to "), F.array_join("goals", " and to "), F.lit(".")), F.concat(F.lit("Agreed to "), deals, F.lit(".")), F.concat(F.lit("Fee "), money(F.col("fee")), F.lit(" and "), rate, F.lit(" a year; review in "), F.col("months").cast("string"), F.lit(" months.")), F.when(F.size("flags") > 0, F.concat(F.lit("Note: "), F.array_join("flags", ", "), F.lit("."))))
    extra = F.when(F.col("slice") == "distractor", F.lit(" Last year the fee was $9,999, which no longer holds.")).when(F.col("slice") == "long_context", F.concat(F.lit(" "), F.repeat(F.lit(_FILLER + " "), 8))).otherwise("")
    gold = F.to_json(F.struct(F.col("client").alias("client_name"), F.date_format("day", "yyyy-MM-dd").alias("record_date"), F.col("risk").alias("risk_profile"), F.col("goals").alias("objectives"), F.col("advice").alias("recommendations"), F.struct(F.col("fee").alias("advice_fee"), F.col("pct").alias("ongoing_fee_pct")).alias("fees"), F.col("months").alias("review_months"), "flags"))
    example = F.concat_ws("-", "split", "slice", F.lpad(F.col("index").cast("string"), 4, "0"))
    out = facts.select(example.alias("example_id"), "split", "slice", F.concat(body, extra).alias("note"), gold.alias("gold"))
    again = F.row_number().over(Window.partitionBy("note").orderBy("example_id"))
    return out.withColumn("__again", again).withColumn("note", F.when(F.col("__again") > 1, F.concat("note", F.lit(" File "), "example_id", F.lit("."))).otherwise(F.col("note"))).drop("__again")


#: Fixed value: what the model is told before the schema and the note.
INSTRUCTION = "Read the adviser's note and return the advice record it describes as one JSON object and nothing else."


def render_prompt(note: Column, schema: str, instruction: str = INSTRUCTION) -> Column:
    """Instruction, schema, note and a cue that leaves only the object to be written."""
    return F.concat(F.lit(f"{instruction}\n\nJSON Schema:\n{schema}\n\nAdviser note:\n"), note, F.lit("\n\nJSON object:\n"))


def _pull(key: str, n: int) -> int:
    """``draws.draw`` of one key."""
    return int(hashlib.md5(key.encode()).hexdigest()[:8], 16) % n


class SliceNotes:
    """A table function: the notes of one slice from the keys of its rows, one maker a slice.

    Used with a table argument that is partitioned by slice (and a share of it), so a call only ever sees one slice.
    """

    def __init__(self) -> None:
        self.makers = {"clean": self._clean, "distractor": self._distractor, "mixed_formats": self._mixed, "absent_fields": self._absent, "long_context": self._long, "many_items": self._many}

    @staticmethod
    def _facts(key: str) -> tuple[str, int]:
        return f"{_FIRST[_pull(key + ':first', 10)]} {_LAST[_pull(key + ':last', 10)]}", (_pull(key + ":amount", 90) + 5) * 1000

    def _clean(self, key: str) -> list[str]:
        client, amount = self._facts(key)
        return [f"{client} asks for {amount} dollars."]

    def _distractor(self, key: str) -> list[str]:
        return [f"{self._clean(key)[0]} Last year it was {(_pull(key + ':before', 90) + 5) * 1000}."]

    def _mixed(self, key: str) -> list[str]:
        client, amount = self._facts(key)
        return [f"{client} asks for ${amount:,}."]

    def _absent(self, key: str) -> list[str]:
        return [f"{self._facts(key)[0]} asks for nothing."]

    def _long(self, key: str) -> list[str]:
        return [self._clean(key)[0] + f" {_FILLER}" * (_pull(key + ":long", 5) + 1)]

    def _many(self, key: str) -> list[str]:
        return [f"{self._clean(key)[0]} Item {i + 1}." for i in range(_pull(key + ":items", 4) + 2)]

    def eval(self, row: Row) -> Iterator[tuple]:
        maker = self.makers.get(row["slice"])
        if maker is None:
            raise ValueError(f"unknown slice {row['slice']}")
        for at, note in enumerate(maker(row["key"])):
            yield row["key"], row["slice"], at, note


def slice_notes(rows: DataFrame, key: str, slice_: str, share: int = 100_000) -> DataFrame:
    """(key, slice, at, note): the notes that ``SliceNotes`` makes of every row's key; an unknown or null slice is an error.

    A slice may hold most rows: its rows are dealt out by their key over parts of about ``share`` rows of the table.
    """
    parts = max(1, rows.count() // share)
    slim = rows.select(F.col(key).cast("string").alias("key"), F.col(slice_).cast("string").alias("slice"))
    dealt = slim.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)))
    make = udtf(SliceNotes, returnType="key string, slice string, at int, note string")
    return make(dealt.asTable().partitionBy("slice", "part"))
