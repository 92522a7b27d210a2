"""The corpus pipeline: language ID, exact dedup, near dedup, PII masking, packing.

Every stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the
next one's docs. ``docs`` has the columns of ``documents`` in any order and spelling of case, and may have more, whatever they are
called; all but the last stage return the same columns. Any column may hold nulls. Texts of any length are read whole. An empty table stays
empty through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import table
from quillon.llm.exact_dedup import keep_winners
from quillon.llm.langid import keep_identified
from quillon.llm.packing import pack
from quillon.llm.pii import mask_pii
from quillon.llm.queries import WORD_TOKENIZER, tokenizer_file
from quillon.llm.simhash import keep_representatives

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without an identified language go: null and empty ones, those without a letter, and letter soup.

    ``lang`` becomes the language found. Learns from all rows that name one; if none does, every text with a letter stays. A
    row without id, and rows that repeat each other, are judged by their text like any other.
    """
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of identical texts the one of the largest id stays; null and empty texts are identical.

    Rows without id stay only if no row of their group has one; of rows that repeat id and text one stays.
    """
    return keep_winners(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id stays.

    Texts without a word, null ones among them, have the fingerprint zero and form a group of their own. Rows
    without id stay only if no row of their group has one; of rows that repeat id and text one stays.
    """
    return keep_representatives(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked: base spans, and those that their contexts lead to; ``n_chars``, if there, becomes the new length.

    Every row stays, in whatever number it stands; null texts stay null, empty ones empty.
    """
    return mask_pii(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences, one row a piece.

    Null and empty texts have one token, the end id. Repeated rows, and rows without id, are packed each; a text longer than a
    sequence is cut into as many pieces as it needs.
    """
    return pack(docs, tokenizer_file(WORD_TOKENIZER))


STAGES: list[tuple[str, Stage]] = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("pii", pii), ("packing", packing)]

#: SQL can express neither the classifier nor the links of fingerprints; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
