"""Text files as numbered lines, however large: line numbers count from 1 in every file.

Spark reads a file in splits. The lines of a split are counted as they pass; the sums over the splits before,
one number a split, give what its first line is numbered.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.operators.order import join_few


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, value): the lines of all files of a path, numbered from 1 in each file.

    Lines end in LF, CR LF or CR. An empty file has no lines; a missing path is an error. Both passes must see the
    same splits: should the cluster change in between so that they do not, that is an error and no wrong number.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    sizes = raw.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    firsts = sizes.select("file", "block", F.coalesce(before, F.lit(0)).alias("first"), "n")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, 0
        for batch in batches:
            out = []
            for place in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True):
                now, at = place, (at + 1 if place == now else 0)
                out.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=["file", "block", "value", "at"])

    placed = join_few(raw.mapInArrow(number, "file string, block long, value string, at long"), firsts, ["file", "block"], "left")
    line = F.when(F.col("at") < F.col("n"), F.col("first") + F.col("at") + 1).otherwise(F.raise_error(F.concat(F.lit("splits changed while reading "), "file")).cast("long"))
    return placed.select("file", F.coalesce(line, F.raise_error(F.concat(F.lit("splits changed while reading "), "file")).cast("long")).alias("line"), "value")


def place(rows_file: str = "file", rows_line: str = "line") -> Column:
    """Where a line stands, for messages."""
    return F.concat(F.regexp_extract(rows_file, r"([^/]*)$", 1), F.lit(" line "), F.col(rows_line).cast("string"))
