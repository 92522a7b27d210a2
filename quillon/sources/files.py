"""Readers and writers of the file formats that language-model work passes around.

Everything goes through Spark's own readers, so any store that Spark reads will do. Bad input is an error
that names the place, never a row left out, except where a docstring says otherwise.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators.order import in_ranges, join_few

from .lines import place, read_lines

#: The labels of phrase files, in order.
SENTIMENTS = ["negative", "neutral", "positive"]
RECORD = "client_name STRING, record_date STRING, risk_profile STRING, objectives ARRAY<STRING>, recommendations ARRAY<STRUCT<product: STRING, action: STRING, amount: DOUBLE>>, fees STRUCT<advice_fee: DOUBLE, ongoing_fee_pct: DOUBLE>, review_months INT, flags ARRAY<STRING>"
EXAMPLE = f"example_id STRING, split STRING, slice STRING, note STRING, gold STRUCT<{RECORD}>"
SAMPLE = "example_id STRING, model STRING, sample_index INT, text STRING, prompt_tokens INT, completion_tokens INT, latency_ms DOUBLE"
PAIR = "example_id STRING, slice STRING, prompt STRING, chosen STRING, rejected STRING, chosen_reward DOUBLE, rejected_reward DOUBLE"
LOG = "step BIGINT, loss DOUBLE, lr DOUBLE, grad_norm DOUBLE, tokens BIGINT"


def _fail(message: Column, kind: str = "string") -> Column:
    return F.raise_error(message).cast(kind)


def read_jsonl(spark: SparkSession, path: str, schema: str, skip_blank: bool = True, order: str | None = None) -> DataFrame:
    """Typed rows, one JSON object a line. A bad line is an error that names file and line; blank lines too unless ``skip_blank``.

    ``order`` names a column that must not fall from one line of a file to the next (a log's step): that is an error as well.
    """
    lines = read_lines(spark, path)
    lines = lines.where(F.trim("value") != "") if skip_blank else lines
    kind = T._parse_datatype_string(schema).simpleString()
    # a line that does not fit the schema comes back without any field, or with itself in the last one
    rows = lines.select("file", "line", F.from_json("value", schema + ", __bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r.__bad").isNotNull()
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    checked = F.when(bad, _fail(F.concat(place(), F.lit(": bad line")), kind)).otherwise(F.struct(*(F.col(f"r.`{n}`").alias(n) for n in names)))
    rows = rows.select("file", "line", checked.alias("r"))
    if order:
        cut = in_ranges(rows, ["file", "line"])
        last = cut.groupBy("file", "__range").agg(F.max_by(F.col(f"r.{order}"), "__at").alias("__last"))
        last = last.withColumn("__last", F.last("__last").over(Window.partitionBy("file").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)))
        cut = join_few(cut, last, ["file", "__range"])
        before = F.coalesce(F.lag(f"r.{order}").over(Window.partitionBy("file", "__range").orderBy("__at")), "__last")
        rows = cut.withColumn("r", F.when(F.coalesce(F.col(f"r.{order}") < before, F.lit(False)), _fail(F.concat(place(), F.lit(f": {order} goes back")), kind)).otherwise(F.col("r")))
    return rows.select("r.*")


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def write_dataset(examples: DataFrame, path: str, seed: int, digests: DataFrame) -> None:
    """Examples by split as JSON lines, and a manifest of seed, counts and content digests."""
    examples.write.partitionBy("split").json(f"{path}/examples")
    counts = examples.groupBy("split").agg(F.count("*").alias("n")).join(digests, "split")
    counts.withColumn("seed", F.lit(seed)).withColumn("format", F.lit(1)).coalesce(1).write.json(f"{path}/manifest")


def read_dataset(spark: SparkSession, path: str, schema: str, digest: Column, key: str) -> DataFrame:
    """The examples, after format, counts and content digests were compared with the manifest."""
    from quillon.operators.corpus import split_digest

    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/examples")
    held = spark.read.json(f"{path}/manifest")
    if held.where("format <> 1").head(1):
        raise ValueError("unknown dataset format")
    found = split_digest(rows, "split", key, digest).join(rows.groupBy("split").agg(F.count("*").alias("m")), "split")
    wrong = held.withColumnRenamed("digest", "told").join(found, "split", "full_outer").where("told IS NULL OR digest IS NULL OR told <> digest OR n <> m").select("split").collect()
    if wrong:
        raise ValueError(f"content differs from the manifest in {sorted(r[0] for r in wrong)}")
    return rows


def parse_phrases(rows: DataFrame, content: str) -> DataFrame:
    """(line, text, label) from whole files of lines ``text@label``; the last @ parts them, blank lines are skipped."""
    lines = rows.select(F.posexplode(F.split(content, r"\r?\n"))).where(F.trim("col") != "")
    text, name = F.regexp_extract("col", r"^(.*)@([^@]*)$", 1), F.lower(F.trim(F.regexp_extract("col", r"^(.*)@([^@]*)$", 2)))
    at = F.array_position(F.lit(SENTIMENTS), name)
    label = F.when(at > 0, at - 1).otherwise(_fail(F.concat(F.lit("line "), (F.col("pos") + 1).cast("string"), F.lit(": no known label")), "int"))
    return lines.select((F.col("pos") + 1).alias("line"), F.trim(text).alias("text"), label.cast("int").alias("label"))


def read_phrase_zip(spark: SparkSession, path: str, agreement: str = "all") -> DataFrame:
    """Phrases from the member of a zip archive whose name ends in the agreement level, ISO-8859-1."""
    suffixes = {"all": "allagree.txt", "75": "75agree.txt", "66": "66agree.txt", "50": "50agree.txt"}
    if agreement not in suffixes:
        raise ValueError(f"agreement is one of {sorted(suffixes)}")

    def unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = [n for n in z.namelist() if n.lower().endswith(suffixes[agreement]) and not n.startswith("__MACOSX")]
                    if not names:
                        raise FileNotFoundError(f"no member ends in {suffixes[agreement]}")
                    yield pa.RecordBatch.from_arrays([pa.array([z.read(names[0]).decode("iso-8859-1")])], names=["content"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return parse_phrases(files.mapInArrow(unzip, "content string"), "content")


def read_completions(spark: SparkSession, path: str, golds: DataFrame | None = None) -> DataFrame:
    """(example_id, text, gold) from untyped JSON lines.

    The text is the first string among text, completion, output and response; gold stands in the line or in
    ``golds`` (example_id, gold); an id that is missing is line-N. A line without text or gold, or an
    unreadable one, is an error, and so is an empty file.
    """
    lines = read_lines(spark, path).withColumnRenamed("value", "col")
    if not lines.where("trim(col) <> ''").head(1):
        raise ValueError("no completions")
    v = F.try_parse_json("col")
    text = F.coalesce(*(F.try_variant_get(v, f"$.{k}", "string") for k in ("text", "completion", "output", "response")))
    at = F.concat(F.lit("line "), F.col("line").cast("string"))
    rows = lines.select(F.coalesce(F.get_json_object("col", "$.example_id"), F.concat(F.lit("line-"), F.col("line").cast("string"))).alias("example_id"), F.coalesce(text, _fail(F.concat(at, F.lit(": no completion")))).alias("text"), F.get_json_object("col", "$.gold").alias("own"), at.alias("at"))
    known = rows.join(golds.select("example_id", F.col("gold").alias("given")), "example_id", "left") if golds is not None else rows.withColumn("given", F.lit(None).cast("string"))
    return known.select("example_id", "text", F.coalesce("own", "given", _fail(F.concat("at", F.lit(": no gold record")))).alias("gold"))


def read_reports(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """All readable JSON documents of a glob with their file; unreadable ones are left out, as a catalogue should."""
    held = T._parse_datatype_string(schema + ", _corrupt STRING")
    rows = spark.read.schema(held).option("mode", "PERMISSIVE").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(pattern)
    return rows.withColumn("file", F.input_file_name()).where("_corrupt IS NULL").drop("_corrupt")


def stable_json(value: object) -> str:
    """Sorted keys, two spaces, a newline at the end: equal values give equal bytes."""
    return json.dumps(value, indent=2, sort_keys=True) + "\n"


def markdown_table(rows: DataFrame, order: list[str]) -> str:
    """A small result as a Markdown table in a fixed order; numbers have four decimals, and zero no sign."""
    found = rows.orderBy(*order).collect()
    show = lambda x: "-" if x is None else f"{x + 0.0:.4f}" if isinstance(x, float) else "yes" if x is True else "no" if x is False else str(x)
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(x) for x in r) + " |" for r in found]) + "\n"
