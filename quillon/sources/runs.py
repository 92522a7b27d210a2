"""Run folders: predictions, configurations, metrics."""

from __future__ import annotations

import dataclasses
import hashlib
import io
import json
from collections.abc import Iterator, Sequence
from typing import Any, TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import stable_json

C = TypeVar("C")


def write_predictions(rows: DataFrame, path: str) -> None:
    """(row_id, probs, label) as Parquet; rows of unequal length, probabilities outside 0 to 1 or a label without one are an error."""
    ok = F.forall("probs", lambda p: p.between(0.0, 1.0)) & F.col("label").between(0, F.size("probs") - 1)
    checked = F.when(ok, F.col("probs")).otherwise(F.raise_error(F.concat(F.lit("bad prediction of row "), F.col("row_id").cast("string"))).cast("array<double>"))
    widths = rows.select(F.size("probs").alias("w")).distinct().limit(2).collect()
    if len(widths) > 1:
        raise ValueError("predictions of unequal numbers of classes")
    rows.select(F.col("row_id").cast("long"), checked.alias("probs"), F.col("label").cast("int")).write.parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("row_id long, probs array<double>, label int").parquet(path)


def read_npz(spark: SparkSession, path: str, probs: str = "probs", labels: str = "labels") -> DataFrame:
    """(path, row_id, probs, label) of .npz files with an [N, C] and an [N] array; lengths must agree."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with np.load(io.BytesIO(content.as_buffer()), allow_pickle=False) as held:
                    p, y = held[probs].astype(float), held[labels].astype(np.int64)
                if p.ndim != 2 or y.shape != p.shape[:1]:
                    raise ValueError(f"{name}: arrays of shapes {p.shape} and {y.shape}")
                for a in range(0, len(y), 10_000):
                    part = p[a : a + 10_000]
                    cols = [pa.array([name] * len(part)), pa.array(np.arange(a, a + len(part))), pa.array(list(part), pa.list_(pa.float64())), pa.array(y[a : a + 10_000].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(cols, names=["path", "row_id", "probs", "label"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(scan, "path string, row_id long, probs array<double>, label int")


def config_from(kind: type[C], given: dict[str, Any], where: str = "config") -> C:
    """A dataclass from a mapping, nested ones too; unknown keys are an error that names them."""
    import typing

    hints, known = typing.get_type_hints(kind), {f.name for f in dataclasses.fields(kind)}
    unknown = sorted(set(given) - known)
    if unknown:
        raise ValueError(f"{where}: unknown keys {unknown}, known are {sorted(known)}")
    nested = lambda k, v: config_from(hints[k], v, f"{where}.{k}") if dataclasses.is_dataclass(hints[k]) and isinstance(v, dict) else v
    return kind(**{k: nested(k, v) for k, v in given.items()})


def config_text(config: Any) -> str:
    return stable_json(dataclasses.asdict(config))


def config_digest(config: Any, without: Sequence[str] = ("run_dir",)) -> str:
    """The first 16 hex digits of the SHA-256 of the configuration, keys of where it runs left out."""
    kept = {k: v for k, v in dataclasses.asdict(config).items() if k not in without}
    return hashlib.sha256(json.dumps(kept, sort_keys=True).encode()).hexdigest()[:16]


def parse_config(text: str, overrides: Sequence[str] = ()) -> dict[str, Any]:
    """A YAML document (JSON, where no YAML reader is installed) with dotted ``a.b=value`` overrides, values read alike."""
    try:
        from yaml import safe_load as load
    except ImportError:
        load = json.loads
    config = load(text) if text.strip() else {}
    if not isinstance(config, dict):
        raise ValueError("a configuration is a mapping")
    for one in overrides:
        path, sign, value = one.partition("=")
        if not sign or not all(path.split(".")):
            raise ValueError(f"an override reads a.b=value, not {one!r}")
        *above, last = path.split(".")
        at = config
        for name in above:
            at = at.setdefault(name, {})
            if not isinstance(at, dict):
                raise ValueError(f"{name} in {one!r} is no mapping")
        at[last] = load(value)
    return config


def read_runs(spark: SparkSession, pattern: str, metrics: str) -> DataFrame:
    """(run, config, metrics of the schema) of every run folder of the glob; one without or with unreadable files is an error."""
    read = lambda name: spark.read.text(f"{pattern}/{name}", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1).alias("run"), F.col("value").alias(name.removesuffix(".json")))
    both = read("config.json").join(read("metrics.json"), "run", "full_outer")
    parsed = F.from_json("metrics", metrics, {"mode": "FAILFAST"})
    missing = F.concat(F.lit("run without its files: "), F.col("run"))
    whole = F.col("config").isNotNull() & F.col("metrics").isNotNull()
    return both.select(F.when(whole, F.col("run")).otherwise(F.raise_error(missing).cast("string")).alias("run"), "config", parsed.alias("m")).select("run", "config", "m.*")
