"""Resumable stages, addressed by content: a stage runs again only if what it is made from changed.

Each stage is a function of its predecessors; what it returns is written as Parquet, and beside it a record of its
configuration, of the content of all that it needs, and of its own content. Records hold no times, so equal
runs leave equal bytes.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Stage = Callable[[SparkSession, dict[str, DataFrame], dict], DataFrame]


class MissingUpstream(RuntimeError):
    """A stage was asked for without what it needs."""


@dataclass(frozen=True)
class Result:
    stage: str
    ran: bool
    rows: int


def config_digest(config: dict) -> str:
    """Sixteen hexadecimal digits; where a run is kept makes no difference."""
    own = {k: v for k, v in config.items() if k != "run_dir"}
    return hashlib.sha256(json.dumps(own, sort_keys=True).encode()).hexdigest()[:16]


def _record(spark: SparkSession, path: str) -> dict | None:
    if not _exists(spark, f"{path}/_SUCCESS"):
        return None
    row = spark.read.text(path, wholetext=True).first()
    return json.loads(row[0]) if row else None


def _exists(spark: SparkSession, path: str) -> bool:
    """Asks the store that the path names, whatever it is."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def content_digest(rows: DataFrame) -> str:
    """Sixteen hexadecimal digits of the rows as a multiset, whatever their order and files: schema, count and two sums of hashes."""
    names = [F.col(f"`{c}`") for c in rows.columns]
    whole = F.to_json(F.struct(*names), {"ignoreNullFields": "false"}) if names else F.lit("")
    told = rows.select(F.xxhash64(whole).alias("a"), F.xxhash64(F.concat(F.lit("#"), whole)).alias("b"))
    sums = told.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
    return hashlib.sha256(json.dumps([rows.schema.simpleString(), *map(str, sums)]).encode()).hexdigest()[:16]


def provenance(spark: SparkSession, root: str, stages: list[str]) -> list[dict]:
    """The records of the stages that have run below ``root``: what each was made from, and what it came to."""
    return [r for r in (_record(spark, f"{root}/{name}/record") for name in stages) if r]


def run(spark: SparkSession, stages: dict[str, tuple[list[str], Stage]], config: dict, only: list[str] | None = None, force: bool = False, inputs: dict[str, DataFrame] | None = None, keys: dict[str, list[str]] | None = None) -> list[Result]:
    """Run ``stages`` (name -> what it needs, function) in their order, whatever the order of ``only``.

    A stage needs stages before it or ``inputs`` (name -> table). Its address is a digest of its name, its part of the configuration (``keys``
    names the entries that a stage reads, all by default) and the content digests of all that it needs. It runs only
    if no result of that address is there; so a changed input reruns exactly what stands behind it, and of those only what its
    change still reaches: a stage whose result comes out the same as before changes no address after it. ``force``
    runs every stage asked for. Writing is in place: a run that breaks off leaves a stage without record, and it runs again.
    """
    root, digests, results = config["run_dir"], {}, []
    done: dict[str, DataFrame] = dict(inputs or {})
    unknown = set(only or []) - set(stages)
    if unknown:
        raise ValueError(f"unknown stages {sorted(unknown)}")
    if set(done) & set(stages):
        raise ValueError(f"names of inputs and stages clash: {sorted(set(done) & set(stages))}")
    for name, table in done.items():
        digests[name] = content_digest(table)
    for name, (needs, stage) in stages.items():
        data, record = f"{root}/{name}/data", f"{root}/{name}/record"
        missing = [n for n in needs if n not in digests]
        wanted = only is None or name in only
        if missing:
            if wanted:
                raise MissingUpstream(f"stage {name} needs {missing[0]}, which has not run with this configuration")
            continue
        own = config if keys is None or name not in keys else {k: config.get(k) for k in keys[name]}
        made = {"stage": name, "config": config_digest(own), "needs": {n: digests[n] for n in needs}}
        address = hashlib.sha256(json.dumps(made, sort_keys=True).encode()).hexdigest()[:16]
        held = _record(spark, record)
        fresh = held is not None and held.get("address") == address and _exists(spark, f"{data}/_SUCCESS")
        if not wanted and not fresh:
            continue
        ran = wanted and (force or not fresh)
        if ran:
            # without its record a half-written result counts as none
            spark.createDataFrame([("null",)], "value string").coalesce(1).write.mode("overwrite").text(record)
            stage(spark, {n: done[n] for n in needs}, config).write.mode("overwrite").parquet(data)
            out = spark.read.parquet(data)
            held = made | {"address": address, "rows": out.count(), "content": content_digest(out)}
            spark.createDataFrame([(json.dumps(held, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(record)
        done[name], digests[name] = spark.read.parquet(data), held["content"]
        if wanted:
            results.append(Result(name, ran, held["rows"]))
    return results
