"""The batching policy over stretches of arrivals: the same as going through each server's arrivals one by one."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import serving


@pytest.mark.parametrize("range_rows", [60, 10_000])
def test_microbatches(spark, range_rows):
    rng = random.Random(14)
    given, t = [], {}
    for i in range(600):
        shard = rng.choice(["a", "a", "a", "b", None])
        t[shard] = t.get(shard, 0) + rng.choice([0, 0, 1, 1, 2, 3, 9, 10, 11, 25])
        given.append((shard, i, t[shard]))
    rows = spark.createDataFrame(given, "s string, id long, sec long").withColumn("ts", F.timestamp_seconds("sec")).repartition(4)
    found = {r["key"]: r["batch"] for r in serving.microbatches(rows, "s", "ts", "id", 10.0, 4, range_rows=range_rows).collect()}
    for shard in t:
        own = sorted((sec, i) for s, i, sec in given if s == shard)
        assert [found[i] for _, i in own] == serving.close_batches([float(sec) for sec, _ in own], 10.0, 4)
    assert len(found) == 600
    assert serving.microbatches(rows.where("false"), "s", "ts", "id", 10.0, 4).count() == 0
