"""Global positions and exact quantiles, against sorting all rows in one place."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import order


@pytest.mark.parametrize("range_rows", [100, 10_000])
def test_global_position(spark, range_rows):
    rng = random.Random(1)
    given = [(rng.choice([None, *range(40)]), rng.choice(["a", "b", None]), i) for i in range(500)] + [(7, "hot", 0)] * 200
    rows = spark.createDataFrame(given, "a int, b string, i int").repartition(5)
    found = order.global_position(rows, ["a", F.desc("b"), "i"], "at", range_rows=range_rows).orderBy("at").collect()
    assert [r["at"] for r in found] == list(range(len(given)))
    key = lambda r: (r[0] is not None, r[0] or 0, [-ord(x) for x in r[1]] + [1] if r[1] is not None else [2], r[2])
    assert [(r["a"], r["b"], r["i"]) for r in found] == sorted(given, key=key)
    assert order.global_position(rows.where("false"), ["a"]).count() == 0


@pytest.mark.parametrize(("all_", "few"), [(10, 20), (10, 10_000), (1_000_000, 0)])
def test_quantiles(spark, monkeypatch, all_, few):
    monkeypatch.setattr(order, "FEW_IN_ALL", all_)
    monkeypatch.setattr(order, "FEW", few)
    monkeypatch.setattr(order, "BUCKETS", 8)
    rng = random.Random(2)
    given = [("even", float(i)) for i in range(101)] + [("hot", 5.0)] * 300 + [("hot", 6.0)] + [(None, rng.gauss(0, 1e9)) for _ in range(77)]
    given += [("wide", x) for x in (-1e308, 1e308, 0.0, 1e-300, float("inf"), 3.0)] + [("one", 4.0), ("none", None), ("none", float("nan"))]
    rows = spark.createDataFrame(given, "g string, v double").repartition(3)
    want = {}
    for g, v in given:
        want.setdefault(g, []).extend([v] if v is not None and v == v and abs(v) != float("inf") else [])
    ps = [0.0, 0.25, 0.5, 0.95, 1.0]
    found = {r["g"]: r for r in order.quantiles(rows.where("v IS NULL OR isnan(v) OR abs(v) < 1.1e308"), "v", ps, ["g"]).collect()}
    assert set(found) == set(want)
    for g, values in want.items():
        assert found[g]["n"] == len(values)
        if values:
            at = [(len(values) - 1) * p for p in ps]
            s = sorted(values)
            assert found[g]["q"] == pytest.approx([s[int(x)] + (s[int(np.ceil(x))] - s[int(x)]) * (x - int(x)) for x in at], rel=1e-12)
        else:
            assert found[g]["q"] == [None] * 5
    whole = order.quantiles(rows.where("g = 'even'"), F.col("v") * 2, [0.5]).first()
    assert (whole["n"], whole["q"]) == (101, [100.0])
    assert order.quantiles(rows.where("false"), "v", [0.5]).first().asDict() == {"n": 0, "q": [None]}
