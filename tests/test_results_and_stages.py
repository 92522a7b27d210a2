"""Mined pairs and their losses, redrawn values, compared results, stages addressed by content, notes of slices."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import compare, corpus, generator, paired, preferences
from quillon.plans import runner


def samples_of(spark, given):
    return spark.createDataFrame(given, "example_id string, sample_index long, text string, reward double")


def test_losses_add_up(spark):
    rng = random.Random(12)
    given = [(f"e{e}", i, rng.choice("abcdef"), rng.randrange(8) / 7) for e in range(30) for i in range(rng.randint(1, 12))]
    samples = samples_of(spark, given)
    want = {"candidates": 0, "low_margin": 0, "identical": 0, "capped": 0, "kept": 0}
    ranked = {}
    for r in preferences.rank(samples, 5).collect():
        ranked.setdefault(r["example_id"], {})[r["rank"]] = r
    for own in ranked.values():
        eligible = 0
        for k in range(1, len(own) // 2 + 1):
            a, b = own[k], own[len(own) + 1 - k]
            want["candidates"] += 1
            if a["reward"] - b["reward"] < 0.3:
                want["low_margin"] += 1
            elif a["text"] == b["text"]:
                want["identical"] += 1
            else:
                eligible += 1
        want["kept"] += min(eligible, 2)
        want["capped"] += max(0, eligible - 2)
    assert preferences.mining_losses(samples, 5, 0.3, 2).first().asDict() == want
    pairs = preferences.mine_pairs(samples, 5, 0.3, 2)
    assert pairs.count() == want["kept"] and all(want.values())
    told = {r["violation"]: r["n"] for r in preferences.rejected_violations(pairs, samples.withColumn("v", F.when(F.col("sample_index") % 2 == 0, "even")), "v").collect()}
    index = [r["rejected_index"] for r in pairs.collect()]
    assert told == {"even": sum(i % 2 == 0 for i in index), "none": sum(i % 2 for i in index)}
    assert preferences.mining_losses(samples.where("false")).first().asDict() == dict.fromkeys(want, 0)


def test_mining_refuses_unknown_examples(spark):
    samples = samples_of(spark, [("a", 0, "x", 1.0), ("a", 1, "y", 0.0), ("b", 0, "x", 1.0)])
    examples = spark.createDataFrame([("a", "prompt a"), ("b", "prompt b"), ("c", "unused")], "example_id string, prompt string")
    assert [(r["example_id"], r["chosen"], r["rejected"], r["prompt"]) for r in preferences.mine(samples, examples).collect()] == [("a", "x", "y", "prompt a")]
    with pytest.raises(Exception, match="no example of this id: b"):
        preferences.mine(samples, examples.where("example_id <> 'b'")).collect()
    with pytest.raises(Exception, match="example occurs twice: a"):
        preferences.mine(samples, examples.union(examples.where("example_id = 'a'"))).collect()


def test_redraw(spark):
    rows = spark.range(60).withColumnRenamed("id", "k").repartition(4)
    pool = 64
    take = lambda k, a: int(hashlib.md5(f"{k}:{a}".encode()).hexdigest()[:8], 16) % pool
    value = lambda key, a: F.pmod(F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{a}")).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(pool))
    taken, waiting, want = set(), list(range(60)), {}
    for a in range(40):
        drawn = {}
        for k in waiting:
            drawn.setdefault(take(k, a), k)  # keys rise, so the first is the least
        won = {v: k for v, k in drawn.items() if v not in taken}
        taken |= set(won)
        want |= {k: (a, v) for v, k in won.items()}
        waiting = [k for k in waiting if k not in want]
        if not waiting:
            break
    rounds = max(a for a, _ in want.values()) + 1
    found = {r["k"]: (r["attempt"], r["value"]) for r in corpus.settle(rows, "k", value, rounds).collect()}
    assert found == want and rounds > 3 and len({v for _, v in found.values()}) == 60
    with pytest.raises(corpus.Unsettled, match="after 8 rounds"):
        corpus.settle(spark.range(3).withColumnRenamed("id", "k"), "k", lambda key, a: F.lit(1))
    first = corpus.first_appearance(spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (9, None)], "i int, t string"), "t", "i")
    assert sorted((r["i"], r["t"]) for r in first.collect()) == [(1, "a"), (2, "b"), (9, None)]


def test_tolerance_diff(spark):
    nan, inf = float("nan"), float("inf")
    left = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 1.0), (4, None), (5, nan), (6, inf), (7, 0.0), (None, 2.0), (8, inf)], "k int, v double")
    right = spark.createDataFrame([(1, 1.0 + 1e-10), (2, 1.1), (3, 1.2), (4, 1.0), (5, nan), (6, inf), (7, 1e-7), (None, 2.0), (9, 1.0), (8, 1.0)], "k int, v double")
    found = {r["k"]: r["status"] for r in compare.tolerance_diff(left, right, ["k"], "v", 1e-9, 1e-6, F.col("k") == 3).collect()}
    assert found == {1: "agree", 2: "disagree", 3: "explained", 4: "unavailable", 5: "agree", 6: "agree", 7: "agree", None: "agree", 8: "disagree", 9: "unavailable"}
    counts = {r["status"]: r["n"] for r in compare.agreement(compare.tolerance_diff(left, left, ["k"], "v")).collect()}
    assert counts == {"agree": 8, "explained": 0, "disagree": 0, "unavailable": 1}
    with pytest.raises(Exception, match="key twice on the right: 1"):
        compare.tolerance_diff(left, right.union(right.where("k = 1")), ["k"], "v").collect()
    assert compare.tolerance_diff(left.where("false"), right.where("false"), ["k"], "v").count() == 0


def test_only_what_stands_behind_a_change_runs(spark, tmp_path):
    calls = []

    def stage(name, make):
        def run(spark, needs, config):
            calls.append(name)
            return make(needs, config)

        return run

    stages = {
        "clean": (["docs"], stage("clean", lambda d, c: d["docs"].where("n > 0"))),
        "names": (["other"], stage("names", lambda d, c: d["other"])),
        "count": (["clean"], stage("count", lambda d, c: d["clean"].agg(F.count("*").alias("n")))),
        "scaled": (["count"], stage("scaled", lambda d, c: d["count"].select(F.col("n") * c["factor"]))),
        "both": (["scaled", "names"], stage("both", lambda d, c: d["scaled"].crossJoin(d["names"].limit(1)))),
    }
    keys = {"clean": [], "names": [], "count": [], "scaled": ["factor"], "both": []}
    config = {"run_dir": f"file://{tmp_path}/r", "factor": 2}

    def go(docs, other, **more):
        calls.clear()
        runner.run(spark, stages, config | more, inputs={"docs": docs, "other": other}, keys=keys)
        return list(calls)

    docs, other = spark.createDataFrame([(1, "a"), (2, "b"), (-1, "c")], "n int, t string"), spark.createDataFrame([("x",)], "t string")
    assert go(docs, other) == ["clean", "names", "count", "scaled", "both"]
    assert go(docs.repartition(3), other) == []  # the same content in other files
    assert go(docs, other.withColumn("t", F.lit("y"))) == ["names", "both"]
    assert go(docs, other.withColumn("t", F.lit("y")), factor=3) == ["scaled", "both"]
    other = other.withColumn("t", F.lit("y"))
    # a change that comes to the same count reaches no further
    assert go(docs.withColumn("t", F.upper("t")), other, factor=3) == ["clean", "count"]
    assert go(docs.union(docs), other, factor=3) == ["clean", "count", "scaled", "both"]
    held = {r["stage"]: r for r in runner.provenance(spark, config["run_dir"], list(stages))}
    assert held["both"]["needs"] == {"scaled": held["scaled"]["content"], "names": held["names"]["content"]}
    with pytest.raises(ValueError, match="clash"):
        runner.run(spark, stages, config, inputs={"clean": docs})
    # a stage that breaks off has no record, and runs again
    broken = stages | {"count": (["clean"], lambda s, d, c: d["clean"].select(F.raise_error(F.lit("no")).cast("int").alias("n")))}
    with pytest.raises(Exception, match="no"):
        runner.run(spark, broken, config | {"factor": 3}, inputs={"docs": docs, "other": other}, keys=keys)
    assert go(docs.union(docs), other, factor=3)[:2] == ["clean", "count"]


def test_slice_notes(spark):
    rng = random.Random(13)
    given = [(str(i), rng.choice(generator.SLICES)) for i in range(400)]
    found = generator.slice_notes(spark.createDataFrame(given, "id string, s string").repartition(5), "id", "s", share=30).collect()
    maker = generator.SliceNotes()
    assert sorted(map(tuple, found)) == sorted(t for k, s in given for t in maker.eval({"key": k, "slice": s}))
    with pytest.raises(Exception, match="unknown slice"):
        generator.slice_notes(spark.createDataFrame([("1", "other")], "id string, s string"), "id", "s").collect()


def test_verdicts(spark):
    rows = spark.createDataFrame([(-0.1, -0.06), (-0.04, 0.2), (0.01, 0.3), (-0.2, 0.1), (-0.05, 0.0)], "low double, high double")
    got = [tuple(r) for r in rows.select(*paired.verdict(F.col("low"), F.col("high"), 0.05)).collect()]
    assert got == [(False, False, True), (True, False, False), (True, True, False), (False, False, False), (False, False, False)]
