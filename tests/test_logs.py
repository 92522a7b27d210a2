"""Training logs cut into ranges: the same as going through each run line by line."""

import random

import pytest

from quillon.operators import logs


@pytest.fixture(scope="module")
def lines(spark):
    rng = random.Random(3)
    rows = [(run, i, rng.choice([float(rng.randint(0, 50)), None if run == 2 else 7.0]), rng.randint(0, 5) + i) for run in (0, 1, 2, None) for i in range(200 if run == 0 else 30)]
    return rows, spark.createDataFrame(rows, "run int, epoch int, value double, step int").repartition(3)


def runs(rows):
    out = {}
    for run, *rest in rows:
        out.setdefault(run, []).append(rest)
    return out


@pytest.mark.parametrize("range_rows", [40, 10_000])
def test_running_best(lines, range_rows):
    rows, table = lines
    found = {(r["run"], r["epoch"]): (r["is_best"], r["best"]) for r in logs.running_best(table, "run", "epoch", "value", range_rows=range_rows).collect()}
    for run, entries in runs(rows).items():
        best = None
        for epoch, value, _ in entries:
            better = True if best is None else None if value is None else value < best
            best = value if best is None else best if value is None else min(best, value)
            assert found[run, epoch] == (better, best)


@pytest.mark.parametrize("range_rows", [40, 10_000])
def test_early_stop(lines, range_rows):
    rows, table = lines
    table = table.na.fill(0.0, ["value"])
    found = {r["run"]: (r["best_epoch"], r["best_score"], r["stop_epoch"]) for r in logs.early_stop(table, "run", "epoch", "value", 6, range_rows=range_rows).collect()}
    for run, entries in runs(rows).items():
        best, at, bad, stop = float("-inf"), None, 0, None
        for epoch, value, _ in entries:
            value, stop = value or 0.0, epoch
            bad = 0 if value > best else bad + 1
            if value > best:
                best, at = value, epoch
            if bad >= 6:
                break
        assert found[run] == (at, best, stop)
    with pytest.raises(ValueError):
        logs.early_stop(table, "run", "epoch", "value", 0)


@pytest.mark.parametrize("range_rows", [40, 10_000])
def test_log_check(spark, lines, range_rows):
    rows, table = lines
    found = {r["run"]: r for r in logs.log_check(table, "run", ["epoch"], "step", "value", "epoch", range_rows=range_rows).collect()}
    for run, entries in runs(rows).items():
        r = found[run]
        assert r["backwards"] == sum(b[2] < a[2] for a, b in zip(entries, entries[1:], strict=False))
        assert (r["total_tokens"], r["diverged"]) == (entries[-1][0], False)
        assert (r["first_loss"], r["last_loss"]) == (entries[0][1], entries[-1][1])
    bad = spark.createDataFrame([(1, 0, 5.0, 9), (1, 1, float("nan"), 8), (2, 0, 1.0, 1), (2, 1, float("-inf"), 2), (3, 0, 4.0, 0), (3, 1, 1.5, 0)], "run int, epoch int, value double, step int")
    got = {r["run"]: (r["backwards"], r["diverged"], r["gain"]) for r in logs.log_check(bad, "run", ["epoch"], "step", "value", "epoch").collect()}
    assert (got[1][:2], got[2], got[3]) == ((1, True), (0, True, float("inf")), (0, False, 2.5))
    assert logs.log_check(bad.where("false"), "run", ["epoch"], "step", "value", "epoch").count() == 0
