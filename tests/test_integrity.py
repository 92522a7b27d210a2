"""Joins that refuse bad keys, probes, run folders, pairs for a step, the answers of a server: what is an error, and what is not."""

import dataclasses
import hashlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions.draws import blake_seed
from quillon.operators import batching, checked, paired, preferences, probes, serving
from quillon.sources import runs
from quillon.streaming.requests import Service


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_matched(spark):
    samples = frame(spark, [("a", 1), ("a", 2), ("b", 3)], "id string, s int")
    examples = frame(spark, [("a", "x"), ("b", "y"), ("c", "z")], "id string, e string")
    assert sorted(tuple(r) for r in checked.matched(samples, examples, "id").select("id", "s", "e").collect()) == [("a", 1, "x"), ("a", 2, "x"), ("b", 3, "y")]
    with pytest.raises(Exception, match="no example of this id: q"):
        checked.matched(samples.union(frame(spark, [("q", 4)], "id string, s int")), examples, "id").collect()
    with pytest.raises(Exception, match="no example of this id: null"):
        checked.matched(samples.union(frame(spark, [(None, 4)], "id string, s int")), examples, "id").collect()
    with pytest.raises(Exception, match="example occurs twice: b"):
        checked.matched(samples, examples.union(frame(spark, [("b", "w")], "id string, e string")), "id").collect()
    with pytest.raises(Exception, match="a second sample of this id: a"):
        checked.one_to_one(samples, examples, "id").collect()
    assert checked.matched(samples.where("false"), examples, "id").count() == 0
    assert checked.sole_label(samples, "s", "given") == "given"
    with pytest.raises(ValueError, match="same in all rows"):
        checked.sole_label(samples, "id")


def test_probes(spark):
    good = {"word_metal": "Iron.", "word_sum": " nine ", "word_animal": "Dog!", "word_month": "'June'", "rule_true_false": "TRUE.", "rule_opening": "Since they are glad", "rule_short": "To cross a river", "rule_no_a": "The moon is full.", "rule_echo": "17\n", "list_trees": "- oak\n- elm\n\n3. fir\n* ash", "list_rivers": "Rhine\nDuero\nLoire", "list_tools": "rake\nhoe"}
    rows = frame(spark, list(good.items()), "probe_id string, text string")
    assert all(r["passed"] for r in probes.score_probes(rows).collect())
    bad = {"word_metal": "Iron ore", "word_sum": "", "word_animal": "a dog", "word_month": "...", "rule_true_false": "perhaps", "rule_opening": "Because", "rule_short": "one two three four five six seven", "rule_no_a": "A cat", "rule_echo": "17.", "list_trees": "oak", "list_rivers": "", "list_tools": None}
    assert not any(r["passed"] for r in probes.score_probes(frame(spark, list(bad.items()), "probe_id string, text string")).collect())
    for wrong in (rows.where("probe_id <> 'rule_echo'"), rows.union(frame(spark, [("rule_two", "x")], "probe_id string, text string")), rows.union(rows.limit(1))):
        with pytest.raises(Exception, match="unknown, missing or given twice"):
            probes.score_probes(wrong).collect()


def test_respond(spark):
    rows = frame(spark, [(i, f"p{i}") for i in range(10)], "i int, prompt string")
    assert {r["i"]: r["text"] for r in probes.respond(rows, "prompt", lambda xs: [x.upper() for x in xs], 3).collect()} == {i: f"P{i}" for i in range(10)}
    with pytest.raises(Exception, match="1 answers to"):
        probes.respond(rows, "prompt", lambda xs: xs[:1], 3).collect()


def test_bootstrap_of_any_metric(spark):
    rows = frame(spark, [(i, float(i % 2)) for i in range(400)], "id int, v double")
    mean = lambda w: F.sum(w * F.col("v")) / F.sum(w)
    r = paired.bootstrap_metric(rows, "id", mean, 300, 0.95, 1).first()
    assert r["point"] == 0.5 and r["low"] < 0.5 < r["high"] and r["high"] - r["low"] == pytest.approx(2 * 1.96 * 0.025, rel=0.25)
    weights = spark.range(20_000).select(paired.poisson_weight(F.col("id").cast("string")).alias("w")).agg(F.avg("w").alias("m"), F.var_samp("w").alias("v")).first()
    assert weights["m"] == pytest.approx(1, abs=0.03) and weights["v"] == pytest.approx(1, abs=0.05)


def test_mining_report(spark):
    samples = frame(spark, [("p", i, f"t{i}", r, "x") for i, r in enumerate([0.9, 0.1, 0.5])] + [("q", 0, "a", 1.0, "x"), ("q", 1, "b", 1.0, "x"), ("s", 0, "a", 0.2, "y")], "example_id string, sample_index int, text string, reward double, slice string")
    found = {r["slice"]: r for r in preferences.mining_report(samples, preferences.mine_pairs(samples.drop("slice")), "slice").collect()}
    x = found["x"]
    assert (x["prompts"], x["samples"], x["pairs"], x["paired"], x["saturated"], x["saturation_rate"], x["mean_margin"]) == (2, 5, 1, 1, 1, 0.5, pytest.approx(0.8))
    assert found["y"]["single_sample"] == 1 and found["y"]["mean_margin"] is None


def test_pairs(spark):
    schema = "batch int, chosen array<int>, rejected array<int>, prompt_len int"
    rows = frame(spark, [(0, [1, 2, 3], [1, 2, 9, 9, 9], 2), (0, [1, 2, 3, 4, 5, 6, 7], [1, 2, 3, 4, 5, 6, 8], 6)], schema)
    r, = batching.collate_pairs(rows, 4, 0, 8).collect()
    assert (r["chosen_ids"], r["rejected_ids"]) == ([1, 2, 3, 0, 0, 0, 0, 0], [1, 2, 9, 9, 0, 0, 0, 0]) and r["truncated"]
    assert r["rejected_labels"] == [-100, -100, 9, 9, -100, -100, -100, -100]
    with pytest.raises(Exception, match="no pair of the batch survives"):
        batching.collate_pairs(rows.where("prompt_len = 6"), 4, 0).collect()
    assert [tuple(r) for r in batching.survival(rows, 4).collect()] == [(0, 2, 0, 1, 1)]
    with pytest.raises(Exception, match="different prompts"):
        rows.select(batching.checked_pair(F.col("chosen"), F.col("rejected"), F.lit(3))).collect()
    with pytest.raises(Exception, match="needs an answer"):
        rows.select(batching.checked_feature(F.col("chosen"), F.lit(3))).collect()


def test_sequences_digest_counts_boundaries(spark):
    one = frame(spark, [("a", 0, [1, 2]), ("a", 1, [3]), ("b", 0, [1]), ("b", 1, [2, 3])], "g string, i int, ids array<int>")
    found = {r["g"]: r["digest"] for r in batching.sequences_digest(one, "g", ["i"], "ids").collect()}
    assert found["a"] != found["b"]
    assert found["a"] == hashlib.sha256("".join(hashlib.sha256(x).hexdigest() for x in (b"2:1,2", b"1:3")).encode()).hexdigest()


def test_runs(spark, tmp_path):
    rows = frame(spark, [(0, [0.25, 0.75], 1), (1, [1.0, 0.0], 0)], "row_id long, probs array<double>, label int")
    runs.write_predictions(rows, f"file://{tmp_path}/p")
    assert sorted(tuple(r) for r in runs.read_predictions(spark, f"file://{tmp_path}/p").collect()) == [(0, [0.25, 0.75], 1), (1, [1.0, 0.0], 0)]
    with pytest.raises(Exception, match="bad prediction of row 5"):
        runs.write_predictions(frame(spark, [(5, [0.5, 1.5], 0)], "row_id long, probs array<double>, label int"), f"file://{tmp_path}/q")
    held = io.BytesIO()
    np.savez(held, probs=np.array([[0.1, 0.9]]), labels=np.array([1]))
    (tmp_path / "x.npz").write_bytes(held.getvalue())
    assert [(r["row_id"], r["probs"], r["label"]) for r in runs.read_npz(spark, f"file://{tmp_path}/x.npz").collect()] == [(0, [0.1, 0.9], 1)]
    for name, loss in (("r1", 0.5), ("r2", 0.25)):
        (tmp_path / "runs" / name).mkdir(parents=True)
        (tmp_path / "runs" / name / "config.json").write_text("{}")
        (tmp_path / "runs" / name / "metrics.json").write_text(f'{{"loss": {loss}}}')
    found = runs.read_runs(spark, f"file://{tmp_path}/runs/*", "loss double")
    assert sorted((r["run"], r["loss"]) for r in found.collect()) == [("r1", 0.5), ("r2", 0.25)]
    (tmp_path / "runs" / "r2" / "metrics.json").unlink()
    with pytest.raises(Exception, match="run without its files: r2"):
        runs.read_runs(spark, f"file://{tmp_path}/runs/*", "loss double").collect()


@dataclasses.dataclass
class Inner:
    rank: int = 4


@dataclasses.dataclass
class Outer:
    run_dir: str = "here"
    rate: float = 0.1
    inner: Inner = dataclasses.field(default_factory=Inner)


def test_configs():
    config = runs.config_from(Outer, runs.parse_config("rate: 0.5\ninner: {rank: 2}", ["inner.rank=16", "run_dir=there"]))
    assert (config.rate, config.inner.rank, config.run_dir) == (0.5, 16, "there")
    with pytest.raises(ValueError, match=r"config.inner: unknown keys \['rnk'\]"):
        runs.config_from(Outer, {"inner": {"rnk": 1}})
    with pytest.raises(ValueError, match="reads a.b=value"):
        runs.parse_config("{}", ["rate"])
    assert runs.config_digest(config) == runs.config_digest(dataclasses.replace(config, run_dir="elsewhere")) != runs.config_digest(dataclasses.replace(config, rate=1.0))
    assert runs.config_text(config).endswith("}\n")


def test_serving(spark):
    rows = frame(spark, [(0, 90, 20, [4, 5, 2, 6]), (1, 90, 40, [4, 5, 6]), (2, 1, 2, [4, 5, 2])], "id int, prompt_tokens int, most_new int, ids array<int>")
    found = {r["id"]: r for r in serving.finished(serving.admitted(rows, 120), "ids", 2).collect()}
    assert [(found[i]["status"], found[i]["finish_reason"], found[i]["answer"]) for i in range(3)] == [("ok", "stop", [4, 5]), ("too_long", "length", [4, 5, 6]), ("ok", "length", [4, 5])]
    made = frame(spark, [(0, None, 1.0, 2.0), (0, "lost", 1.5, 4.0), (1, None, 0.0, 1.0)], "b int, e string, s double, t double")
    assert sorted((r["b"], r["status"], r["latency_s"]) for r in serving.settled(made, ["b"], "e", "s", "t").collect()) == [(0, "failed", 3.0), (0, "failed", 3.0), (1, "done", 1.0)]
    text = serving.prometheus(frame(spark, [("b", 2.0), ('a"', 1.5)], "status string, n double"), "served", ["status"], "n")
    assert text.splitlines()[2:] == ['served{status="a\\""} 1.5', 'served{status="b"} 2']


def test_service(spark):
    service = Service(lambda: spark.readStream.format("rate").load().writeStream.format("noop").start())
    assert not service.running
    service.stop()  # before the first start: nothing to do
    service.start()
    assert service.running
    with pytest.raises(RuntimeError, match="started already"):
        service.start()
    service.stop()
    service.stop()
    assert not service.running and service.failure() is None


def test_blake_seed(spark):
    r = frame(spark, [("7:1",), (None,)], "k string").select(blake_seed("k").alias("s")).collect()
    assert r[0]["s"] == int.from_bytes(hashlib.blake2b(b"7:1", digest_size=8).digest()) % 2**63 and r[1]["s"] is None
