"""Goldens of scalar functions, statistics, completions, batches, tokens, sources and streams."""

import itertools
import json
import math
import random
import zipfile
from statistics import NormalDist

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import completions as C
from quillon.functions import logits as L
from quillon.functions import stats as S
from quillon.functions import text as T
from quillon.operators import batching, bpe, evaluation, preferences, serving
from quillon.sources import files

#: A record of this repository's own; every list has members, one deal lacks its amount.
GOLD = {"client_name": "Marta Oliveira", "record_date": "2025-11-07", "risk_profile": "growth", "objectives": ["sell the bakery", "visit Oslo"], "recommendations": [{"product": "Granite Bonds", "action": "switch", "amount": 1250.5}, {"product": "Harbour Equity", "action": "hold", "amount": None}], "fees": {"advice_fee": 940.0, "ongoing_fee_pct": 1.2}, "review_months": 9, "flags": ["signature missing"]}
PLAIN = json.dumps({"city": "Oslo", "beds": 3})


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_strict():
    """The kind follows from what the text is: a value that is no object, something with a brace, or neither."""
    for text in ("7.5", "true", '["Oslo"]', ' "beds" ', "[]"):
        assert C.parse_strict(text)[2] == "not_an_object", text
    for text in ("beds: 3", "\t\n", "(see attachment)", "'city'"):
        assert C.parse_strict(text)[2] == "no_json", text
    for text in (PLAIN + ",", "x" + PLAIN, PLAIN.replace(":", "="), PLAIN[1:] + "{", PLAIN + PLAIN):
        assert C.parse_strict(text)[2] == "unparseable", text
    assert C.parse_strict(f"\n {PLAIN}\t")[0] == {"city": "Oslo", "beds": 3}


#: Every way of wrapping or damaging an object that has a name, to be combined; the object stays the same.
WRAPS = {
    "code_fence": lambda t: f"```\n{t}\n```",
    "leading_prose": lambda t: f"My reading of it: {t}",
    "trailing_prose": lambda t: f"{t} (as of today)",
    "duplicate_object": lambda t: f"{t} {t}",
    "unbalanced_braces": lambda t: f"{t} ]}}",
}
DAMAGES = {
    "closed_unterminated": lambda t: t.rstrip("}"),
    "python_literals": lambda t: t.replace("null", "None").replace("true", "True"),
    "trailing_comma": lambda t: t.replace("]", " , ]"),
    "single_quotes": lambda t: t.replace('"', "'"),
}
HELD = {"city": "Oslo", "open": True, "phone": None, "rooms": [1, 2]}


@pytest.mark.parametrize("wrap", [None, *WRAPS])
@pytest.mark.parametrize("damages", [c for n in range(3) for c in itertools.combinations(DAMAGES, n)])
def test_lenient_combinations(wrap, damages):
    text = json.dumps(HELD)
    for name in damages:
        text = DAMAGES[name](text)
    if wrap and not (wrap in ("trailing_prose", "duplicate_object", "unbalanced_braces") and "closed_unterminated" in damages):
        text = WRAPS[wrap](text)
        want = [wrap]
    else:
        want = []
    if want == ["code_fence"] and "closed_unterminated" in damages:
        text = text.replace("\n```", "")  # the fence lacks its end, too
    value, found, failed = C.parse_lenient(text)
    # edits are tried in the order of REPAIRS; earlier kinds that the text does not hold are not named
    assert (value, found, failed) == (HELD, want + [d for d in C.REPAIRS if d in damages], None), text


def test_lenient_reads_strings_as_strings():
    value = {"note": "a } brace, {'inner': None,} and \"quotes\" ```", "n": 1}
    assert C.parse_lenient("so: " + json.dumps(value)) == (value, ["leading_prose"], None)
    assert C.parse_lenient("{'it\\'s': 'say \"hi\"', 'b': None}")[0] == {"it's": 'say "hi"', "b": None}
    assert C.parse_lenient("nothing here")[2] == "no_json" and C.parse_lenient("{beds 3}")[2] == "unparseable"


def test_record_paths_and_reward():
    # six single values, two members, one flag, two deals of two and three values: counted by hand
    assert len(C.flatten(GOLD)) == 4 + 2 + 2 + 1 + 3 + 2
    assert C.check(GOLD) == []
    assert C.score(json.dumps(GOLD), GOLD, True)["value"] == 1.0
    turned = GOLD | {"recommendations": GOLD["recommendations"][::-1], "objectives": GOLD["objectives"][::-1]}
    assert C.score(json.dumps(turned), GOLD, True)["exact_match"]
    late = GOLD | {"review_months": 9.5, "risk_profile": "daring", "mood": "calm", "record_date": "2025-11-31"}
    assert C.check(late) == [("extra_field", "mood"), ("wrong_type", "review_months"), ("bad_enum", "risk_profile"), ("bad_date", "record_date")]
    assert C.score("unreadable", GOLD, False)["value"] == 0.0
    assert C.check(GOLD | {"fees": {"advice_fee": -1, "ongoing_fee_pct": float("inf")}})[0][0] == "out_of_range"
    without = {k: v for k, v in GOLD.items() if k != "fees"}
    assert C.check(without) == [("missing_field", "fees")]


@given(st.dictionaries(st.sampled_from(C.FIELDS), st.one_of(st.none(), st.integers(), st.text(), st.lists(st.text()))))
@settings(max_examples=60, deadline=None)
def test_scores_stay_in_range(record):
    result = C.score(json.dumps(record), GOLD, True)
    assert 0 <= result["field_f1"] <= 1 and 0 <= result["value"] <= 1


@given(st.integers(0, 40), st.integers(0, 40))
@settings(max_examples=40, deadline=None)
def test_mcnemar_against_enumeration(lost, gained):
    """Two-sided: twice the share of outcomes of n fair coins with at most as many heads as the smaller count."""
    n, low = lost + gained, min(lost, gained)
    want = min(1.0, 2 * sum(math.comb(n, i) for i in range(low + 1)) / 2**n) if n else 1.0
    assert S.mcnemar_exact_p(lost, gained) == pytest.approx(want)


def test_mcnemar_of_many_pairs(spark):
    rows = spark.createDataFrame([(600, 600), (0, 2000), (700, 800), (3, 4), (30, 10), (None, 2)], "lost long, gained long")
    exact = [r["p"] for r in rows.select(S.mcnemar_exact(F.col("lost"), F.col("gained")).alias("p")).collect()]
    assert exact[0] == pytest.approx(1.0) and exact[1] == pytest.approx(0.0, abs=1e-300)
    assert exact[2] == pytest.approx(2 * sum(math.comb(1500, i) for i in range(701)) / 2**1500)
    rule = [r["p"] for r in rows.select(S.mcnemar_rule(F.col("lost"), F.col("gained")).alias("p")).collect()]
    assert rule[3] == exact[3] and rule[5] == exact[5] == 0.5  # few pairs: the exact test
    assert rule[4] == pytest.approx(2 * (1 - NormalDist().cdf(19 / math.sqrt(40))))  # (|30 - 10| - 1)^2 / 40


def test_intervals(spark):
    z = S.z_for(0.9)
    assert NormalDist().cdf(z) == pytest.approx(0.95)
    for k, n in [(0, 7), (7, 7), (3, 11), (50, 60)]:
        low, high = (one(spark, c) for c in S.wilson(F.lit(float(k)), F.lit(float(n)), z))
        assert 0 <= low <= k / n <= high <= 1
        for end in (low, high):  # the ends are where the point lies z standard errors off
            if 0 < end < 1:
                assert abs(k / n - end) == pytest.approx(z * math.sqrt(end * (1 - end) / n), rel=1e-6)
    found = spark.createDataFrame([(x,) for x in (-1.5, 0.0, 2.25)], "x double").select("x", S.normal_cdf("x").alias("p")).withColumn("y", S.normal_inverse("p")).collect()
    assert all(r["p"] == pytest.approx(NormalDist().cdf(r["x"])) and r["y"] == pytest.approx(r["x"]) for r in found)


def test_logits(spark):
    rng = random.Random(4)
    row = [rng.uniform(-3, 3) for _ in range(9)]
    kept = lambda c: {i for i, x in enumerate(one(spark, c)) if x > float("-inf")}
    for k in (1, 3, 9, 20):
        assert kept(L.top_k(F.lit(row), k)) == set(sorted(range(9), key=lambda i: -row[i])[:k])
    for mass in (0.05, 0.4, 0.8, 0.999):
        p, total, want = [math.exp(x) for x in row], 0.0, set()
        for i in sorted(range(9), key=lambda i: -row[i]):
            if total < mass:
                want.add(i)
            total += p[i] / sum(p)
        assert kept(L.top_p(F.lit(row), mass)) == want
    seen = one(spark, L.repetition_penalty(F.lit([1.5, -0.5, 3.0]), F.lit([1, 2]), 1.25))
    assert seen == pytest.approx([1.5, -0.5 * 1.25, 3.0 / 1.25])
    for x in (-150.0, -0.3, 2.0):
        assert one(spark, L.log_sigmoid(F.lit(x))) == pytest.approx(x - math.log1p(math.exp(x)))
    assert one(spark, L.sample(F.lit(row), F.lit(0.0), 0)) == max(range(9), key=row.__getitem__)


def test_text(spark):
    assert [str(one(spark, T.iso_day(F.lit(x)))) for x in ("2026-03-31", "20260331", "2026-W14-2", "2026-3-31", "31/03/2026", "2026-02-30")] == ["2026-03-31"] * 4 + ["None"] * 2
    assert one(spark, T.normalise_text(F.lit("  Ａda  STRASSE ß "))) == "ada strasse ss"
    assert one(spark, T.hundredths(F.lit("0.145"))) == 15
    assert [one(spark, T.spell_number(F.lit(n))) for n in (0, 21, 105, 1003, 250_000, 1_000_000)] == ["zero", "twenty-one", "one hundred and five", "one thousand and three", "two hundred and fifty thousand", None]
    assert [one(spark, T.ordinal(F.lit(n))) for n in (1, 2, 3, 4, 11, 12, 13, 21)] == ["1st", "2nd", "3rd", "4th", "11th", "12th", "13th", "21st"]
    assert one(spark, T.list_items(F.lit("- a\n\n2) b\n* c"))) == ["a", "b", "c"]
    assert one(spark, T.word_count(F.lit("  "))) == 0


def test_batches(spark):
    assert one(spark, batching.until_stop(F.lit([5, 6, 7, 8]), F.lit([7, 9]))) == [5, 6]
    assert one(spark, batching.answer_length(F.lit([5, 2, 0]), 2, 0)) == 2
    assert one(spark, batching.answer_length(F.lit([5, 6, 0]), 2, 0)) == 2
    assert one(spark, batching.common_prefix(F.lit([1, 2, 3]), F.lit([1, 2]))) == 2
    with pytest.raises(Exception, match="unknown chat role"):
        batching.chatml(spark.createDataFrame([(1, 1, "robot", "x")], "c int, t int, r string, x string"), "c", "t", "r", "x").collect()


def test_calibration_and_classes(spark):
    rng = random.Random(6)
    made = [(rng.uniform(0.3, 1.0), rng.random() < 0.6) for _ in range(200)]
    bins = {}
    for c, ok in made:
        bins.setdefault(min(math.ceil(c * 12) - 1, 11), []).append((c, ok))
    want = sum(abs(sum(c for c, _ in own) - sum(ok for _, ok in own)) for own in bins.values()) / len(made)
    rows = spark.createDataFrame(made, "c double, ok boolean")
    assert evaluation.calibration_error(rows, "c", "ok", 12).first()["ece"] == pytest.approx(want)
    labels = [(rng.randrange(4), rng.randrange(4)) for _ in range(150)]
    matrix = evaluation.confusion(spark.createDataFrame(labels, "y int, p int"), "y", "p", [0, 1, 2, 3])
    f1 = lambda k: 2 * sum(y == p == k for y, p in labels) / sum((y == k) + (p == k) for y, p in labels)
    found = {r["class"]: r["f1"] for r in evaluation.class_metrics(matrix).collect()}
    assert found == pytest.approx({k: f1(k) for k in range(4)})


def test_mining(spark):
    samples = spark.createDataFrame([("p", i, f"t{i}", r) for i, r in enumerate([0.9, 0.1, 0.5, 0.5, 0.4])] + [("q", 0, "x", 1.0), ("q", 1, "y", 1.0), ("s", 0, "x", 0.2)], "example_id string, sample_index int, text string, reward double")
    pairs = preferences.mine_pairs(samples)
    assert [(r["chosen"], r["rejected"]) for r in pairs.orderBy("pair").collect()][0] == ("t0", "t1")
    assert {r["example_id"]: r["outcome"] for r in preferences.outcomes(samples, pairs).collect()} == {"p": "paired", "q": "saturated", "s": "single_sample"}


def test_bpe(spark):
    assert bpe.merge([1, 2, 3, 1, 2], (1, 2), 9) == [9, 3, 9] and bpe.merge([1, 1, 1], (1, 1), 9) == [9, 1]
    model = bpe.train(spark.createDataFrame([("ab",)], "text string"), "text", 400)
    assert model.merges == [(97, 98)] and model.vocab_size == 258
    for text in ("", "hello  world\n", "naïve 日本 <|endoftext|> x", "\t a"):
        assert model.decode(model.encode(text)) == text
    assert bpe.Bpe.from_json(model.to_json()).merges == model.merges


def test_microbatch_policy():
    assert serving.close_batches([0.0, 0.1, 0.2, 5.0, 5.1], 1.0, 2) == [0, 0, 1, 2, 2]


def test_sources(spark, tmp_path):
    path = tmp_path / "phrases.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("x/Sentences_AllAgree.txt", "Profit rose @ home@Positive\n\nLoss@negative\n".encode("iso-8859-1"))
        z.writestr("__MACOSX/Sentences_AllAgree.txt", "junk")
    rows = files.read_phrase_zip(spark, str(path)).collect()
    assert [(r["line"], r["text"], r["label"]) for r in rows] == [(1, "Profit rose @ home", 2), (3, "Loss", 0)]
    (tmp_path / "bad.jsonl").write_text('{"step": 1, "loss": 2.0}\nnope\n')
    with pytest.raises(Exception, match="(?i)malformed|bad line"):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), files.LOG).collect()
    (tmp_path / "c.jsonl").write_text('{"completion": "hi", "gold": {"a": 1}}\n{"example_id": "e", "text": "yo", "gold": {"a": 2}}\n')
    assert [(r["example_id"], r["text"], r["gold"]) for r in files.read_completions(spark, str(tmp_path / "c.jsonl")).collect()] == [("line-1", "hi", '{"a":1}'), ("e", "yo", '{"a":2}')]
    assert spark.createDataFrame([], files.EXAMPLE).columns == ["example_id", "split", "slice", "note", "gold"]


def test_streaming_batches(spark, tmp_path):
    from quillon.streaming.requests import batch_requests

    rows = spark.createDataFrame([("a", i, f"2024-01-01 00:00:{i:02d}") for i in range(5)], "shard string, request_id long, t string")
    rows.select("shard", "request_id", F.to_timestamp("t").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("shard string, request_id long, ts timestamp").parquet(str(tmp_path / "in")).withWatermark("ts", "1 second")
    q = batch_requests(stream, 2, 10.0).writeStream.format("memory").queryName("batched").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.processAllAvailable()
    q.stop()
    got = {r["request_id"]: r["batch"] for r in spark.table("batched").collect()}
    assert got[0] == got[1] == 0 and got[2] == got[3] == 1


def test_streaming_admission(spark, tmp_path):
    from quillon.streaming.requests import batch_requests

    # two may wait; a batch closes after 10 seconds, and room is made again
    rows = spark.createDataFrame([("a", i, f"2024-01-01 00:00:{s:02d}") for i, s in enumerate([0, 1, 2, 3, 20, 21, 22, 50])], "shard string, request_id long, t string")
    rows.select("shard", "request_id", F.to_timestamp("t").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("shard string, request_id long, ts timestamp").parquet(str(tmp_path / "in")).withWatermark("ts", "1 second")
    q = batch_requests(stream, 4, 10.0, queue=2).writeStream.format("memory").queryName("admitted").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.processAllAvailable()
    q.stop()
    got = {r["request_id"]: (r["batch"], r["status"]) for r in spark.table("admitted").collect()}
    assert [got[i] for i in range(7)] == [(0, "batched"), (0, "batched"), (-1, "overloaded"), (-1, "overloaded"), (1, "batched"), (1, "batched"), (-1, "overloaded")]


def test_runner(spark, tmp_path):
    from quillon.plans.runner import MissingUpstream, run

    calls = []
    stages = {"a": ([], lambda s, d, c: calls.append("a") or s.range(c["n"])), "b": (["a"], lambda s, d, c: calls.append("b") or d["a"].where("id > 0"))}
    config = {"run_dir": f"file://{tmp_path}/run", "n": 3}
    with pytest.raises(MissingUpstream):
        run(spark, stages, config, only=["b"])
    assert [(r.stage, r.ran, r.rows) for r in run(spark, stages, config)] == [("a", True, 3), ("b", True, 2)]
    assert [r.ran for r in run(spark, stages, config | {"run_dir": config["run_dir"]})] == [False, False]
    assert [r.rows for r in run(spark, stages, config | {"n": 4})] == [4, 3]
    assert calls == ["a", "b", "a", "b"]


def test_generator_is_reproducible(spark):
    from quillon.operators.generator import generate

    a = generate(spark, {"train": 30, "test": 6}).collect()
    assert sorted(a) == sorted(generate(spark, {"train": 30, "test": 6}).repartition(3).collect())
    assert len({r["note"] for r in a}) == 36 and {r["example_id"] for r in generate(spark, {"train": 30}, seed=2).collect()} < {r["example_id"] for r in a}
