"""Queries over whole inputs: what an earlier cut left out is in the result."""

import hashlib
import itertools
import json
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon import catalogue, plans  # noqa: F401
from quillon.functions import completions as C
from quillon.functions import stats as S
from quillon.functions.text import field_stem
from quillon.operators import bpe, paired
from quillon.operators.corpus import PRETOKENS


def test_normalised_text_whole(spark, tmp_path):
    texts = [(1, "de", "Straße  ﬁn " + "Wort " * 100 + "ENDE"), (2, "en", "A\tB\n" * 90 + "İß"), (3, None, "Ⅷ ΣΑΣ"), (4, "fr", ""), (5, "es", None)]
    spark.createDataFrame(texts, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["folded"] for r in catalogue.QUERIES["normalised_text"](spark, str(tmp_path)).collect()}
    assert found == {i: None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()).casefold() for i, _, t in texts}
    assert found[1].endswith("wort ende") and found[1].startswith("strasse fin wort") and found[3] == "viii σασ"


def test_chat_queries_take_whole_messages(spark, tmp_path):
    def idx(word):
        return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % 1000

    words = [w for w in (f"w{i}" for i in range(5000)) if idx(w) % 20 != 3 and idx(w) % 30 not in (0, 2)]
    stop, end = next(f"s{i}" for i in range(5000) if idx(f"s{i}") % 20 == 3), next(f"e{i}" for i in range(5000) if idx(f"e{i}") % 30 == 2 and idx(f"e{i}") % 20 != 3)
    first = [*words[:45], stop, *words[45:60]]
    second = [*words[:45], end, *words[60:70]]
    texts = {1: first, 2: second, 3: [words[0]], 4: [], 5: None}
    rows = [(4, t, "user", None if w is None else " ".join(w)) for t, w in texts.items()]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")

    def by_turn(name, column):
        return {r["turn"]: r[column] for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()}

    ids = {t: [idx(x) for x in w or []] for t, w in texts.items()}
    assert by_turn("prefix_length", "shared") == {1: 45, 2: 1, 3: 0, 4: 0}
    assert by_turn("trim_at_stop", "kept") == ids | {1: ids[1][:45]}
    assert by_turn("completion_length", "answer_len") == {1: 61, 2: 46, 3: 1, 4: 0, 5: 0}
    padded = by_turn("pad_and_mask", "padded")
    width = {t: len(p) for t, p in padded.items()}
    assert width == {1: 64, 2: 56, 3: 56, 4: 56, 5: 56}  # sorted by length, batches of four: turns 4, 5, 3, 2 and 1
    assert padded == {t: x + [0] * (width[t] - len(x)) for t, x in ids.items()}
    labels = by_turn("label_mask", "labels")
    prompt = {t: len(ids[t]) * ((t + 4) % 4) // 4 for t in ids}
    assert labels == {t: [-100] * prompt[t] + x[prompt[t] :] + [-100] * (width[t] - len(x)) for t, x in ids.items()}
    batches = catalogue.QUERIES["length_sorted_batches"](spark, str(tmp_path)).collect()
    lengths = {t: len(x) for t, x in ids.items()}
    assert {(r["batch"], r["n"], r["longest"], r["padding"]) for r in batches} == {(0, 4, 56, 4 * 56 - sum(lengths[t] for t in (2, 3, 4, 5))), (1, 1, 61, 3)}
    assert [(r["step"], r["batches"], r["n"]) for r in catalogue.QUERIES["accumulation_groups"](spark, str(tmp_path)).collect()] == [(0, 2, 5)]
    status = {r["status"]: (r["n"], r["tokens"]) for r in catalogue.QUERIES["truncate_or_drop"](spark, str(tmp_path)).collect()}
    assert status == {"kept": (3, 1), "truncated": (1, 16), "dropped": (1, 0)}


def test_exact_test_of_many_pairs(spark):
    def exact(lost, gained):
        n, term, tail = lost + gained, 1, 1
        for i in range(1, min(lost, gained) + 1):
            term = term * (n - i + 1) // i
            tail += term
        return min(1.0, 2 * tail / (1 << n))

    counts = [(1000, 1000), (930, 1070), (500, 1000), (0, 600), (50_000, 50_000), (49_700, 50_300), (0, 2000), (0, 0)]
    rows = spark.createDataFrame(counts, "lost long, gained long")
    found = {(r["lost"], r["gained"]): r["p"] for r in rows.select("lost", "gained", S.mcnemar_exact(F.col("lost"), F.col("gained")).alias("p")).collect()}
    assert found == {c: pytest.approx(exact(*c), rel=1e-12) for c in counts}
    assert found[1000, 1000] == 1 and 0 < found[500, 1000] < 1e-30
    beyond = [(50_500, 50_500), (50_300, 50_900), (49_000, 52_000)]
    assert [S.mcnemar_exact_p(*c) for c in beyond] == [pytest.approx(exact(*c), rel=1e-9) for c in beyond]


def test_gate_of_many_pairs_is_not_always_significant(spark):
    summary = spark.createDataFrame([(9000, 0.99, 1.0, 0, 0, 0.001, 2000, 2050)], "n long, json_rate double, schema_rate double, slices_down int, fields_down int, low double, lost long, gained long")
    assert paired.decide(summary, S.Floors()).first()["decision"] == "HOLD"


def _merges(texts, size):
    """As the reference trains: all words, all pairs counted anew for each merge."""
    n = Counter(w for t in texts for w in re.findall(PRETOKENS, t))
    ids, merges = {w: list(w.encode()) for w in n}, []
    while len(merges) < size - 257:
        counts = Counter()
        for w, x in ids.items():
            for p in itertools.pairwise(x):
                counts[p] += n[w]
        if not counts:
            break
        merges.append(min(counts, key=lambda p: (-counts[p], p)))
        ids = {w: bpe.merge(x, merges[-1], 255 + len(merges)) for w, x in ids.items()}
    return merges


def test_bpe_training_counts_words_beyond_those_held(spark):
    drawn = random.Random(5)
    common = "aa ab " * 30
    texts = [common + " ".join("".join(drawn.choice("aabbcé") for _ in range(drawn.randint(1, 9))) for _ in range(60)) for _ in range(6)] + ["aaaaaaa bababa zqzq zqzq", "aaab" * 9]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [bpe.train(rows, "text", 300, most_words=k).merges for k in (1, 5, 60, 200_000)] == [_merges(texts, 300)] * 4
    few = spark.createDataFrame([("ab ab ab cd xcd ycd zcd",)], "text string")  # the commonest word alone would give a, b
    assert bpe.train(few, "text", 258, most_words=1).merges == [(99, 100)] == _merges(["ab ab ab cd xcd ycd zcd"], 258)
    ended = bpe.train(few, "text", 400, most_words=2).merges
    assert ended == _merges(["ab ab ab cd xcd ycd zcd"], 400) and len(ended) < 400 - 257


def test_bpe_query_trains_over_documents(spark, tmp_path):
    spark.createDataFrame([("zq zq zq",)], "text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r["left"], r["right"]) for r in catalogue.QUERIES["bpe_train_merges"](spark, str(tmp_path)).collect()][:1] == [(ord("z"), ord("q"))]


def test_recount_by_arrays():
    """Pair counts of whole batches equal those of every word by itself, runs of one letter included."""
    draws = random.Random(11)
    for _ in range(60):
        words = ["".join(draws.choice("aab cé") for _ in range(draws.randint(0, 12))) for _ in range(draws.randint(0, 20))]
        n = [draws.randint(1, 9) for _ in words]
        merges = []
        for _ in range(draws.randint(0, 10)):
            counts = _plain_pairs(words, n, merges)
            if not counts:
                break
            merges.append(min(counts, key=lambda p: (-counts[p], p)))
        left, right, told = bpe._batch_pairs(words, np.array(n, np.int64), merges)
        assert dict(zip(zip(left.tolist(), right.tolist(), strict=True), told.tolist(), strict=True)) == _plain_pairs(words, n, merges)


def _plain_pairs(words, n, merges):
    counts = Counter()
    for w, k in zip(words, n, strict=True):
        ids = list(w.encode())
        for i, pair in enumerate(merges):
            ids = bpe.merge(ids, pair, 256 + i)
        for p in zip(ids, ids[1:], strict=False):
            counts[p] += k
    return dict(counts)


def _customers(spark, folder, keys):
    spark.createDataFrame([(k, f"Customer#{k}", "BUILDING") for k in keys], "c_custkey long, c_name string, c_mktsegment string").coalesce(1).write.parquet(f"{folder}/customer.parquet")


@pytest.mark.parametrize("name", ["slot_matching", "flatten_paths", "field_scores", "violation_histogram", "member_probe"])
def test_completions_are_judged_once_and_by_all_cores(spark, tmp_path, name):
    """A condition on the result made a second run of the function, in the one task that reads a small file."""
    _customers(spark, tmp_path, range(40))
    plan = catalogue.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("REPARTITION_BY_NUM")


@pytest.mark.parametrize("name", ["flatten_paths", "field_scores", "violation_histogram", "member_probe", "member_classes", "slot_matching"])
def test_rows_of_one_row_group_are_dealt_out_however_many_splits_the_file_has(spark, tmp_path, name):
    """A file cut into more splits than cores was taken as it came, though all its rows came with one of them."""
    _customers(spark, tmp_path, range(400))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        assert spark.read.parquet(f"{tmp_path}/customer.parquet").rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
        rows = catalogue.QUERIES[name](spark, str(tmp_path))
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("REPARTITION_BY_NUM")
        assert rows.count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_only_the_parts_asked_for_are_worked_out(monkeypatch):
    gold = {"client_name": "A", "fees": {"advice_fee": 1}, "recommendations": [{"product": "x", "amount": 2}, 5], "flags": ["b", "a"], "objectives": []}
    texts = ["", None, "none", '{"client_name": "A"}', "```\n{'flags': ['a'], 'recommendations': [None, {'product': 'X'}], }", "[1]"]
    for text, strict in itertools.product(texts, [True, False]):
        whole = C.score(text, gold, strict)
        assert set(whole) == C.PARTS
        for part in C.PARTS:
            assert C.score(text, gold, strict, parts=frozenset([part])) == {part: whole[part]}
    for unwanted in ("check", "_shown"):
        monkeypatch.setattr(C, unwanted, None)
    assert [f["path"] for f in C.score('{"client_name": "A"}', {"client_name": "B"}, True, parts=frozenset(["fields"]))["fields"]] == ["client_name"]


def test_a_completion_is_loaded_once_for_both_parsers(monkeypatch):
    """The lenient parser began with the strict one again."""
    loads, loaded = C._load, []
    monkeypatch.setattr(C, "_load", lambda text: (loaded.append(text), loads(text))[1])
    C._in_slices(C.reading, C._READING, pa.array(['{"mood": 1}', "no record"]))
    assert loaded == ['{"mood": 1}', "no record"]
    for text in (None, "", "[1]", '{"mood": 1}', "so: {'mood': None,", '{"a": }'):
        got, (strict, _, failed), (value, repairs, lost) = C.reading(text), C.parse_strict(text or ""), C.parse_lenient(text or "")
        assert (got["strict"], got["strict_violation"], got["lenient"], got["repairs"], got["lenient_violation"]) == (strict is not None, failed, value is not None, repairs, lost)


@pytest.mark.parametrize("name", ["member_probe", "member_classes"])
def test_member_classes_hold_no_more_than_the_parsed_record(spark, tmp_path, monkeypatch, name):
    _customers(spark, tmp_path, range(40))
    held, verify = [], C.verify
    monkeypatch.setattr(plans.verification, "verify", lambda *a, **b: (held.append(verify(*a, **b)), held[-1])[1])
    catalogue.QUERIES[name](spark, str(tmp_path))
    assert held[0].schema["reward"].dataType.names == ["parsed", "value_json"]


def test_nested_results_as_columns():
    kind = C._RESULT
    rows = [C.score(t, {"client_name": "A", "flags": ["b"]}, False) for t in ("", '{"client_name": "A", "mood": 1, }', "{'flags': ['a'", "no")]
    for some in ([], rows, rows[:1], rows * 3):
        assert C._arrow(some, kind).equals(pa.array(some, kind))


def test_quick_tokens_are_those_of_the_full_lexer():
    drawn = random.Random(3)
    bits = ['"', "'", "{", "}", "[", "]", ",", ":", " ", "\n", "\\", "None", "True", "False", "a", "_", "1", ".5", "null", "-", "\x1c", "\t", "''", "{ ", "['", ", '", '": ', '\\"', "\\'", "```"]
    for _ in range(5000):
        text = "".join(drawn.choices(bits, k=drawn.randint(0, 14)))
        for at in range(len(text) + 1):
            if at and text[at - 1] != "}":
                continue
            quick = [(t.lastgroup, *t.span(t.lastgroup)) for t in C._QUICK_LEXER.finditer(text, at) if t.lastgroup]
            assert quick == [(t.lastgroup, *t.span()) for t in C._LEXER.finditer(text, at) if t.lastgroup != "double"]


def test_a_completion_that_holds_the_gold_text_is_not_read_again(monkeypatch):
    """Gold was loaded, flattened and compared anew for each completion, and its text up to four times."""
    text = '{"client_name": "A", "objectives": ["b", "c"], "recommendations": [{"product": "x", "amount": null}], "fees": {"advice_fee": 1.5}, "flags": []}'
    gold = json.loads(text)
    told = [text, f" {text}\n", f"```json\n{text}\n```", f"Record:\n{text}", f"{text}\nEnd.", f"{text}}}}}", text[:-1], text.replace("[]}", "[],}"), text.replace("null", "None"), text.replace('"', "'"), f"{text}\n{text}"]
    plain = [C.score(t, gold, False) for t in told]
    assert all(s["parsed"] and s["field_f1"] == 1 for s in plain)
    assert {r for s in plain for r in s["repairs"]} == set(C.REPAIRS)
    monkeypatch.setattr(C, "_load", lambda text: (False, None))
    for unwanted in ("align", "_same"):
        monkeypatch.setattr(C, unwanted, None)
    for t, want in zip(told, plain, strict=True):
        got = C._judge(t, gold, False, (0.2, 0.2, 0.6), C.PARTS, (text, gold))
        assert got["fields"] == [(f["path"], f["correct"], f["expected"], f["emitted"]) for f in want["fields"]]
        assert {k: v for k, v in got.items() if k not in ("fields", "violations")} == {k: v for k, v in want.items() if k not in ("fields", "violations")}


def test_paths_of_like_records_are_put_in_order_once():
    C._union.cache_clear()
    rows = [({"client_name": f"a{i}", "mood": i}, {"client_name": "a1", "fees": {"advice_fee": 1}}) for i in range(50)]
    scores = [C.field_scores(*row) for row in rows]
    assert C._union.cache_info().misses == 1
    assert scores == [[("client_name", i == 1, True, True), ("fees.advice_fee", False, True, False), ("mood", False, False, True)] for i in range(50)]


def test_stem_of_a_path(spark):
    paths = ["", "a", "a.b", "a[0].b", "a{x.y[1]}", ".a", "[0]", "{", "a b{", "é[1]", None, "a\n.b"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    stems = rows.select("path", field_stem(F.col("path")).alias("stem"))
    assert {r["path"]: r["stem"] for r in stems.collect()} == {p: None if p is None else re.split(r"[.\[{]", p)[0] for p in paths}
    assert "regexp" not in stems._jdf.queryExecution().executedPlan().toString()


def test_slot_matching_has_a_row_for_each_customer(spark, tmp_path):
    _customers(spark, tmp_path, [1, 1, 2])
    rows = catalogue.QUERIES["slot_matching"](spark, str(tmp_path)).collect()
    assert sorted((r["c_custkey"], r["expected"], r["emitted"], r["correct"]) for r in rows) == [(1, 9, 9, 8), (1, 9, 9, 8), (2, 9, 6, 6)]


def test_results_of_completions_leave_as_columns_slice_by_slice():
    """Python objects are held for one slice of rows at a time."""
    held = []

    def one(text):
        held.append(text)
        return {"strict": True, "strict_violation": text, "lenient": True, "repairs": [], "lenient_violation": None, "violations": []}

    n = 2 * C.SLICE + 1
    out = C._in_slices(one, C._READING, pa.array([str(i) for i in range(n)]))
    assert [r["strict_violation"] for r in out.to_pylist()] == held == [str(i) for i in range(n)]
    assert len(C._in_slices(one, C._READING, pa.array([], pa.string()))) == 0


def test_values_of_one_spelling_are_equal_by_their_keys():
    values = ["a", "", 1, 0, 1.5, 0.0, -0.0, float("nan"), float("inf"), True, False, None, [1], [True], {}]
    for path in [("client_name",), ("review_months",), ("fees", "advice_fee"), ("mood",), ("recommendations", 0, "amount")]:
        for a, b in itertools.product(values, repeat=2):
            assert C._same(path, a, b) == (C.compare_key(path, a) == C.compare_key(path, b))


@pytest.mark.parametrize(("n", "resamples"), [(66_500, 3), (11, 300), (1, 2)])
def test_drawn_indices_meet_their_values(spark, n, resamples):
    """Over several blocks and stretches, over several groups of resamples; values that are null do not count."""
    held = [None if i % 7 == 3 else float(i % 5 - 1) for i in range(n)]
    rows = spark.createDataFrame(list(enumerate(held)), "idx long, v double")
    means = []
    for r in range(resamples):
        got = [held[int(hashlib.md5(f"4:{r}:{i}".encode()).hexdigest()[:8], 16) % n] for i in range(n)]
        means += [np.mean(known)] if (known := [x for x in got if x is not None]) else []
    found = paired.bootstrap_interval(rows, "v", "idx", resamples, 0.9, 4).first()
    assert tuple(found) == pytest.approx((np.mean([x for x in held if x is not None]), *np.quantile(means, [0.05, 0.95])), abs=1e-12)


def test_bootstrap_of_no_rows(spark):
    none = spark.createDataFrame([], "idx long, v double")
    assert tuple(paired.bootstrap_interval(none, "v", "idx", 5, 0.9, 0).first()) == (None, None, None)


@pytest.mark.parametrize("most", [0, 1, 2, 500, 3002, 3003, 4000])
def test_words_held_are_the_commonest_and_no_more(spark, most):
    """Ties are parted by hash, not by a sorted limit, which sends as many words of every partition to the driver."""
    n = {"a": 9, "b": 7, "c": 7} | {f"w{i}": 1 for i in range(3000)}
    counted = spark.createDataFrame(list(n.items()), "word string, n long")
    common = bpe._held(counted, most)
    if most >= len(n):
        assert common is None
        return
    held = {r["word"] for r in counted.where(common).collect()}
    rest = {r["word"] for r in counted.where(~common).collect()}
    assert len(held) <= most and not held & rest and held | rest == set(n)
    assert min((n[w] for w in held), default=9) >= max(n[w] for w in rest) and len(held) >= {0: 0, 1: 1, 2: 1}.get(most, most - 20)


def test_pairs_are_counted_in_stretches(monkeypatch):
    words, n = ["aaaa", "", "abab", "é", "b", "ababab"], np.array([3, 1, 2, 5, 4, 1])
    whole = bpe._Head(pa.array(words), n)
    monkeypatch.setattr(bpe, "STRETCH", 4)
    parts = bpe._Head(pa.chunked_array([pa.array(["x", *words])]).combine_chunks()[1:], n)
    for new in range(256, 260):
        assert parts.counts == whole.counts == _plain_pairs(words, n.tolist(), [] if new == 256 else done)
        done = [*(done if new > 256 else []), whole.best()]
        assert parts.best() == done[-1]
        whole.merged(done[-1], new)
        parts.merged(done[-1], new)
