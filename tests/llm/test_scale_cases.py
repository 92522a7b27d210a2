"""Cases that only large inputs hold: rescans under another parallelism, hot patterns, rare languages, archives of large pages."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillon.llm import langid, pii, toxicity, warc


def brute_scores(rows, least_seeds, worth, rounds, confidence):
    """(kind, c) of every candidate by the definition, one dictionary at a time."""
    edges = {(k, i, p) for k, i, ps in rows for p in ps}
    seeds = {i for k, i, _ in edges if k}
    size = {}
    for _, i, p in edges:
        size.setdefault(p, set()).add(i)
    unknown = {(i, p) for k, i, p in edges if k is None and i not in seeds}
    found = {}
    for _ in range(rounds):
        known = [(k, p, 1.0) for k, i, p in edges if k] + [(found[i][0], p, found[i][1]) for i, p in unknown if i in found]
        good = {}
        for k, p in {(k, p) for k, p, _ in known}:
            own = [c for kk, pp, c in known if (kk, pp) == (k, p)]
            w = min(sum(c if c >= confidence else c * pii.DAMPING for c in own) / len(size[p]), 0.999)
            if sum(c >= confidence for c in own) >= least_seeds and w >= worth:
                good[k, p] = w
        found = {}
        for i in {i for i, _ in unknown}:
            scores = {k: 1 - math.prod(1 - good[k, p] for j, p in unknown if j == i and (k, p) in good) for k in pii.KINDS}
            scores = {k: c for k, c in scores.items() if any((k, p) in good for j, p in unknown if j == i)}
            if scores:
                k = max(scores, key=lambda k: (scores[k], -ord(k[0])))
                found[i] = k, scores[k]
    return {i: (k, round(c, 9)) for i, (k, c) in found.items() if c >= confidence}


@pytest.mark.parametrize("part", [3, 100_000])
def test_discovery_scores(spark, monkeypatch, part):
    monkeypatch.setattr(pii, "PART_EDGES", part)
    rng = random.Random(9)
    patterns = [f"<p{i}" for i in range(12)] + ["<the"]
    rows = []
    for n in range(160):
        kind = rng.choice(["email", "phone", "card", None, None])
        lean = {"email": 0, "phone": 4, "card": 8}.get(kind or rng.choice(["email", "phone", "card"]), 0)
        rows.append((kind, f"i{n % 90 if kind is None else n + 100}", sorted({patterns[lean + rng.randrange(4)], rng.choice(patterns), *(["<the"] if rng.random() < 0.7 else [])})))
    table = spark.createDataFrame(rows, "kind string, instance string, patterns array<string>").repartition(4)
    found = pii.discover(table, least_seeds=2, worth=0.3, rounds=4, confidence=0.5)
    want = brute_scores(rows, 2, 0.3, 4, 0.5)
    assert len(want) > 5 and {r["instance"]: (r["kind"], round(r["c"], 9)) for r in found.collect()} == want


def test_spans_do_not_depend_on_how_tables_are_split(spark, monkeypatch):
    """The table of spans is read twice, each time in another number of splits: spans stay with their documents."""
    texts = [f"please call my {'badge' if i < 20 else 'word'} {10_000 + i} now or +1 555 0100 {i:03d}" for i in range(300)] + [f"please call my badge +1 555 0{i:03d} 77 now" for i in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    plain = {r["doc_id"]: r["spans"] for r in pii.find_pii(rows).collect()}
    splits = iter([1, 7, 3, 5, 2, 9, 4, 8] * 50)
    real = pii.table

    def rescanned(df, name):
        found = real(df, name)
        return found.repartition(next(splits)) if name == "pii-spans" else found

    monkeypatch.setattr(pii, "table", rescanned)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("2000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert {r["doc_id"]: r["spans"] for r in pii.find_pii(rows).collect()} == plain
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    badge = texts[0].index("10000")
    assert any(f":{badge}:{badge + 5}" in s for s in plain.values())  # a discovered one


POLISH = ["Wczoraj wieczorem poszliśmy nad rzekę i rozmawialiśmy o przyszłości.", "Dzieci bawiły się przed domem, a babcia gotowała zupę z grzybami.", "Jutro rano przyjedzie pociąg, którym wracamy do rodzinnego miasta.", "Nad rzeką dzieci rozmawiały wieczorem z babcią o pociągu do miasta."]


def test_a_language_of_three_rows_is_learned(spark):
    rng = random.Random(10)
    words = "the of and to in that was with have from this they which one would there been their more people time water house after other night".split()
    english = [(i, " ".join(rng.choice(words) for _ in range(40)), "en") for i in range(4000)]
    rows = spark.createDataFrame([*english, *((5000 + i, t, "pl") for i, t in enumerate(POLISH[:3])), (6000, POLISH[3], None), (6001, "they have been there with other people", None), (6002, POLISH[0], "xx"), (6003, POLISH[0], "xx")], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify_languages(rows, F.lit(False)).collect()}
    assert [found[5000 + i] for i in range(3)] == ["pl"] * 3 and found[6000] == "pl" and found[6001] == "en"
    assert sum(found[i] == "en" for i in range(4000)) == 4000 and "xx" not in found.values()  # two rows are too few


def test_archives_are_cut_by_bytes(spark, tmp_path):
    rng = random.Random(11)
    page = lambda n: "".join(rng.choice("abcdefghij<>/ ") for _ in range(n))
    large = [(i, f"http://a/{i}", page(40_000)) for i in range(40)]
    small = [(100 + i, f"http://b/{i}", page(20)) for i in range(2000)]
    rows = spark.createDataFrame(large, "page_id long, url string, html string").coalesce(1).union(spark.createDataFrame(small, "page_id long, url string, html string").coalesce(1))
    path = f"file://{tmp_path}/w"
    warc.write_archives(rows, path, archive_bytes=200_000)
    sizes = []
    for p in (tmp_path / "w").rglob("*.gz"):
        sizes.append(sum(len(x) for x in warc.inflate(p.read_bytes())))
    assert max(sizes) <= 260_000 and sum(sizes) > 40 * 40_000 and len(sizes) >= 9
    found = {r["page_id"]: r["payload_bytes"] for r in warc.read_archives(spark, path).collect()}
    assert found == {i: len(h) for i, _, h in large + small}


def test_no_class_from_function_words():
    """An article that stands wherever the language does says nothing by standing before an insult."""
    assert toxicity.contexts("nothing here", toxicity.Model({"oaf": 5.0}, {}, None, 0.1)) == set()
    told = toxicity.contexts("The old oaf left. The house fell; you are said to be an oaf", toxicity.Model({"oaf": 5.0}, {}, None, 0.1))
    assert ("near", "the") in told and ("else", "the") in told and ("far", "said") in told and ("near", "an") in told and ("else", "left") in told

