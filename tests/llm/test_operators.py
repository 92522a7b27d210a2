"""Each operator on small tables: against brute force, and with nulls, empty and long texts, ties, repeats, no rows, extra columns."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import ann, exact_dedup, langid, packing, pii, quality, sampled_pieces, simhash, toxicity, warc
from quillon.llm.common import components
from quillon.llm.queries import PIECE_MODEL, WORD_TOKENIZER, tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, TEXT2 string, n long, kept boolean"
LONG = "alpha beta gamma delta " * 8000
TEXTS = [None, "", " ", "\n\n", "same text", "same text", "same text", LONG, "Ünïcödé ß 日本語 \U0001f600", "a\x00b\x1cc", "one", "one two", "!!! 123 ---", "x" * 5000]


def docs(spark, texts=TEXTS, langs=None):
    """Rows with ids 0, 1, .. and, as further columns, names that operators use inside; the last row repeats the one before."""
    rows = [(i, t, langs[i] if langs else None, "s", None, 1, True) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[-1:] + [(None, "no id", None, None, None, None, None)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


# exact dedup
def test_exact_dedup(spark):
    rows = docs(spark)
    found = exact_dedup.exact_dedup(rows).collect()
    given = [(r["doc_id"], r["text"] or "") for r in rows.collect()]
    groups = {}
    for i, t in given:
        groups.setdefault(t, []).append(i)
    want = sorted((str(i), max((x for x in groups[t] if x is not None), default=None), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in given)
    assert sorted((str(r["doc_id"]), r["keep_id"], r["group_size"], r["text_sha256"]) for r in found) == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in found)
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0
    for past in (F.lit(True), F.lit(False), F.col("doc_id") < 5):
        assert sorted(map(str, exact_dedup.exact_dedup(rows, past).collect())) == sorted(map(str, found))
    assert exact_dedup.keep_winners(rows).where("text = 'same text'").collect()[0]["doc_id"] == 6


def test_perfect_hash():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 500, 3000):
        digests = np.stack([np.frombuffer(hashlib.sha256(bytes(rng.bytes(8))).digest(), np.uint8) for _ in range(n)])
        displace, slots = exact_dedup.build_mph(digests)
        assert sorted(slots) == list(range(n))
        assert (exact_dedup.find_slots(digests, displace) == slots).all()


# SimHash
def _fingerprint(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(codes, ids, radius=3):
    low = list(ids)
    changed = True
    while changed:
        changed = False
        for i, j in itertools.combinations(range(len(codes)), 2):
            if bin(codes[i] ^ codes[j]).count("1") <= radius and low[i] != low[j]:
                low[i] = low[j] = min(low[i], low[j])
                changed = True
    return low


def test_simhash(spark):
    rng = random.Random(1)
    base = [[f"w{rng.randrange(4000)}" for _ in range(400)] for _ in range(6)]
    texts = [t if t != LONG else None for t in TEXTS]
    for words in base:
        for _ in range(5):
            own = list(words)
            own[rng.randrange(400)] = "changed"
            texts.append(" ".join(own))
    found = by_id(simhash.simhash_near_dedup(docs(spark, texts)).where("doc_id IS NOT NULL").collect())
    codes = [_fingerprint(t) for t in texts]
    assert [int(found[i]["fingerprint"], 16) for i in range(len(texts))] == codes
    assert [found[i]["component_id"] for i in range(len(texts))] == _components(codes, range(len(texts)))
    assert simhash.simhash_near_dedup(empty(spark)).count() == 0


def test_gray_tree_finds_every_pair():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 2**63, 300, dtype=np.int64).astype(np.uint64)
    near = np.concatenate([codes ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) for _ in range(3)])
    every = np.unique(np.concatenate([codes, near]))
    want = {(i, j) for i in range(len(every)) for j in np.flatnonzero(np.bitwise_count(every ^ every[i]) <= 3)}
    found = set()
    for copy in (0, 1):
        turned = simhash._rotate(every, copy)
        for q, m in simhash.GrayTree(turned).search(turned, 3):
            found |= set(zip(q.tolist(), m.tolist(), strict=True))
    assert found == want
    assert [int(x) for x in simhash.gray_rank(np.array([0, 1, 3, 2, 6, 7, 5, 4], np.uint64))] == list(range(8))


def test_crowded_blocks(spark, monkeypatch):
    """Blocks that are dealt out again by hash lose no link."""
    monkeypatch.setattr(simhash, "BLOCK_CODES", 4)
    monkeypatch.setattr(simhash, "MIN_BLOCKS", 1)
    codes = [((i & 7) << 3 | (i >> 3)) for i in range(64)]  # all within a few bits of each other
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "rep long, code long")
    found = {r["node"]: r["component"] for r in components(simhash.gray_links(rows, 1)).collect()}
    assert [found[i] for i in range(64)] == _components(codes, range(64), 1)


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (200, 200)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | dict.fromkeys((100, 101, 102), 100)


# languages
WORDS = {"en": "the and of this that with from have which", "fr": "le la les une des que pour dans avec", "ru": "это что как для она они был тебя"}


def _prose(lang, n, rng):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


def test_language(spark):
    rng = random.Random(0)
    langs = [rng.choice(list(WORDS)) for _ in range(120)]
    texts = [_prose(x, 30, rng) for x in langs]
    table = docs(spark, texts + TEXTS, langs + [None] * len(TEXTS))
    found = by_id(langid.identify_languages(table, spans=True).collect())
    assert all(found[i]["lang_pred"] == x for i, x in enumerate(langs))
    for i, t in enumerate(TEXTS, len(texts)):
        assert (found[i]["lang_pred"] == "und") == (not any(map(str.isalpha, t or "")))
        assert found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
    model = langid.fit(table)
    mixed = _prose("en", 20, rng) + ". " + _prose("fr", 20, rng) + " — " + _prose("ru", 20, rng)
    (_, (lang, share, spans)) = langid.label(["x", mixed], model, True)
    assert [s[2] for s in spans] == ["en", "fr", "ru"] and 0 < share < 1
    assert mixed[spans[2][0] : spans[2][1]] in mixed and "это" in WORDS["ru"]
    assert langid.identify_languages(empty(spark)).count() == 0
    assert langid.keep_identified(table).columns == table.columns
    soup = "".join(rng.choice("qxzjkvwpbd") for _ in range(400))
    kept = langid.keep_identified(docs(spark, [*texts, soup, "123", None, "und of the that", "zq"], [*langs, None, None, None, None, None])).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None and r["doc_id"] >= 120) == [123, 124, 124]  # two words are not enough to reject
    assert all(r["lang"] == langs[r["doc_id"]] for r in kept if r["doc_id"] is not None and r["doc_id"] < 120)


def test_letters_of_every_script_count(spark):
    """Letters in U+2000 to U+303F and beyond are letters; quotes and brackets are none and part words."""
    table = docs(spark, ["the and of this that"] * 9, ["en"] * 9)
    model = langid.fit(table)
    for text, known in {"\u2c81\u2c83\u2c85": True, "\u2c30\u2c31": True, "\u210c": True, "\u201cthe\u201d": True, "\u300c\u65e5\u672c\u300d": True, "\u201c\u2014\u201d": False, "\u2460 1": False, "\U0001f600": False}.items():
        assert (langid.label([text], model)[0][0] != "und") == known, text


def test_viterbi_against_all_labellings():
    rng = np.random.default_rng(5)
    scores = rng.normal(size=(6, 3)).astype(np.float32) * 3
    best = max(itertools.product(range(3), repeat=6), key=lambda p: sum(scores[i, k] for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False)))
    assert tuple(langid.viterbi(scores, np.zeros(6, int), 2.0)) == best


# quality
def _labelled(spark, good, bad, text_bad):
    texts = [good(i) if i % 3 else text_bad(i) for i in range(150)]
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0, 0 if i % 3 else 1) for i in range(150)] + [(0, None, None)], "doc_id long, quality int, toxic int")
    return texts, labels


def test_quality(spark):
    rng = random.Random(2)
    good = lambda i: "\n".join(" ".join(rng.choice(WORDS["en"].split()) for _ in range(12)).capitalize() + "." for _ in range(6))
    texts, labels = _labelled(spark, good, None, lambda i: "\n".join("BUY!! NOW!! " * 5 for _ in range(6)))
    found = by_id(quality.classify_quality(docs(spark, texts + TEXTS), labels).collect())
    assert all(found[i]["predicted"] == (1 if i % 3 else 0) for i in range(150))
    assert all(0 <= r["score"] <= 1 and not math.isnan(r["score"]) for r in found.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in found.items() if i is not None)
    none = by_id(quality.classify_quality(docs(spark), labels.where("false")).collect())
    assert {r["score"] for r in none.values()} == {0.5}
    assert quality.classify_quality(empty(spark), labels).count() == 0


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(4)
    unary, moves = rng.normal(size=5), rng.normal(size=(2, 2))
    doc = np.array([0, 0, 0, 1, 1])
    found, pairs, _ = quality.marginals(unary, doc, moves)
    for own in (np.arange(3), np.arange(3, 5)):
        weights = {p: math.exp(sum(unary[own[i]] * x for i, x in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:], strict=False))) for p in itertools.product((0, 1), repeat=len(own))}
        z = sum(weights.values())
        for i, line in enumerate(own):
            assert found[line] == pytest.approx(sum(w for p, w in weights.items() if p[i]) / z)
    assert pairs[2].sum() == 0


def test_lines_of_mixed_documents(spark):
    """Labels are those of documents; the field still learns which lines are bad, and that good and bad lines alternate."""
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice(WORDS["en"].split()) for _ in range(12)).capitalize() + "."
    bad = lambda: "BUY!! NOW!! " * 5
    texts, labels = [], []
    for i in range(200):
        most, few = (good, bad) if i % 2 else (bad, good)
        texts.append("\n".join(few() if j % 5 == 4 else most() for j in range(20)))
        labels.append((i, i % 2))
    table = docs(spark, texts).join(spark.createDataFrame(labels, "doc_id long, label int"), "doc_id")
    model = quality.fit(table)
    _, lines, doc = quality.score(texts, model)
    want = np.array([(j % 5 == 4) != bool(i % 2) for i in range(200) for j in range(20)])
    assert ((lines > 0.5) == want).mean() > 0.95
    assert model.moves[0, 1] + model.moves[1, 0] > -4  # changes within a document are learned


def test_spread_runs():
    assert quality.spread_runs(5, 8, 4).tolist() == [0, 1, 2, 3, 4]
    found = quality.spread_runs(1000, 128, 16)
    assert len(set(found)) == 128 and found[0] == 0 and found[-1] == 999


# toxicity
def test_toxicity(spark):
    rng = random.Random(3)
    good = lambda i: _prose("en", 40, rng) + "."
    texts, labels = _labelled(spark, good, None, lambda i: f"{_prose('en', 20, rng)}. you are a blorgface. {_prose('en', 20, rng)}")
    found = by_id(toxicity.classify_toxicity(docs(spark, texts + TEXTS), labels).collect())
    assert all(found[i]["predicted"] == (0 if i % 3 else 1) for i in range(150))
    assert toxicity.classify_toxicity(empty(spark), labels).count() == 0
    assert toxicity.classify_toxicity(docs(spark), labels.where("false")).count() == len(TEXTS) + 2


def _clause(kinds, weights):
    """The grammar's rules, each told on its own over the whole clause."""
    I, H, T, N, R, Q = toxicity.INSULT, toxicity.THREAT, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT, toxicity.QUOTE
    total = 0.0
    for i, k in enumerate(kinds):
        before = kinds[:i]
        if k == T:  # a threat up to three words ago, not used by a target since
            used = max((j for j in range(i) if kinds[j] == T), default=-1)
            total += 4.0 * any(kinds[j] == H for j in range(max(used + 1, i - 3), i))
        if k == I:
            factor = 0.5 if I in before else 1.0
            factor *= 1.25 if T in before else 1.0
            last = max((j for j in range(i) if kinds[j] == I), default=-1)
            factor *= 0.4 if any(kinds[j] == N for j in range(max(last + 1, i - 3), i)) else 1.0
            state = 0  # in quotation marks, or behind a word of reporting outside them
            for b in before:
                state = {0: {R: 1, Q: 2}, 1: {}, 2: {Q: 0}}[state].get(b, state)
            total += weights[i] * factor * (1.0, 0.6, 0.8)[state]
    return total


def test_composed_grammar_against_all_clauses():
    for n in range(1, 6):
        for kinds in itertools.product(range(7), repeat=n):
            weights = [1.0 + i for i in range(n)]
            assert toxicity.GRAMMAR.score(list(kinds), weights) == pytest.approx(_clause(list(kinds), weights)), kinds


def test_grammar_of_a_model():
    classes = {"you": toxicity.TARGET, "not": toxicity.NEGATION, "said": toxicity.REPORT, "crush": toxicity.THREAT}
    model = toxicity.Model({"idiot": 5.0}, {}, np.zeros(5), 0.1, classes)
    score = lambda t: sum(s for _, s in toxicity.matched_clauses(t, model))
    plain, target, negated, reported = score("an idiot"), score("you idiot"), score("you are not an idiot"), score("he said you are an idiot")
    assert negated < plain < target and reported < target
    assert score("i will crush you") > 0 and score("i will crush time") == 0
    assert toxicity.features(None, model) == toxicity.features("", model) == [0.0] * 4


def test_toxic_classes_are_learned(spark):
    """Made-up words: an insult, a negation and a report that take it back, a target, and a threat that needs the target."""
    rng = random.Random(9)
    fill = lambda n: " ".join(rng.choice("lorem ipsum dolor amet sit elit sed".split()) for _ in range(n))
    bad = [lambda: f"{fill(4)}. zu blorg {fill(2)}", lambda: f"{fill(3)}. {fill(6)} blorg", lambda: f"{fill(3)}. krem zu {fill(2)}"]
    good = [lambda: f"{fill(3)}. nix blorg {fill(2)}", lambda: f"{fill(3)}. sprak {fill(4)} blorg", lambda: f"{fill(4)}. krem {fill(4)}.", lambda: fill(8), lambda: f"{fill(3)}. zu {fill(3)}."]
    made = [(1, rng.choice(bad)()) if i % 2 else (0, rng.choices(good, (1, 1, 4, 11, 3))[0]()) for i in range(3000)]
    rows = docs(spark, [t for _, t in made])
    labels = spark.createDataFrame([(i, y) for i, (y, _) in enumerate(made)], "doc_id long, toxic int")
    model = toxicity.fit(rows.join(labels, "doc_id").select("doc_id", "text", F.col("toxic").alias("label")))
    assert "blorg" in model.words and not {"nix", "sprak", "lorem"} & set(model.words)
    assert model.classes["nix"] == toxicity.NEGATION and model.classes["sprak"] == toxicity.REPORT
    assert model.classes["zu"] == toxicity.TARGET and model.classes["krem"] == toxicity.THREAT
    assert not {"lorem", "ipsum", "dolor", "sit"} & set(model.classes)


# PII
def _base(text):
    def luhn(d):
        return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    rules = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, rule in rules.items():
        for m in re.finditer(rule, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


ODD = ["a@b.c.x_y@d.e", "x..@-.-.- +1 (017) 555-7713.", "1.2.3.4.5.6.7.8 256.1.1.1 0000255.1.1.1 99999999999999999999.1.1.1", "4111-1111 1111 1111x 00000 4111111111111111, 4111111111111112", "\U0001f600é +49 (0) 123 456 789 ü a@b.co", "1.2.3.4@5.6.7.8 +1.2.3.4.5.6.7.8", "0" * 3000, "a.b@c" + ".d" * 2000, "1 " * 900, "@@@ .@. a@b..c a@b.c-"]


def test_pii_base(spark):
    table = docs(spark, TEXTS + ODD)
    found = by_id(pii.find_pii(table).collect())
    for i, t in enumerate(TEXTS + ODD):
        want = _base(t)
        assert found[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert [found[i][f"n_{k}"] for k in pii.KINDS] == [sum(w.startswith(k) for w in want) for k in pii.KINDS]
    assert pii.find_pii(empty(spark)).count() == 0


def test_pii_long_runs(spark):
    """Runs that would make a backtracking matcher quadratic or overflow its stack."""
    table = docs(spark, ["a" * 300_000, "1 " * 150_000, "a.b@c" + ".d" * 100_000, "-" * 200_000])
    assert pii.find_pii(table).count() == 6


def test_pii_discovery(spark):
    seeds = [f"please call +1 (555) 010-{i:04d} today" for i in range(20)]
    texts = [*seeds, "please call 555-010-9999 today", "lot 555-010-8888 sold", "nothing here"]
    found = by_id(pii.find_pii(docs(spark, texts)).collect())
    assert found[20]["spans"] == "phone:12:24" and found[20]["n_phone"] == 0
    assert found[21]["spans"] == ""
    masked = by_id(pii.mask_pii(docs(spark, texts + [None]), length_col="n").collect())
    assert masked[0]["text"] == "please call [PHONE] today" and masked[20]["text"] == "please call [PHONE] today"
    assert masked[21]["text"] == texts[21] and masked[23]["text"] is None and masked[0]["n"] == 25


# neighbours
def test_neighbours(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1500, 16))
    x[100:400] = 4 * x[100]  # a large class of equal vectors
    bad = [(9001, None), (9002, [0.0] * 16), (9003, [None] + [1.0] * 15), (9004, [float("nan")] * 16), (None, [1.0] * 16), (9005, [1.0])]
    table = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)] + [(i, v, "y") for i, v in bad], "vec_id long, embedding array<double>, score string")
    rows = ann.nearest_neighbours(table, 20).collect()
    found = {}
    for r in rows:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == set(range(0, 1500, 20))
    hits = 0
    for q, own in found.items():
        own.sort()
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(1500), -np.round(s, 9)))[:20]
        assert [r for r, _, _ in own] == list(range(1, 21)) and q not in [v for _, v, _ in own]
        assert all(score == pytest.approx(s[v]) for _, v, score in own)
        hits += len(set(want) & {v for _, v, _ in own})
    assert hits / (20 * len(found)) >= 0.9
    assert [v for _, v, _ in found[100]] == list(range(101, 121))  # ties to smaller ids
    assert ann.nearest_neighbours(table.where("false"), 20).count() == 0
    assert ann.nearest_neighbours(table.where("vec_id IN (0, 3, 5)"), 20).count() == 2


def test_probing_reaches_every_code_within_the_radius():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 24))
    model = ann.learn(x, 10, 700, 20)
    codes = model.codes(x)
    for reach in (0, 1, 2, model.width):
        own = ann.replace(model, reach=reach, lead=2)
        hit = np.zeros((20, 700), bool)
        for j in range(own.substrings):
            for lead in range(4):
                members = np.flatnonzero(codes[:, j] >> (own.width - 2) == lead)
                for q, m in ann._pairs(own, lead, codes[members, j], codes[:20, j]):
                    hit[q, members[m]] = True
        apart = np.bitwise_count(codes[:20, None, :] ^ codes[None])
        assert (hit == (apart <= reach).any(axis=2)).all()  # what probing a ball of each substring should bring up
        assert hit[apart.sum(axis=2) <= own.radius].all()  # the pigeonhole principle


# packing
def test_packing(spark):
    from tokenizers import Tokenizer

    texts = [*TEXTS, "İstanbul ΣΑΣ don't it's <|endoftext|> é ½ µm ªº 12345 a1b2 __x__", "A'S 'LL we'll naïve!!! CAFÉ"]
    rows = packing.pack(docs(spark, texts), tokenizer_file(WORD_TOKENIZER), 64, partitions=3).collect()
    tok = Tokenizer.from_file(tokenizer_file(WORD_TOKENIZER))
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    ids[None] = tok.encode("no id", add_special_tokens=False).ids + [2]
    seen, places = {}, {}
    for r in rows:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"] and len(own) == r["length"] > 0
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + r["length"]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    last = len(texts) - 1
    assert seen == {i: len(x) * (2 if i == last else 1) for i, x in ids.items()}
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]]
        total = sum(n for _, n in own)
        assert total <= 64 and total & (total - 1) == 0  # full, or a power of two: no padding
    assert packing.pack(empty(spark), tokenizer_file(WORD_TOKENIZER)).count() == 0


@pytest.mark.parametrize(("bits", "dims"), [(3, 2), (2, 3), (4, 2)])
def test_hilbert_steps_are_neighbours(bits, dims):
    grid = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    key = packing.hilbert_key(grid, bits)
    assert sorted(key) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


# sampled pieces
def test_sampled_pieces(spark):
    model = tokenizer_file(PIECE_MODEL)
    table = docs(spark, [*TEXTS, "▁ literal ▁▁mark", "  two  spaces ", "tab\tnew\n"])
    coded = sampled_pieces.encode_sampled(table, model)
    back = [(r["doc_id"], r["text"]) for r in sampled_pieces.decode_ids(coded, model).collect()]
    assert sorted(map(str, back)) == sorted(str((r["doc_id"], r["text"] or "")) for r in table.collect())
    again = sampled_pieces.encode_sampled(table.repartition(7), model).collect()
    assert sorted(map(str, again)) == sorted(map(str, coded.collect()))
    other = by_id(sampled_pieces.encode_sampled(table, model, seed=1).collect())
    assert other[7]["ids"] != by_id(again)[7]["ids"]
    digest = sampled_pieces.segmentation_digest(table, model).collect()
    assert all(r["lossless"] for r in digest)
    assert sampled_pieces.encode_sampled(empty(spark), model).count() == 0


def test_sampling_follows_the_lattice():
    v = sampled_pieces.pieces(tokenizer_file(PIECE_MODEL))
    weight = {v.bytes_of[i].decode(): v.log_weight[i] for i in range(len(v.bytes_of)) if np.isfinite(v.log_weight[i])}
    word, ways = " then", {}

    def walk(at, path, w):
        if at == len(word):
            ways[path] = math.exp(w)
        for end in range(at + 1, len(word) + 1):
            if word[at:end] in weight:
                walk(end, (*path, word[at:end]), w + weight[word[at:end]])

    walk(0, (), 0.0)
    n, total = 20_000, sum(ways.values())
    found = {}
    for ids in sampled_pieces.sample_ids([word] * n, np.arange(n), v):
        path = tuple(v.bytes_of[i].decode() for i in ids)
        found[path] = found.get(path, 0) + 1
    assert all(abs(found.get(p, 0) / n - w / total) < 0.02 for p, w in ways.items())


# WARC
def test_warc(spark):
    big, bigger = "<p>é" + "x" * 1200, "<b>\r\n\r\nWARC/1.1\r\n" + "y" * 3000
    rows = [(1, "http://a.example/x?q=1#f", big), (5, "https://www.a.example:443/x", big), (3, None, big), (2, "http://b.example/\r\nEvil: 1", bigger), (4, "", None), (6, "http://b.example", ""), (7, "http://c", "small"), (8, "http://c", "small"), (None, "http://d", "q" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    found = by_id([r.asDict() | {"doc_id": r["page_id"]} for r in warc.warc_roundtrip(pages, archive_records=2).collect()])
    assert len(found) == len(rows)
    for page, _, html in rows:
        raw = (html or "").encode()
        r = found[page]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", 5) if page in (1, 3) else ("response", None))
    order = sorted(found.values(), key=lambda r: r["position"])
    keys = [(r["url_key"], r["ts"]) for r in order]
    assert keys == sorted(keys)
    assert warc.warc_roundtrip(pages.where("false")).count() == 0


@pytest.mark.parametrize("k", range(1, 20))
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted((rng.randrange(9),) for _ in range(rng.randrange(7))) for _ in range(k)]
    assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_index_prunes(spark, spread):
    """How often vectors come up, against a scan of them all: a small part for clustered ones, less than a scan for random ones; recall by brute force."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(150, 32))
    x = centres[rng.integers(0, 150, 3000)] * (spread < 1) + spread * rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist())], "vec_id long, embedding array<double>")
    counts = [r["candidates"] for r in ann.candidate_counts(table, 10, group=1024).collect()]
    assert np.mean(counts) < (0.35 if spread < 1 else 1.0) * len(x)
    found = {}
    for r in ann.nearest_neighbours(table, 10, group=1024).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    scores = x @ x[::20].T
    scores[np.arange(0, 3000, 20), np.arange(150)] = -np.inf
    best = np.argsort(-scores, axis=0)[:10].T
    assert np.mean([len(found[20 * i] & set(own.tolist())) / 10 for i, own in enumerate(best)]) >= 0.9
    assert all(len(own) == 10 for own in found.values())


# edges that every operator and stage shares
CLASHING = "doc_id long, text string, TEXT string, lang string, Lang string, source string, n_chars int, id long, digest string, c0 long, masked string, key string"
VERY_LONG = "mail one two three four joe@example.org alpha beta gamma or +1 (555) 010-1234 now. " * 10_000


def edge_rows(spark, texts=("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "lorem ipsum dolor sit amet elit sed")):
    """Two rows of one text and an id of two texts, a repeated row, rows without id; columns that clash by case and with names used inside."""
    a, b, c = texts
    found = [(3, a), (5, a), (5, b), (5, b), (None, a), (None, c), (7, None), (8, ""), (9, VERY_LONG)]
    return spark.createDataFrame([(i, t, "other", "en", "xx", "s", 1, 1, "d", 1, "m", "k") for i, t in found], CLASHING)


def test_stages_on_edges(spark):
    rows = edge_rows(spark)
    pairs = lambda df: sorted(((r["doc_id"], (r["text"] or "")[:5]) for r in df.collect()), key=str)
    winners = exact_dedup.keep_winners(rows)
    assert pairs(winners) == sorted([(5, "alpha"), (5, "one t"), (None, "lorem"), (8, ""), (9, "mail ")], key=str)
    kept = simhash.keep_representatives(rows)
    assert pairs(kept) == sorted([(3, "alpha"), (5, "one t"), (None, "lorem"), (7, ""), (9, "mail ")], key=str)
    spoken = langid.keep_identified(rows, model=langid.fit(spark.createDataFrame([(r[0], r[1], r[3]) for r in rows.collect() if r[0] != 9], "doc_id long, text string, lang string")))
    assert spoken.count() == 7 and {r["lang"] for r in spoken.collect()} == {"en"}
    masked = {(r["doc_id"], (r["text"] or "")[:5]): r for r in pii.mask_pii(rows).collect()}
    assert masked[9, "mail "]["text"] == VERY_LONG.replace("joe@example.org", "[EMAIL]").replace("+1 (555) 010-1234", "[PHONE]")
    assert masked[9, "mail "]["n_chars"] == len(masked[9, "mail "]["text"]) and masked[7, ""]["text"] is None
    for stage in (exact_dedup.keep_winners, simhash.keep_representatives, langid.keep_identified, pii.mask_pii):
        out = stage(rows.where("false"))
        assert out.columns == rows.columns and out.count() == 0


def test_operators_on_edges(spark):
    rows = edge_rows(spark)
    labels = spark.createDataFrame([(i, i % 2, i % 2, 0) for i in range(10)] * 2, "doc_id long, quality int, toxic int, QUALITY int")
    for found in (exact_dedup.exact_dedup(rows), simhash.simhash_near_dedup(rows), langid.identify_languages(rows), quality.classify_quality(rows, labels), toxicity.classify_toxicity(rows, labels), pii.find_pii(rows), sampled_pieces.encode_sampled(rows, tokenizer_file(PIECE_MODEL))):
        assert found.select("doc_id").distinct().count() == rows.select("doc_id").distinct().count()
    packed = packing.pack(rows, tokenizer_file(WORD_TOKENIZER)).collect()
    assert {r["doc_id"] for r in packed} == {3, 5, None, 7, 8, 9}
    # repeated ids and vectors, and a column that differs by case
    vectors = spark.createDataFrame([(i % 40, [float(i % 40 == j) for j in range(40)], 0) for i in range(80)] + [(20, [1.0] * 40, 0)], "vec_id long, embedding array<double>, VEC_ID int")
    assert {r["query_id"] for r in ann.nearest_neighbours(vectors, 3).collect()} == {0, 20}
    html = "<p>" + "y" * 300_000
    pages = spark.createDataFrame([(1, "http://a", html, 0), (1, "http://a", html, 0), (2, "http://b", html, 0), (None, None, None, 0)], "page_id long, url string, html string, URL int")
    told = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in warc.warc_roundtrip(pages).collect())
    assert told == [("1", "revisit", 2), ("1", "revisit", 2), ("2", "response", None), ("None", "response", None)]


def test_many_matches_in_one_text(spark):
    """A contact list of 20,000 addresses: linear in the number of matches."""
    text = " ".join(f"u{i}@example.org" for i in range(20_000))
    table = docs(spark, [text])
    found = by_id(pii.find_pii(table).where("doc_id = 0").collect())
    assert found[0]["n_email"] == 20_000 and found[0]["base_sha256"] == hashlib.sha256(",".join(_base(text)).encode()).hexdigest()


def test_discovered_instances_bear_patterns(spark):
    """Bootstrapping: what the first round finds makes a pattern of its own, which finds more."""
    seeds = [f"please call +1 (555) 010-{i:04d} today" for i in range(20)]
    first = [f"please call 555-020-{i:04d} tonight" for i in range(4)]
    second = [f"just ring 555-030-{i:04d} tonight" for i in range(2)]
    far = ["lot 555-040-0001 sold", "just ring 555-030-0000 tonight"]
    found = by_id(pii.find_pii(docs(spark, seeds + first + second + far)).collect())
    spans = [found[i]["spans"] for i in range(20, 28)]
    assert all(s == "phone:12:24" for s in spans[:4]) and all(s == "phone:10:22" for s in spans[4:6])
    assert spans[6] == "" and spans[7] == spans[4]


def test_archives_in_pieces():
    import gzip

    record = b"WARC/1.1\r\nContent-Length: 5\r\n\r\nab\r\nc\r\n\r\n"
    data = record * 3
    for size in (1, 2, 7, 1000):
        held = list(warc.parse_archive(data[a : a + size] for a in range(0, len(data), size)))
        assert [(b, at) for _, b, at in held] == [(b"ab\r\nc", i * len(record)) for i in range(3)]
    assert b"".join(warc.inflate(gzip.compress(data) + gzip.compress(b"more"), 16)) == data + b"more"
    for broken in (data[:-1], data[1:], b"WARC/1.1\r\nContent-Length: 5"):
        with pytest.raises(ValueError):
            list(warc.parse_archive([broken]))


def test_shared_folder_is_needed_on_a_cluster():
    from types import SimpleNamespace

    from quillon.llm import common

    none = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(none)


def test_segments_under_one_hash_stay_apart(monkeypatch):
    """Where the first hash of segments tells nothing, the characters do, and the sampled ids are the same."""
    vocabulary = sampled_pieces.pieces(tokenizer_file(PIECE_MODEL))
    texts, keys = ["the cat sat on the mat", "a dog, a log", "cat tac", ""], np.arange(4)
    told = sampled_pieces.sample_ids(texts, keys, vocabulary)
    plain, calls = sampled_pieces._mix, []

    def blind(z):
        calls.append(len(z))
        return np.zeros_like(z) if len(calls) == 1 else plain(z)

    monkeypatch.setattr(sampled_pieces, "_mix", blind)
    found = sampled_pieces.sample_ids(texts, keys, vocabulary)
    assert calls[0] == calls[1] == sum(map(len, texts))
    assert [x.tolist() for x in found] == [x.tolist() for x in told]
    assert [sampled_pieces.decode(x, vocabulary) for x in found] == texts
