"""Importance resampling, token files and conversation repair, against brute force on small tables."""

import hashlib
import heapq
import json
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm import conversations, resampling, token_files, wavelet
from quillon.llm.queries import BYTE_TOKENIZER, tokenizer_file

SCHEMA = "doc_id long, text string, lang string, TEXT2 string, rank long, key double"
TEXTS = [None, "", " ", "\n\n", "same text", "same text", "One two three. ONE two?", "Ünïcödé ß 日本語 \U0001f600 don't", "a\x00b\x1cc\td  e\r\n", "x" * 5000, "word " * 3000, "<|endoftext|> a", "a b c d e f g h i j k l m n o p q r s t u v", "r s t u v a b c d e f g h i j k l m n o p q"]


def docs(spark, texts=TEXTS):
    rows = [(i, t, None, "x", 7, 1.0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[-1:] + [(None, "no id at all", None, None, None, None), (None, "none here", None, None, None, None)], SCHEMA).repartition(3)


# importance resampling
def brute_resample(rows, target, percent, least):
    def words(t):
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        out, now = [], ""
        for c in folded + " ":
            if c.isascii() and not (c.isdigit() or "a" <= c <= "z"):
                out, now = out + [now] * bool(now), ""
            else:
                now += c
        return out

    def found(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    s, t = [0] * 10_000, [0] * 10_000
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for x in texts:
            for b in found(x):
                counts[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10_000) / ((a + 1) * (sum(t) + 10_000)))) for a, b in zip(s, t, strict=True)]
    out = []
    for i, x in rows:
        f = found(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words(x)) >= least])
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    n = percent * len(order) // 100
    return sorted([str((*r[:4],)) for r in out]), [r[3] for r in order[:n]], n


@pytest.mark.parametrize("stream", [30, 1 << 21])
def test_resample(spark, monkeypatch, stream):
    monkeypatch.setattr(resampling, "STREAM_FEATURES", stream)
    rows = docs(spark)
    target = spark.createDataFrame([("alpha beta same text",), (None,), ("one two three four",)], "text string")
    found = resampling.resample(rows, target, percent=50, least_words=2).collect()
    given = [(r["doc_id"], r["text"]) for r in rows.collect()]
    want, scores, n = brute_resample(given, ["alpha beta same text", None, "one two three four"], 50, 2)
    assert sorted(str((r["doc_id"], r["n_features"], r["weight"], r["score"])) for r in found) == want
    drawn = sorted((r for r in found if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, n + 1)) and [r["score"] for r in drawn] == scores
    assert resampling.resample(rows.where("false"), target).count() == 0
    alone = resampling.resample(rows, target.where("false"), percent=50, least_words=2).collect()
    assert sorted(str((r["doc_id"], r["n_features"], r["weight"], r["score"])) for r in alone) == brute_resample(given, [], 50, 2)[0]


def test_ties_go_to_the_smaller_id(spark, monkeypatch):
    monkeypatch.setattr(resampling, "_noise", lambda seed: F.lit(0).cast("long"))
    rows = spark.createDataFrame([(i, "a b c") for i in range(20, 0, -1)], "doc_id long, text string").repartition(4)
    found = resampling.resample(rows, rows.select("text"), percent=25, least_words=1).where("rank IS NOT NULL").orderBy("rank").collect()
    assert [r["doc_id"] for r in found] == [1, 2, 3, 4, 5]


# wavelet matrix
def test_wavelet_matrix(monkeypatch):
    monkeypatch.setattr(wavelet, "CHUNK", 64)
    rng = np.random.default_rng(5)
    for n, high, bits in ((0, 10, 4), (1, 2, 1), (63, 50, 6), (64, 50, 6), (500, 1000, 10), (1000, 70_000, 17)):
        ids = rng.integers(0, high, n).astype(np.uint32 if bits > 16 else np.uint16)
        ids[: n // 3] = ids[0] if n else 0  # a frequent one
        lengths = np.array([n // 2, 0, n - n // 2])
        data = wavelet.write_shard(ids, bits, [5, None, -7], lengths)
        shard = wavelet.Shard(data)
        wm = shard.ids
        assert (wm.decode() == ids).all() and shard.doc_ids() == [5, None, -7] and shard.lengths().tolist() == lengths.tolist()
        assert [wm.access(i) for i in range(n)] == ids.tolist()
        for value in {*ids[:20].tolist(), 0, high - 1, 1 << bits}:
            places = np.flatnonzero(ids == value).tolist()
            assert wm.count(value) == len(places) and [wm.select(value, k) for k in range(len(places))] == places
            for a in (0, n // 3, n):
                assert wm.rank(value, a) == int((ids[:a] == value).sum()) and wm.count(value, a // 2, a) == int((ids[a // 2 : a] == value).sum())
            with pytest.raises(IndexError):
                wm.select(value, len(places))
        with pytest.raises(IndexError):
            wm.access(n)
    with pytest.raises(ValueError, match="not a token shard"):
        wavelet.Shard(b"something else entirely")
    with pytest.raises(ValueError, match="cut short"):
        wavelet.Shard(data[:-10])
    with pytest.raises(ValueError, match="add up"):
        wavelet.write_shard(ids, 17, [1], np.array([3]))


# token files
def test_coder_is_the_tokenizer(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_WORDS", 50)
    file = tokenizer_file(BYTE_TOKENIZER)
    coder, whole = token_files.ByteCoder(file), Tokenizer.from_file(file)
    rng = random.Random(6)
    parts = ["a", " ", "\n", "  ", "b.", "'s", "'ll", "é", "日", "1", "²", "ª", "\t", "\xa0", "\x85", "<|endoftext|>", "Foo", ", ", "\x1c", "!", "\r\n", " ", "ß", "́", "don't", "ʼ", "“q”", "Ж", "\U0001f600", "_", "\x00"]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(coder.ids(t), coder.kind).tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize(("shard", "ranges"), [(40, 3), (1 << 20, None), (1, 1)])
def test_token_files(spark, tmp_path, shard, ranges):
    whole, rows = Tokenizer.from_file(tokenizer_file(BYTE_TOKENIZER)), docs(spark)
    path = f"file://{tmp_path}/t"
    _, manifest = token_files.write_tokens(rows, tokenizer_file(BYTE_TOKENIZER), 0, path, shard_tokens=shard, ranges=ranges)
    found = token_files.read_tokens(spark, path, manifest).orderBy("start").collect()
    want = sorted((str(r["doc_id"]), whole.encode(r["text"] or "", add_special_tokens=False).ids + [0]) for r in rows.collect())
    assert sorted((str(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist()) for r in found) == want
    at = 0
    for r in found:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) // 4 and r["ids_crc32"] == zlib.crc32(r["ids"])
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in found]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)
    assert manifest.agg(F.sum("tokens"), F.sum("docs")).first() == (at, len(found))
    # looked up without decoding
    common = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in found])
    some = [0, int(common[3]), 50_000]
    assert {r["token"]: r["n"] for r in token_files.count_tokens(spark, path, some).collect()} == {t: int((common == t).sum()) for t in some}
    places = {(str(r["doc_id"]), r["token"], r["at"]) for r in token_files.find_tokens(spark, path, manifest, some[:2]).collect()}
    assert places == {(str(r["doc_id"]), t, int(i)) for r in found for t in some[:2] for i in np.flatnonzero(np.frombuffer(r["ids"], "<u4") == t)}


def test_no_token_files(spark):
    assert token_files.token_digest(docs(spark).where("false"), tokenizer_file(BYTE_TOKENIZER), 0).count() == 0


# conversation repair
def brute_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha) of rows (turn, role, text) in order, by a search over (cost, audit)."""
    spaces, seen, kinds = " \t\n\x0b\x0c\r", set(), []
    for _, role, text in rows:
        bare = text.rstrip(spaces)
        kinds.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    lead = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    name = {"u": "user", "a": "assistant"}
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, last, lines = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            break
        if (i, last) in done:
            continue
        done.add((i, last))
        nxt = "a" if last == "u" else "u"
        heapq.heappush(heap, (cost + 3, audit + "I", i, nxt, (*lines, f"{name[nxt]}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, lines))
            if kinds[i] not in ("blank", "duplicate"):
                extra = 3 if kinds[i] else 0
                if role[:1] in lead[last]:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, lead[last][role[:1]], (*lines, f"{role}:{text}")))
                heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, nxt, (*lines, f"{name[nxt]}:{text}")))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def random_conversations(n):
    rng = random.Random(7)
    texts = ["Hi.", "Hi.", "Yes!", "cut", "", " \t\n", "What? \x0b", "Long " * 300 + "end", "Ünï.", None]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "uber"]
    out = []
    for c in range(n):
        conv = None if c == 3 else c
        for t in range(rng.randint(1, 9)):
            out.append((conv, None if rng.random() < 0.1 else t + (rng.random() < 0.2) * 3, rng.choice(roles), rng.choice(texts), "x", 1))
    return out


@pytest.mark.parametrize("damaged", [True, False])
def test_repair(spark, damaged):
    given = random_conversations(150)
    rows = spark.createDataFrame(given, "conv_id long, turn int, role string, text string, fault string, kind int").repartition(5)
    found = {r["conv_id"]: tuple(r)[1:] for r in conversations.repair_conversations(rows, damaged=damaged).collect()}
    own = {}
    for conv, turn, role, text, *_ in given:
        told = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text, rule = " " if role is None else role, " " if text is None else text, zlib.crc32(told.encode()) % 20 if damaged else 9
        lines = own.setdefault(conv, [])
        if rule == 0:
            continue
        text = "" if rule == 1 else "".join(c for c in text if c not in ".!?") if rule == 2 else text
        lines += [(turn, "user" if rule == 4 else role, text)] * (2 if rule == 3 else 1)
    want = {c: brute_repair(sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))) for c, x in own.items()}
    assert set(found) == set(want)
    for c in want:
        assert found[c] == want[c], c


def test_repair_edges(spark):
    schema = "conv_id long, turn int, role string, text string"
    assert conversations.repair_conversations(spark.createDataFrame([], schema)).count() == 0
    # one long conversation over several batches, and one of which nothing is left
    gone = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    long = [(-1, t, "user" if t % 2 else "assistant", f"text {t}.") for t in range(25_000)]
    found = {r["conv_id"]: r for r in conversations.repair_conversations(spark.createDataFrame([*long, (gone, 0, "user", "Hello.")], schema)).collect()}
    assert tuple(found[gone])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    whole = conversations.repair_conversations(spark.createDataFrame(long, schema), damaged=False).first()
    assert (whole["cost"], whole["audit"], whole["illegal"]) == (6, "I" + "K" * 25_000 + "I", 0)
    assert found[-1]["cost"] > 0 and len(found[-1]["audit"]) >= 23_000


def test_transition_table_stays_small():
    repairs = conversations.Repairs()
    rng = random.Random(8)
    kinds = ["s", "u", "a", "-", "st", "ut", "at", "-t", "x"]
    vector = repairs.end
    for _ in range(20_000):
        vector, _ = repairs.step(vector, rng.choice(kinds))
    assert len({v for v, _ in repairs.table}) < 200
    json.dumps([list(v) for v, _ in repairs.table])
