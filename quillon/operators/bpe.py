"""Byte-level BPE: training on distinct words, encoding in Arrow batches, decoding.

Ids 0 to 255 are bytes, then the merges in order of rank, then the special tokens.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .corpus import PRETOKENS, word_frequencies

Pair = tuple[int, int]


def merge(ids: list[int], pair: Pair, new: int) -> list[int]:
    """``pair`` replaced by ``new``, left to right, without overlaps."""
    out: list[int] = []
    for x in ids:
        if out and (out[-1], x) == pair:
            out[-1] = new
        else:
            out.append(x)
    return out


@dataclass
class Bpe:
    merges: list[Pair]
    pattern: str = PRETOKENS
    special: list[str] = field(default_factory=lambda: ["<|endoftext|>"])

    def __post_init__(self) -> None:
        self.rank = {p: i for i, p in enumerate(self.merges)}
        self.cache: dict[str, list[int]] = {}
        self.bytes_of = [bytes([i]) for i in range(256)]
        for a, b in self.merges:
            self.bytes_of.append(self.bytes_of[a] + self.bytes_of[b])
        self.special_id = {s: len(self.bytes_of) + i for i, s in enumerate(self.special)}
        self.words = regex.compile(self.pattern)
        self.parts = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    @property
    def vocab_size(self) -> int:
        return len(self.bytes_of) + len(self.special)

    def _word(self, word: str) -> list[int]:
        if word not in self.cache:
            ids = list(word.encode())
            while len(ids) > 1:
                best = min(zip(ids, ids[1:], strict=False), key=lambda p: self.rank.get(p, len(self.rank)))
                if best not in self.rank:
                    break
                ids = merge(ids, best, 256 + self.rank[best])
            self.cache[word] = ids
        return self.cache[word]

    def encode(self, text: str, allow_special: bool = True) -> list[int]:
        out, at = [], 0
        for m in self.parts.finditer(text) if allow_special and self.parts else ():
            out += [i for w in self.words.findall(text[at : m.start()]) for i in self._word(w)] + [self.special_id[m.group()]]
            at = m.end()
        return out + [i for w in self.words.findall(text[at:]) for i in self._word(w)]

    def decode(self, ids: list[int]) -> str:
        special = {i: s.encode() for s, i in self.special_id.items()}
        return b"".join(special.get(i) or self.bytes_of[i] for i in ids).decode("utf-8", "replace")

    def to_json(self) -> str:
        return json.dumps({"version": 1, "pattern": self.pattern, "special_tokens": self.special, "merges": self.merges}, indent=2, sort_keys=True) + "\n"

    @staticmethod
    def from_json(text: str) -> Bpe:
        held = json.loads(text)
        return Bpe([tuple(p) for p in held["merges"]], held["pattern"], held["special_tokens"])


class _Tail:
    """Pair counts of the words that the driver does not hold, between a lower and an upper bound.

    ``exact`` runs a pass over them. A merge after it only moves the bounds of the pairs it touches.
    """

    def __init__(self, words: DataFrame | None) -> None:
        self.words, self.low, self.high = words, {}, {}

    def exact(self, merges: list[Pair]) -> None:
        rows = _pairs_of(self.words, merges).toArrow()
        self.low = dict(zip(zip(*(rows[c].to_pylist() for c in ("left", "right")), strict=True), rows["n"].to_pylist(), strict=True))
        self.high = dict(self.low)

    def merged(self, pair: Pair, new: int) -> None:
        (a, b), most = pair, self.high.pop(pair, 0)
        self.low.pop(pair, None)
        if not most:
            return
        for p, n in list(self.high.items()) + [(pair, most)] * (a == b):
            if p != pair and (p[1] == a or p[0] == b):
                # each merge ends one pair before its a and one behind its b; (b, a) can be both
                self.low[p] = max(0, self.low[p] - (2 if p == (b, a) else 1) * most)
            # what stood before a or after b now stands beside the new id
            ends = [(p[0], new)] * (p[1] == a) + [(new, p[1])] * (p[0] == b) + [(new, new)] * (p == (b, a))
            for q in ends:
                self.low[q], self.high[q] = 0, min(n, most)


def _batch_pairs(words: list[str], n: np.ndarray, merges: list[Pair]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, n) of the adjacent ids of many words after ``merges``, by array operations.

    In each round every word merges its pair of the lowest rank wherever it stands; a run of one id merges from
    the left, every other place.
    """
    raw = [w.encode() for w in words]
    ids = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    word = np.repeat(np.arange(len(raw)), [len(w) for w in raw])
    size = 256 + len(merges)
    code = np.array([a * size + b for a, b in merges], np.int64)
    order = np.argsort(code)
    code = code[order]
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(code) and len(ids) > 1:
        key = ids[:-1] * size + ids[1:]
        where = np.minimum(np.searchsorted(code, key), len(code) - 1)
        rank = np.where((code[where] == key) & (word[:-1] == word[1:]), order[where], len(code))
        best = np.full(len(raw), len(code))
        np.minimum.at(best, word[:-1], rank)
        going = best[word] < len(code)
        done.append((ids[~going], word[~going]))
        hit = np.flatnonzero((rank == best[word[:-1]]) & (rank < len(code)))
        if not len(hit):
            ids, word = ids[going], word[going]
            break
        # in a run of hits one apart (equal ids), only every other one merges
        start = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
        nth = np.arange(len(hit)) - np.repeat(start, np.diff(np.append(start, len(hit))))
        hit = hit[nth % 2 == 0]
        ids[hit] = 256 + best[word[hit]]
        going[hit + 1] = False
        ids, word = ids[going], word[going]
    done.append((ids, word))
    ids, word = (np.concatenate(x) for x in zip(*done, strict=True))
    same = word[:-1] == word[1:]
    key, weight = (ids[:-1] * size + ids[1:])[same], n[word[:-1][same]]
    pair, inverse = np.unique(key, return_inverse=True)
    total = np.zeros(len(pair), np.int64)
    np.add.at(total, inverse, weight)
    return pair // size, pair % size, total


def _pairs_of(words: DataFrame, merges: list[Pair]) -> DataFrame:
    """(left, right, n): counts of the adjacent ids of ``words`` (word, n) after ``merges``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, n = _batch_pairs(batch.column("word").to_pylist(), batch.column("n").to_numpy(), merges)
            yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), pa.array(n)], names=["left", "right", "n"])

    return words.select("word", "n").mapInArrow(run, "left long, right long, n long").groupBy("left", "right").agg(F.sum("n").alias("n"))


#: Places whose pairs are counted at a time.
STRETCH = 1 << 20


def _bytes_of(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, bytes) of all words, one behind the other."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    held = pa.concat_arrays([words.cast(pa.large_binary())])  # of its own, so that it begins at 0
    ends = np.frombuffer(held.buffers()[1], np.int64)[: len(held) + 1]
    return np.diff(ends), np.frombuffer(held.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]


class _Head:
    """The words that the driver holds, as one array of ids with -1 between words, and the counts of their pairs.

    A merge finds its places in one look over the array; the counts change by the pairs at those places and beside them.
    """

    def __init__(self, words: pa.StringArray, n: np.ndarray) -> None:
        sizes, letters = _bytes_of(words)
        # a separator stands before each word, and one behind the last
        inside = np.ones(len(letters) + len(sizes) + 1, bool)
        inside[np.append(0, np.cumsum(sizes + 1))] = False
        self.ids = np.full(len(inside), -1, np.int32)
        self.ids[inside] = letters
        self.word = np.zeros(len(inside), np.int32)
        self.word[inside] = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.n = np.asarray(n, np.int64)
        self.counts: dict[Pair, int] = {}
        #: (-count, pair), with what counts have been since; the top is looked up in ``counts`` before it is believed.
        self.heap: list[tuple[int, Pair]] = []
        for at in range(0, len(self.ids) - 1, STRETCH):
            ids = self.ids[at : at + STRETCH + 1]
            self._add(at + np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0)), 1)

    def _add(self, places: np.ndarray, sign: int) -> None:
        """Count the pairs that begin at ``places``, or count them off, a stretch at a time: each takes some ten arrays as long."""
        if len(places) > STRETCH:
            for at in range(0, len(places), STRETCH):
                self._add(places[at : at + STRETCH], sign)
            return
        key = self.ids[places].astype(np.int64) << 32 | self.ids[places + 1]
        pairs, inverse = np.unique(key, return_inverse=True)
        total = np.bincount(inverse, self.n[self.word[places]], len(pairs))
        for k, n in zip(pairs.tolist(), total.tolist(), strict=True):
            pair = k >> 32, k & 0xFFFFFFFF
            now = self.counts.get(pair, 0) + sign * int(n)
            if now:
                self.counts[pair] = now
                heapq.heappush(self.heap, (-now, pair))
            else:
                self.counts.pop(pair, None)

    def best(self) -> Pair | None:
        """The pair of the highest count, ties to the smaller ids."""
        while self.heap and self.counts.get(self.heap[0][1]) != -self.heap[0][0]:
            heapq.heappop(self.heap)
        return self.heap[0][1] if self.heap else None

    def merged(self, pair: Pair, new: int) -> None:
        ids = self.ids
        hit = np.flatnonzero((ids[:-1] == pair[0]) & (ids[1:] == pair[1]))
        if not len(hit):
            return
        if pair[0] == pair[1]:  # in a run of one id every other place merges, from the left
            start = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
            hit = hit[(np.arange(len(hit)) - np.repeat(start, np.diff(np.append(start, len(hit))))) % 2 == 0]
        self._add(self._beside(hit, (-1, 0, 1)), -1)
        ids[hit] = new
        left = np.ones(len(ids), bool)
        left[hit + 1] = False
        self.ids, self.word = ids[left], self.word[left]
        self._add(self._beside(hit - np.arange(len(hit)), (-1, 0)), 1)

    def _beside(self, hit: np.ndarray, steps: tuple[int, ...]) -> np.ndarray:
        """The places, each once, that begin a pair and stand so many steps from a hit."""
        mark = np.zeros(len(self.ids), bool)
        for step in steps:
            mark[hit + step] = True
        mark[:-1] &= (self.ids[:-1] >= 0) & (self.ids[1:] >= 0)
        mark[-1] = False
        return np.flatnonzero(mark)


def _best(head: _Head, tail: _Tail) -> Pair | None:
    """The pair with the highest count (ties: smaller ids), or None if the tail's bounds leave it open."""
    if tail.words is None:
        return head.best()
    total = lambda p, bound: head.counts.get(p, 0) + bound.get(p, 0)
    # pairs that the tail lacks are in the order of the head
    own = head.best()
    pairs = tail.high.keys() | ({own} if own is not None else set())
    best = min(pairs, key=lambda p: (-total(p, tail.low), p))
    sure = (-total(best, tail.low), best)
    return best if sure[0] and all(p == best or sure < (-total(p, tail.high), p) for p in tail.high) else None


#: Parts, by hash, of the words of one frequency, of which some are held.
PARTS = 4096


def _held(counted: DataFrame, most_words: int) -> Column | None:
    """A condition for the commonest words, ``most_words`` at most, or None for all of them.

    Only numbers of words by frequency come to the driver, about as many as the square root of all words. Of the
    last frequency as many parts, dealt by hash, are held as there is room for.
    """
    sizes = counted.groupBy("n").agg(F.count("*").alias("words")).toArrow()
    n, words = sizes["n"].to_numpy(), sizes["words"].to_numpy()
    order = np.argsort(-n)
    until = np.cumsum(words[order])
    if not len(n) or until[-1] <= most_words:
        return None
    fits = int(np.searchsorted(until, most_words, side="right"))
    last, room = int(n[order[fits]]), most_words - int(until[fits - 1]) if fits else most_words
    part = F.pmod(F.xxhash64("word"), F.lit(PARTS))
    found = counted.where(F.col("n") == last).groupBy(part.alias("part")).agg(F.count("*").alias("words")).toArrow()
    of = np.zeros(PARTS, np.int64)
    of[found["part"].to_numpy()] = found["words"].to_numpy()
    parts = int(np.searchsorted(np.cumsum(of), room, side="right"))
    return (F.col("n") > last) | ((F.col("n") == last) & (part < parts))


def train(rows: DataFrame, text: str, vocab_size: int, most_words: int = 1_000_000, special: tuple[str, ...] = ("<|endoftext|>",), pattern: str = PRETOKENS) -> Bpe:
    """Merges by falling pair count (ties: smaller ids) until ``vocab_size`` or no pair is left.

    Spark counts the words. The driver holds the commonest distinct ones, ``most_words`` at most, as arrays of some ten ids a word, which
    bounds its memory and what is sent to it. The others stay a Spark table, whose pairs are counted anew
    when the bounds on their counts no longer tell which pair is next. All words count; ``most_words`` changes no merge.
    """
    if vocab_size < 256 + len(special):
        raise ValueError("the vocabulary holds the bytes and the special tokens at least")
    counted = word_frequencies(rows, text, pattern).persist()
    common = _held(counted, most_words)
    # never by a sorted limit: that sends so many words of every partition to the driver
    head = (counted if common is None else counted.where(common)).toArrow()
    tail = _Tail(None if common is None else counted.where(~common))
    held = _Head(head["word"].combine_chunks(), head["n"].to_numpy())
    del head
    merges: list[Pair] = []
    if tail.words is not None:
        tail.exact(merges)
    while len(merges) < vocab_size - 256 - len(special) and (held.counts or tail.high):
        best = _best(held, tail)
        if best is None:
            tail.exact(merges)
            continue
        new = 256 + len(merges)
        merges.append(best)
        tail.merged(best, new)
        held.merged(best, new)
    counted.unpersist()
    return Bpe(merges, pattern, list(special))


def encode(text: Column, model: Bpe) -> Column:
    """The ids of a text, in Arrow batches."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: model.encode(t or ""))

    return run(text)


def decode(ids: Column, model: Bpe) -> Column:
    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: model.decode(list(x)))

    return run(ids)
