"""Toxicity: a weighted finite-state grammar over clauses.

Five small transducers (insult, threat, target, negation, reported speech) are composed into one; it reads a
clause as word classes and scores it as a whole: an insult weighs what its word or stem was learned to weigh,
more behind a target, less behind a negation or in reported speech; a threat needs a target. All word classes
are learned from labelled documents, so any language of the labels is covered: insults set the label apart by
themselves; a negation makes a document less likely toxic where it stands just before an insult than where it stands elsewhere, a report
the same further before one, a target makes it likelier; a threat is a word that sets the label apart only where a target
follows. A document's clause scores give its probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import pick, slices, table

#: Fit on about so many labelled documents; documents an entry of the lexicon needs; its least log-odds, two standard errors taken off.
FIT_ROWS, LEAST_DOCS, LEAST_ODDS = 20_000, 4, 1.5
STEMS = (4, 5, 6, 7, 8)
THRESHOLD = 0.3
#: Documents in which a word must stand before an insult (or a target), and elsewhere, to be given a class; how far its log-odds there must lie from those elsewhere, and by how many standard errors.
LEAST_CONTEXTS, LEAST_SHIFT, LEAST_ERRORS = 8, 1.0, 5.0
#: Words before an insult, or after a threat, that are near it.
NEAR = 3
_WORD = re.compile(r"[^\W\d_]+|[\"“”«»]")
_CLAUSE = re.compile(r"[.!?;:\n]+")
INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, OTHER = range(7)


@dataclass
class Transducer:
    """States and moves: (state, class) -> (state, factor, bonus); a class without a move keeps the state."""

    moves: dict[tuple[int, int], tuple[int, float, float]]
    fading: dict[int, int] = field(default_factory=dict)  # where any other class leads

    def step(self, state: int, kind: int) -> tuple[int, float, float]:
        return self.moves.get((state, kind)) or (self.fading.get(state, state), 1.0, 0.0)


#: An insult counts; a second one in the clause counts half as much.
INSULTS = Transducer({(0, INSULT): (1, 1.0, 0.0), (1, INSULT): (1, 0.5, 0.0)})
#: A threat scores if a target follows within three words.
THREATENING = Transducer({(s, THREAT): (1, 1.0, 0.0) for s in range(4)} | {(s, TARGET): (0, 1.0, 4.0) for s in (1, 2, 3)}, {1: 2, 2: 3, 3: 0})
#: A target seen before makes what follows weigh more.
TARGETED = Transducer({(0, TARGET): (1, 1.0, 0.0), (1, INSULT): (1, 1.25, 0.0)})
#: A negation weakens an insult within the next three words.
NEGATED = Transducer({(s, NEGATION): (1, 1.0, 0.0) for s in range(4)} | {(s, INSULT): (0, 0.4, 0.0) for s in (1, 2, 3)}, {1: 2, 2: 3, 3: 0})
#: Reported speech and quotation weaken insults to the end of the clause or quotation.
REPORTED = Transducer({(0, REPORT): (1, 1.0, 0.0), (0, QUOTE): (2, 1.0, 0.0), (1, INSULT): (1, 0.6, 0.0), (2, INSULT): (2, 0.8, 0.0), (2, QUOTE): (0, 1.0, 0.0)})


class Grammar:
    """The composition of all transducers; product states are made when first reached."""

    def __init__(self, *parts: Transducer):
        self.parts, self.moves = parts, {}

    def step(self, state: tuple[int, ...], kind: int) -> tuple[tuple[int, ...], float, float]:
        if (state, kind) not in self.moves:
            steps = [p.step(s, kind) for p, s in zip(self.parts, state, strict=True)]
            self.moves[state, kind] = tuple(s for s, _, _ in steps), math.prod(f for _, f, _ in steps), sum(b for _, _, b in steps)
        return self.moves[state, kind]

    def score(self, kinds: list[int], weights: list[float]) -> float:
        """The clause's score: weights of insults times the factors met, plus bonuses."""
        state, total = (0,) * len(self.parts), 0.0
        for kind, weight in zip(kinds, weights, strict=True):
            state, factor, bonus = self.step(state, kind)
            total += bonus + (factor * weight if kind == INSULT else 0.0)
        return total


GRAMMAR = Grammar(INSULTS, THREATENING, TARGETED, NEGATED, REPORTED)
_QUOTES = frozenset('"“”«»')


@dataclass
class Model:
    words: dict[str, float]
    stems: dict[str, float]
    coefficients: np.ndarray
    prior: float
    classes: dict[str, int] = field(default_factory=dict)  # of words that are no insults

    def __post_init__(self) -> None:
        self.threats = frozenset(w for w, k in self.classes.items() if k == THREAT)

    def weight(self, word: str) -> float:
        own = self.words.get(word)
        return own if own is not None else max((self.stems.get(word[:k], 0.0) for k in STEMS if len(word) > k), default=0.0)

    def kind(self, word: str) -> int:
        """The class of a word that is no insult."""
        return QUOTE if word in _QUOTES else self.classes.get(word, OTHER)


def matched_clauses(text: str, model: Model) -> list[tuple[str, float]]:
    """(clause, score) of every clause that holds an insult or a threat."""
    out = []
    for clause in _CLAUSE.split(text.lower()):
        words = _WORD.findall(clause)
        weights = [model.weight(w) for w in words]
        kinds = [INSULT if x > 0 else model.kind(w) for w, x in zip(words, weights, strict=True)]
        if any(weights) or THREAT in kinds:
            out.append((clause, GRAMMAR.score(kinds, weights)))
    return out


def features(text: str | None, model: Model) -> list[float]:
    """Best clause, all clauses, matches, matches per word; zeros if nothing matches."""
    words = _WORD.findall((text or "").lower())
    distinct = set(words)
    if not any(w in model.words or w in model.threats or any(w[:k] in model.stems for k in STEMS if len(w) > k) for w in distinct):
        return [0.0] * 4
    scores = [s for _, s in matched_clauses(text, model) if s > 0]
    if not scores:
        return [0.0] * 4
    return [min(max(scores), 12.0), math.log1p(sum(scores)), math.log1p(len(scores)), min(1.0, sum(scores) / (len(words) + 20))]


def _fit_lexicon(rows: DataFrame) -> tuple[dict[str, float], dict[str, float], int, int]:
    """Words and stems that set label 1 apart, with their log-odds, from rows (text, label)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {0: Counter(), 1: Counter()}
        for batch in slices(batches, "text"):
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                sums[label].update(set(_WORD.findall((text or "").lower())) - _QUOTES)
                sums[label][""] += 1
            if sum(map(len, sums.values())) > 500_000:
                yield from emit(sums)
        yield from emit(sums)

    def emit(sums: dict[int, Counter]) -> Iterator[pa.RecordBatch]:
        for label, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array([label] * len(own), pa.int32()), pa.array(list(own.values()), pa.int64())], names=["word", "label", "n"])
            own.clear()

    words = rows.mapInArrow(count, "word string, label int, n long").groupBy("word").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("good"))
    words = table(words, "toxic-words")
    all_docs = words.where("word = ''").first()
    bad, good = (int(all_docs["bad"]), int(all_docs["good"])) if all_docs else (0, 0)
    if not bad or not good:
        return {}, {}, bad, good
    terms = words.where("word <> ''").withColumn("stem", F.lit(False))
    for k in STEMS:
        terms = terms.union(words.where(F.length("word") > k).select(F.substring("word", 1, k), "bad", "good", F.lit(True)))
    terms = terms.groupBy("stem", "word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / F.lit(bad + 1.0)) - F.log((F.col("good") + 0.5) / F.lit(good + 1.0))
    error = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    best = terms.where(F.col("bad") >= LEAST_DOCS).withColumn("odds", odds).where(F.col("odds") - 2 * error >= LEAST_ODDS)
    # of FIT_ROWS documents at most a bounded number of words passes LEAST_DOCS and LEAST_ODDS: all of them are kept
    found = best.collect()
    return {r["word"]: r["odds"] for r in found if not r["stem"]}, {r["word"]: r["odds"] for r in found if r["stem"]}, bad, good


def contexts(text: str | None, model: Model, targets: frozenset[str] = frozenset()) -> set[tuple[str, str]]:
    """(role, word) of a text: words near before an insult, words further before one in its clause, and words that stand elsewhere in a text with an insult; given targets, words that one follows nearby, and words where none does."""
    out = set()
    found = False
    for clause in _CLAUSE.split((text or "").lower()):
        words = [w for w in _WORD.findall(clause) if w not in _QUOTES]
        insult = [i for i, w in enumerate(words) if model.weight(w) > 0]
        found = found or bool(insult)
        if targets:
            follow = [i for i, w in enumerate(words) if w in targets]
            near = {j for i in follow for j in range(max(0, i - NEAR), i)} - set(insult)
            out.update(("threat" if j in near else "alone", w) for j, w in enumerate(words) if w not in model.classes and j not in insult)
        else:
            near = {j for i in insult for j in range(max(0, i - NEAR), i)} - set(insult)
            far = set(range(max(0, insult[-1] - NEAR))) - set(insult) - near if insult else set()
            out.update(("near" if j in near else "far" if j in far else "else", w) for j, w in enumerate(words) if j not in insult)
    return out if found or targets else set()


def _fit_classes(rows: DataFrame, model: Model) -> dict[str, int]:
    """Classes of words from where they stand, from rows (text, label): each document counts a (role, word) once.

    A word's odds of label 1 where it stands in a role are compared with its own odds elsewhere in documents that
    hold an insult as well. So what a word says by its language, or by its subject, falls away, and a word that says the same wherever it stands (an
    article, a preposition) gets no class. Only a word that hardly ever stands elsewhere is compared with all words of the role.
    """

    def counted(targets: frozenset[str]) -> DataFrame:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                found = [(r, w, x) for t, x in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True) for r, w in contexts(t, model, targets)]
                cols = list(zip(*found, strict=True)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32())], names=["role", "word", "label"])

        sums = rows.mapInArrow(count, "role string, word string, label int").groupBy("role", "word")
        return sums.agg(F.sum("label").cast("long").alias("bad"), F.sum(1 - F.col("label")).cast("long").alias("good")).where(F.col("bad") + F.col("good") >= LEAST_CONTEXTS)

    def shift(row: Row, other: Row | dict[str, int]) -> float:
        """How far the word's log-odds in its role lie from those elsewhere; 0 unless they surely differ."""
        n, m = row["bad"] + row["good"], other["bad"] + other["good"]
        share = (row["bad"] + other["bad"] + 1) / (n + m + 2)
        surely = abs(row["bad"] / n - other["bad"] / m) >= LEAST_ERRORS * math.sqrt(share * (1 - share) * (1 / n + 1 / m))
        own = math.log((row["bad"] + 0.5) / (row["good"] + 0.5)) - math.log((other["bad"] + 0.5) / (other["good"] + 0.5))
        return own if surely and abs(own) >= LEAST_SHIFT else 0.0

    # words in enough documents: bounded by FIT_ROWS / LEAST_CONTEXTS times the words of a document
    found = {(r["role"], r["word"]): r for r in counted(frozenset()).collect()}
    classes: dict[str, int] = {}
    for role, fewer, more in (("far", REPORT, None), ("near", NEGATION, TARGET)):
        every = {x: sum(r[x] for (own, _), r in found.items() if own == role) for x in ("bad", "good")}
        for (own, word), row in sorted(found.items(), key=lambda x: x[0]):
            by = shift(row, found.get(("else", word), every)) if own == role else 0.0
            if by < 0 or by > 0 and more:
                classes[word] = fewer if by < 0 else more
    model.classes = classes
    targets = frozenset(w for w, k in classes.items() if k == TARGET)
    if targets:
        # before a target the label's odds stand out from the word's own odds where none follows: alone it is no insult
        found = {(r["role"], r["word"]): r for r in counted(targets).collect()}
        classes |= {w: THREAT for (role, w), r in found.items() if role == "threat" and r["bad"] >= LEAST_DOCS and ("alone", w) in found and shift(r, found["alone", w]) >= LEAST_ODDS}
    return classes


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        pull = ridge * np.append(w[:-1], 0.0)
        h = (x * (q * (1 - q) + 1e-9)[:, None]).T @ x + ridge * np.diag([1.0] * (len(w) - 1) + [1e-6])
        step = np.linalg.solve(h, x.T @ (y - q) - pull)
        w += step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
    return w


def fit(rows: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Lexicon from one half of about ``fit_rows`` labelled ``rows`` (doc_id, text, label), coefficients from the other."""
    share = min(1.0, fit_rows / max(1, rows.count()))
    rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    half = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(10)) < 7
    words, stems, bad, good = _fit_lexicon(rows.where(half).select("text", "label"))
    model = Model(words, stems, np.zeros(5), (bad + 0.5) / (bad + good + 1))
    if words or stems:
        model = replace(model, classes=_fit_classes(rows.where(half).select("text", "label"), model))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = [features(t, model) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(x, pa.list_(pa.float64()))], names=["label", "x"])

    found = rows.where(~half).select("text", "label").mapInArrow(measure, "label int, x array<double>").toPandas()
    y = found["label"].to_numpy(float) if len(found) else np.zeros(0)
    model.prior = float((y.sum() + 0.5) / (len(y) + 1))
    if len(y) and 0 < y.sum() < len(y):
        model.coefficients = _logistic(np.array(found["x"].tolist()), y)
    else:
        model.coefficients = np.array([0, 0, 0, 0, math.log(model.prior / (1 - model.prior))])
    return model


def classify_toxicity(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD, model: Model | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (score >= threshold).

    Labels (0 or 1, others ignored) are learned from rows that ``held_out`` (by default crc32 of the id mod 4
    is 2) does not name. Null and empty texts score like any text without a matched clause. Without labels
    of both kinds every document scores the share of label 1. Repeated ids are repeated rows. Texts of any
    length are read whole; extra columns are ignored. Empty in, empty out.
    """
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2 if held_out is None else held_out
    docs = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text").withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    known = pick(labels, doc_id=id_col, label=label_col).where(F.col("label").isin(0, 1)).select(F.col("doc_id").cast("long"), F.col("label").cast("int"))
    model = model or fit(docs.where("NOT held_out").join(known, "doc_id"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = np.array([features(t, model) for t in batch.column("text").to_pylist()]).reshape(-1, 4)
            found = 1 / (1 + np.exp(-(x @ model.coefficients[:-1] + model.coefficients[-1])))
            cols = [batch.column("doc_id"), batch.column("held_out"), pa.array(found), pa.array((found >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(scan, "doc_id long, held_out boolean, score double, predicted int")
