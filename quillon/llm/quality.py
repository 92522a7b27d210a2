"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad. Features of a line and of its two neighbours feed the field; forward-backward
gives each line's marginal, and the marginals, weighted by line length, make the document's quality. Only
documents are labelled: a line's own label is latent, and its document's label is evidence of it that is wrong
for some lines. Fitting takes two stages. Generalised EM over the features of single lines, where the expectation
given that evidence is the target of every step, tells which lines are good; then the whole field, neighbours and
changes between good and bad lines included, is fitted to those lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, slices

#: Fit on about so many labelled documents, and on so many lines of each, drawn as runs spread over the whole document.
FIT_ROWS, FIT_LINES, RUN_LINES = 4000, 128, 16
#: Share of the lines of a document that are taken to have its label, before anything is learned.
TRUST = 0.8
_KINDS = 8
_UPPER, _LOWER, _DIGIT, _STOP, _MARK, _SYMBOL, _PIPE, _WIDE = range(_KINDS)


def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, -1, np.int8)
    for b in range(256):
        c = chr(b)
        if b >= 128:
            kinds[b] = _WIDE
        elif c.isupper():
            kinds[b] = _UPPER
        elif c.islower():
            kinds[b] = _LOWER
        elif c.isdigit():
            kinds[b] = _DIGIT
        elif c in ".,;:?'\"()-":
            kinds[b] = _STOP
        elif c == "!":
            kinds[b] = _MARK
        elif c == "|":
            kinds[b] = _PIPE
        elif b > 32:
            kinds[b] = _SYMBOL
    return kinds


_KIND = _byte_kinds()
_POWERS = np.random.default_rng(1).integers(1, 2**63, 64, dtype=np.int64).astype(np.uint64) | np.uint64(1)
FEATURES = 15


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features [lines, FEATURES], bytes of each line, document of each line) of all lines that hold more than white space."""
    parts = [(t or "").encode(errors="replace") + b"\n" for t in texts]
    data = np.frombuffer(b"".join(parts) or b"\n", np.uint8)
    if not parts:
        return np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    doc = np.searchsorted(np.cumsum([len(p) for p in parts]), starts, side="right")
    kinds, black = _KIND[data], data > 32
    sums = np.empty((len(starts), _KINDS))
    for k in range(_KINDS):
        sums[:, k] = np.add.reduceat((kinds == k).view(np.uint8), starts, dtype=np.int64)
    chars = np.add.reduceat(black.view(np.uint8), starts, dtype=np.int64)
    # words: a hash of each, to see words that repeat
    edge = np.diff(black.astype(np.int8), prepend=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(last) < len(first):
        last = np.append(last, len(data))
    words = np.zeros((len(starts), 3))
    line_hash = np.zeros(len(starts), np.uint64)
    if len(first):
        place = np.arange(len(data)) - np.repeat(np.append(0, first), np.diff(np.concatenate([[0], first, [len(data)]])))
        with np.errstate(over="ignore"):
            value = np.where(black, (data.astype(np.uint64) + np.uint64(1)) * _POWERS[place & 63], np.uint64(0))
            h = np.add.reduceat(value, first)
            line_hash = np.add.reduceat(value, starts)
        line = np.searchsorted(starts, first, side="right") - 1
        same, two = np.zeros(len(h), bool), np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
        two[2:] = (h[2:] == h[:-2]) & (line[2:] == line[:-2])
        n = len(starts)
        words = np.stack([np.bincount(line, minlength=n), np.bincount(line, weights=same, minlength=n), np.bincount(line, weights=two, minlength=n)], axis=1)
    keep = chars > 0
    sums, chars, words, doc, line_hash, tail = sums[keep], chars[keep], words[keep], doc[keep], line_hash[keep], ends[keep]
    again = np.zeros(len(doc), bool)
    again[1:] = (line_hash[1:] == line_hash[:-1]) & (doc[1:] == doc[:-1])
    share = sums / np.maximum(1, chars)[:, None]
    count = np.maximum(1, words[:, 0])
    closed = (tail > 0) & np.isin(data[np.maximum(tail - 1, 0)], np.frombuffer(b".?!", np.uint8))
    x = np.stack([*share.T, words[:, 1] / count, words[:, 2] / count, np.minimum(chars / count, 40) / 10, np.log1p(words[:, 0]) / 4, again, closed, np.ones(len(doc))], axis=1)
    return x.astype(np.float32), chars, doc


def with_neighbours(x: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Each line's features and those of the lines before and after it in its document (zeros at the ends)."""
    out = np.zeros((len(x), 3 * x.shape[1]), np.float32)
    n = x.shape[1]
    out[:, :n] = x
    if len(x) > 1:
        inner = (doc[1:] == doc[:-1])[:, None]
        out[1:, n : 2 * n], out[:-1, 2 * n :] = x[:-1] * inner, x[1:] * inner
    return out


@dataclass
class Model:
    weights: np.ndarray  # of the good state; the bad one's are zero
    moves: np.ndarray  # [from, to] log-potentials, bad 0 and good 1
    scale: float  # of the document's log-odds
    shift: float
    prior: float  # share of good documents


def marginals(unary: np.ndarray, doc: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probability of good per line, pair marginals [lines, 2, 2] of a line and the next, first line of each document).

    Forward-backward; all documents advance together. Pairs that would cross documents are zero.
    """
    n = len(unary)
    pairs = np.zeros((n, 2, 2))
    if not n:
        return np.zeros(0), pairs, np.zeros(0, np.int64)
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    count = np.diff(np.append(first, n))
    order = np.argsort(-count, kind="stable")
    start, size = first[order], count[order]
    live = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
    emit = np.stack([np.zeros(n), unary], axis=1)
    emit = np.exp(emit - emit.max(axis=1, keepdims=True))
    move = np.exp(moves)
    ahead, back = np.empty((n, 2)), np.ones((n, 2))
    now = emit[start]
    now = now / now.sum(axis=1, keepdims=True)
    ahead[start] = now
    for t in range(1, size[0]):
        at = start[: live[t]] + t
        now = (now[: live[t]] @ move) * emit[at]
        now /= now.sum(axis=1, keepdims=True)
        ahead[at] = now
    for t in range(size[0] - 2, -1, -1):
        at = start[: live[t + 1]] + t
        b = (emit[at + 1] * back[at + 1]) @ move.T
        back[at] = b / b.sum(axis=1, keepdims=True)
    both = ahead * back
    both /= both.sum(axis=1, keepdims=True)
    inner = np.flatnonzero(doc[1:] == doc[:-1])
    joint = ahead[inner][:, :, None] * move * (emit[inner + 1] * back[inner + 1])[:, None, :]
    pairs[inner] = joint / joint.sum(axis=(1, 2), keepdims=True)
    return both[:, 1], pairs, first


def _log_odds(good: np.ndarray, chars: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Log-odds of the length-weighted mean marginal of each of ``n`` documents; nan without lines."""
    weight = np.bincount(doc, weights=chars, minlength=n)
    mean = np.bincount(doc, weights=chars * good, minlength=n) / np.where(weight, weight, np.nan)
    mean = np.clip(mean, 1e-4, 1 - 1e-4)
    return np.log(mean) - np.log1p(-mean)


def fit_crf(x: np.ndarray, chars: np.ndarray, doc: np.ndarray, labels: np.ndarray, chain: np.ndarray | None = None, rounds: int = 200, ridge: float = 1e-3) -> Model:
    """Latent line labels by generalised EM, then the field, both by Adam steps; ``labels`` are those of documents 0, 1, ..

    ``x`` holds the features of lines and their neighbours; lines of one ``chain`` (by default of one document)
    follow each other.
    """
    prior = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
    model = Model(np.zeros(3 * FEATURES), np.zeros((2, 2)), 1.0, 0.0, prior)
    if not len(x) or labels.min() == labels.max():
        return Model(model.weights, model.moves, 0.0, float(np.log(prior / (1 - prior))), prior)
    y, chain = labels[doc].astype(float), doc if chain is None else chain
    # rare labels and documents of many lines weigh no more than others
    weight = 1.0 / np.bincount(doc, minlength=len(labels))[doc] / np.where(y == 1, labels.sum(), (1 - labels).sum()) / 2
    inner = np.flatnonzero(chain[1:] == chain[:-1])
    p, told = np.zeros(x.shape[1] + 4), (2 * y - 1) * np.log(TRUST / (1 - TRUST))
    m, v = np.zeros_like(p), np.zeros_like(p)
    want, seen = None, None
    for t in range(1, rounds + 1):
        if t <= rounds // 2:  # lines on their own
            unary = x[:, :FEATURES] @ p[:FEATURES].astype(x.dtype)
            pull = weight * (1 / (1 + np.exp(-unary - told)) - 1 / (1 + np.exp(-unary)))
            g = np.append(x[:, :FEATURES].T @ pull.astype(x.dtype), np.zeros(len(p) - FEATURES)) - ridge * p
        else:
            if want is None:
                want = 1 / (1 + np.exp(-x[:, :FEATURES] @ p[:FEATURES].astype(x.dtype)))
                both = np.stack([1 - want, want], axis=1)
                seen = both[inner][:, :, None] * both[inner + 1][:, None, :]
            good, pairs, _ = marginals(x @ p[:-4].astype(x.dtype), chain, p[-4:].reshape(2, 2))
            g = np.append(x.T @ (weight * (want - good)).astype(x.dtype), ((seen - pairs[inner]) * weight[inner, None, None]).sum(axis=0)) - ridge * p
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p + 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    good, _, _ = marginals(x @ p[:-4], chain, p[-4:].reshape(2, 2))
    z = _log_odds(good, chars, doc, len(labels))
    z, y = z[~np.isnan(z)], labels[~np.isnan(z)].astype(float)
    a, b = 1.0, 0.0  # calibrate: two parameters by Newton steps, held back a little
    for _ in range(50):
        q = 1 / (1 + np.exp(-(a * z + b)))
        h = q * (1 - q) + 1e-9
        g = np.array([((y - q) * z).sum() - 0.1 * (a - 1), (y - q).sum() - 0.1 * b])
        step = np.linalg.solve(np.array([[(h * z * z).sum() + 0.1, (h * z).sum()], [(h * z).sum(), h.sum() + 0.1]]), g)
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -1, 1))
    return Model(p[:-4], p[-4:].reshape(2, 2), a, b, prior)


def score(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(quality of each text, probability of good of each line, document of each line)."""
    x, chars, doc = line_features(texts)
    good, _, _ = marginals(with_neighbours(x, doc) @ model.weights, doc, model.moves)
    z = _log_odds(good, chars, doc, len(texts))
    odds = np.where(np.isnan(z), np.log(model.prior / (1 - model.prior)), model.scale * np.nan_to_num(z) + model.shift)
    return 1 / (1 + np.exp(-odds)), good, doc


def spread_runs(lines: int, most: int, run: int) -> np.ndarray:
    """Numbers of at most ``most`` of ``lines`` lines: all, or runs of ``run`` at equal distances from the first line to the last."""
    if lines <= most:
        return np.arange(lines)
    starts = np.linspace(0, lines - run, most // run).astype(int)
    return (starts[:, None] + np.arange(run)).ravel()


def fit(rows: DataFrame, fit_rows: int = FIT_ROWS, fit_lines: int = FIT_LINES) -> Model:
    """Fit on about ``fit_rows`` of the labelled ``rows`` (doc_id, text, label) and at most ``fit_lines`` lines of each, from all over it."""
    share = min(1.0, fit_rows / max(1, rows.count()))
    rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("text", "label")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x, chars, doc = line_features(batch.column("text").to_pylist())
            x = with_neighbours(x, doc)
            at = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            own = [a + spread_runs(b - a, fit_lines, RUN_LINES) for a, b in zip(at[:-1], at[1:], strict=True)]
            cols = [batch.column("label"), *(pa.array([z[s].tobytes() for s in own], pa.binary()) for z in (x, chars.astype(np.int64), np.arange(len(x))))]
            yield pa.RecordBatch.from_arrays(cols, names=["label", "x", "chars", "line"])

    found = rows.mapInArrow(measure, "label int, x binary, chars binary, line binary").toPandas()
    joined = lambda name, kind: np.frombuffer(b"".join(found[name]), kind)
    x, chars, line = joined("x", np.float32).reshape(-1, 3 * FEATURES), joined("chars", np.int64), joined("line", np.int64)
    doc = np.repeat(np.arange(len(found)), [len(b) // 8 for b in found["line"]])
    # a chain ends where the next line of the sample does not follow in the document
    chain = np.cumsum((np.diff(doc, prepend=-1) != 0) | (np.diff(line, prepend=-2) != 1)) - 1
    return fit_crf(x, chars, doc, found["label"].to_numpy(np.int64), chain)


def classify_quality(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", model: Model | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1, higher is better), predicted (score >= 0.5).

    Labels (0 or 1, null ones ignored) are learned from rows that ``held_out`` (by default crc32 of the id
    mod 3 is 1) does not name. Null, empty and blank texts score the share of good labels. If all labels are
    equal or there are none, every document scores that share (0.5). Repeated ids are repeated rows. Texts of
    any length are scored whole; extra columns are ignored. Empty in, empty out.
    """
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1 if held_out is None else held_out
    docs = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text").withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    known = pick(labels, doc_id=id_col, label=label_col).where(F.col("label").isin(0, 1)).select(F.col("doc_id").cast("long"), F.col("label").cast("int"))
    model = model or fit(docs.where("NOT held_out").join(known, "doc_id"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            found = score(batch.column("text").to_pylist(), model)[0]
            cols = [batch.column("doc_id"), batch.column("held_out"), pa.array(found), pa.array((found >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(scan, "doc_id long, held_out boolean, score double, predicted int")
