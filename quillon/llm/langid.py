"""Language identification of mixed-language text.

The script of a word, by its first letter's range, narrows its candidate languages; hashed letter trigrams
give the word a score for each of them; Viterbi with a switching penalty labels every word, and runs of one
label are the spans. A document's language is the one that labels most letters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import numbered, pick, place, slices

#: Fit on about so many labelled rows, spread by a hash of the id, but on about LANG_ROWS of each language at least, or all that it has.
FIT_ROWS, LANG_ROWS = 20_000, 500
#: Labelled rows that a language needs to be learned; languages at most (a column of more is no column of languages: an error).
LEAST_ROWS, MOST_LANGS = 3, 1000
#: Log-score that a change of language costs; the largest lead of one word.
SWITCH, WORD_MOST = 8.0, 6.0
UNKNOWN = "und"
#: Log-odds against every language at which a text counts as being in none.
REJECT = 20.0
_BUCKETS = 1 << 16
#: First code point of each script range and its name.
SCRIPT_RANGES = [(0x00, "Latin"), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x900, "Devanagari"), (0x980, "Indic"), (0xE00, "Thai"), (0xE80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Symbol"), (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD800, "Other")]
SCRIPTS = sorted({name for _, name in SCRIPT_RANGES})
_STARTS = np.array([a for a, _ in SCRIPT_RANGES])
_NAMES = np.array([SCRIPTS.index(name) for _, name in SCRIPT_RANGES], np.uint8)
_FOLD = np.array([b if chr(b).isalpha() and b < 128 or b >= 128 else 32 for b in range(256)], np.uint8)


@dataclass
class Model:
    langs: list[str]
    #: [buckets, langs] log-scores, centred over the languages; [buckets] what was taken away.
    scores: np.ndarray
    common: np.ndarray
    #: [scripts, langs]: may a word of this script be of this language?
    allowed: np.ndarray


@dataclass
class Words:
    """The words of a batch: byte ranges in ``data``, the document and script of each."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    script: np.ndarray


_MARKS = re.compile("[\u2000-\u303f]")


def _only_letters(mark: re.Match) -> str:
    return mark.group() if mark.group().isalpha() else " "


def find_words(texts: list[str | None]) -> Words:
    """Runs of letters. Beyond ASCII only U+2000 to U+303F is looked at mark by mark (quotes, dashes, brackets part words there, letters do not)."""
    parts = [b" " + _MARKS.sub(_only_letters, (t or "").lower()).encode(errors="replace") + b" " for t in texts]
    data = _FOLD[np.frombuffer(b"".join(parts) or b" ", np.uint8)]
    inside = data != 32
    edge = np.diff(inside.astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    doc = np.searchsorted(np.cumsum([len(p) for p in parts]), starts, side="right") if len(starts) else np.zeros(0, np.int64)
    a, b = data[starts].astype(np.int64), data[np.minimum(starts + 1, len(data) - 1)].astype(np.int64) & 63
    point = np.where(a < 0x80, a, np.where(a < 0xE0, (a & 31) << 6 | b, np.where(a < 0xF0, (a & 15) << 12 | b << 6, 0x1F000)))
    return Words(data, starts, ends, doc, _NAMES[np.searchsorted(_STARTS, point, side="right") - 1])


def _trigrams(data: np.ndarray) -> np.ndarray:
    """Bucket of the trigram around each byte."""
    x = data.astype(np.uint32)
    h = np.zeros(len(x), np.uint32)
    h[1:-1] = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA6B)) ^ (x[2:] * np.uint32(0xC2B2AE35))
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F) >> np.uint32(16)).astype(np.uint16)


def word_scores(words: Words, model: Model) -> np.ndarray:
    """[words, langs]: how far each language's log-score lies below the best; barred ones lie furthest."""
    n = len(model.langs)
    if not len(words.starts):
        return np.zeros((0, n), np.float32)
    grams, out = _trigrams(words.data), np.empty((len(words.starts), n), np.float32)
    at = np.empty(2 * len(words.starts), np.int64)
    at[::2], at[1::2] = words.starts, words.ends
    for k in range(n):
        out[:, k] = np.add.reduceat(model.scores[:, k][grams], at)[::2]
    barred = ~model.allowed[words.script]
    barred[barred.all(axis=1)] = False  # a script that no language has tells nothing
    out[barred] = -np.inf
    out -= out.max(axis=1, keepdims=True)
    return np.maximum(out, -WORD_MOST)


def viterbi(scores: np.ndarray, doc: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word; ``doc`` (sorted) parts the words. All documents advance together."""
    labels = np.zeros(len(scores), np.int16)
    if not len(scores):
        return labels
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    count = np.diff(np.append(first, len(doc)))
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    live = np.searchsorted(-count, -np.arange(1, count[0] + 1), side="right")
    moved, before = np.zeros(scores.shape, bool), np.zeros(len(scores), np.int16)
    best = scores[first].copy()
    for t in range(1, count[0]):
        n, at = live[t], first[: live[t]] + t
        own = best[:n]
        top = own.argmax(axis=1)
        jump = own[np.arange(n), top][:, None] - switch
        moved[at], before[at] = jump > own, top
        best[:n] = np.maximum(own, jump) + scores[at]
    now = best.argmax(axis=1).astype(np.int16)
    for t in range(count[0] - 1, -1, -1):
        n, at = live[t], first[: live[t]] + t
        labels[at] = now[:n]
        now[:n] = np.where(moved[at, now[:n]], before[at], now[:n])
    return labels


def fit(rows: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Trigram counts per language of about ``fit_rows`` of the labelled ``rows`` (doc_id, text, lang), more where rare languages need them."""
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().where(F.col("count") >= LEAST_ROWS).limit(MOST_LANGS + 1).collect()}
    if len(counts) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    total = sum(counts.values())
    # a hash of the id below a limit of the language's own
    limits = {lang: int(min(1.0, max(fit_rows / total, LANG_ROWS / n)) * (1 << 20)) + 1 for lang, n in counts.items()}
    if limits:
        limit = F.create_map(*(F.lit(x) for pair in sorted(limits.items()) for x in pair))[F.col("lang")]
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < limit).select("lang", "text")
    else:
        rows = rows.where("false").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text"):
            langs, texts = np.array(batch.column("lang").to_pylist(), object), batch.column("text").to_pylist()
            for lang in dict.fromkeys(langs):
                words = find_words([texts[i] for i in np.flatnonzero(langs == lang)])
                own = sums.setdefault(lang, np.zeros(_BUCKETS + len(SCRIPTS), np.int64))
                own[:_BUCKETS] += np.bincount(_trigrams(words.data)[words.data != 32], minlength=_BUCKETS)
                own[_BUCKETS:] += np.bincount(words.script, minlength=len(SCRIPTS))
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(own[at])], names=["lang", "bucket", "n"])

    # at most a row per language and bucket, however many texts there are
    found = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    counts = np.zeros((_BUCKETS + len(SCRIPTS), len(langs)))
    counts[found["bucket"], [langs.index(x) for x in found["lang"]]] = found["n"]
    grams, scripts = counts[:_BUCKETS] + 0.5, counts[_BUCKETS:]
    scores = np.log(grams) - np.log(grams.sum(axis=0)) if langs else grams
    common = scores.mean(axis=1) if langs else np.zeros(_BUCKETS)
    return Model(langs, (scores - common[:, None]).astype(np.float32), common.astype(np.float32), scripts >= 0.01 * np.maximum(1, scripts.sum(axis=0)))


def label(batch: list[str | None], model: Model, spans: bool = False) -> list[tuple[str, float, list]]:
    """(language, share of letters, spans) of each text; spans are (start, end, language) in code points of the lower-cased text."""
    out: list[tuple[str, float, list]] = [(UNKNOWN, 0.0, []) for _ in batch]
    words = find_words(batch)
    if not model.langs or not len(words.starts):
        return out
    labels = viterbi(word_scores(words, model), words.doc)
    letters = words.ends - words.starts
    n = len(model.langs)
    share = np.bincount(words.doc * n + labels, weights=letters, minlength=len(batch) * n).reshape(-1, n)
    total, best = share.sum(axis=1), share.argmax(axis=1)
    for i in np.flatnonzero(total):
        if any(map(str.isalpha, batch[i])):
            out[i] = model.langs[best[i]], float(share[i, best[i]] / total[i]), []
    if spans:
        lead = np.cumsum((words.data & 0xC0) != 0x80)
        begin = np.searchsorted(words.doc, np.arange(len(batch) + 1))
        bases = np.cumsum([1, *(len((t or "").lower()) + 2 for t in batch)])
        for i, text in enumerate(batch):
            own = labels[begin[i] : begin[i + 1]]
            if not len(own):
                continue
            cuts = np.flatnonzero(np.diff(own)) + 1
            base = int(bases[i])
            for a, b in zip([0, *cuts], [*cuts, len(own)], strict=True):
                s, e = words.starts[begin[i] + a], words.ends[begin[i] + b - 1]
                out[i][2].append((int(lead[s]) - 1 - base, int(lead[e]) - 1 - base, model.langs[own[a]]))
    return out


def identify_languages(docs: DataFrame, held_out: Column | None = None, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", spans: bool = False, model: Model | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score (and spans, if asked for).

    Learns from text and non-null lang of rows that ``held_out`` (by default crc32 of the id mod 4 is 2)
    does not name. lang_pred is ``und`` with score 0 if the text is null, empty or has no letter, or if there
    was nothing to learn from; else the language of most letters, ties to the first by name, with their share
    as score. An id that is null counts as not held out. Repeated ids are repeated rows; texts of any length
    are read whole; extra columns are ignored. A language of LEAST_ROWS labelled rows or more is learned, however
    small its share. Empty in, empty out.
    """
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2 if held_out is None else held_out
    docs = pick(docs, doc_id=id_col, text=text_col, lang=lang_col).select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string"))
    docs = docs.withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    model = model or fit(docs.where("NOT held_out"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        for batch in slices(batches, "text", 4 << 20):
            found = label(batch.column("text").to_pylist(), model, spans)
            cols = [batch.column("doc_id"), batch.column("held_out"), pa.array([x[0] for x in found]), pa.array([x[1] for x in found], pa.float64())]
            more = [pa.array([[dict(zip(("start", "end", "lang"), s, strict=True)) for s in x[2]] for x in found], kind)] if spans else []
            yield pa.RecordBatch.from_arrays(cols + more, names=["doc_id", "held_out", "lang_pred", "score", *(["spans"] if spans else [])])

    schema = "doc_id long, held_out boolean, lang_pred string, score double" + ", spans array<struct<start:int,end:int,lang:string>>" * spans
    return docs.select("doc_id", "held_out", "text").mapInArrow(scan, schema)


def evidence(texts: list[str | None], model: Model) -> np.ndarray:
    """By how much the letter trigrams of each text are likelier under their best language than as random buckets (natural log); -inf without letters."""
    words, n = find_words(texts), len(model.langs)
    out = np.full((len(texts), max(1, n)), -np.inf)
    if len(words.starts) and n:
        grams = _trigrams(words.data)
        at = np.stack([words.starts, words.ends], axis=1).ravel()
        first = np.flatnonzero(np.diff(words.doc, prepend=-1))
        some = words.doc[first]
        level = np.add.reduceat(words.ends - words.starts, first) * np.log(_BUCKETS)
        for k in range(n):
            per_word = np.add.reduceat((model.scores[:, k] + model.common)[grams], at)[::2]
            out[some, k] = np.add.reduceat(per_word, first, dtype=float) + level
    return out.max(axis=1)


def keep_identified(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` whose text has a language, all columns; ``lang_col`` becomes the language found.

    Rejected are texts without a letter, null ones among them, and texts whose letter trigrams are clearly less
    likely under every learned language than trigrams drawn at random would be (by REJECT in natural log, so a
    word or two are never enough): keys, encoded bytes, letter soup. Documents of several languages stay, under that of most letters. Learns from all rows that have a
    language; if none has, every text with a letter is kept as it is. Repeated rows share their fate. Texts
    may have any length, column names may clash in any way. Empty in, empty out.
    """
    at, text = place(docs, lang_col), f"c{place(docs, text_col)}"
    rows = numbered(docs)
    if model is None:
        model = fit(pick(docs, doc_id=id_col, text=text_col, lang=lang_col).select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string")))
    if not model.langs:
        return rows.where(F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))).toDF(*docs.columns)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 2 << 20):
            texts = batch.column(text).to_pylist()
            found = [x[0] for x in label(texts, model)]
            keep = pa.array((evidence(texts, model) > -REJECT) & (np.array(found, object) != UNKNOWN))
            cols = [pa.array(found, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names).filter(keep)

    schema = StructType([StructField(f.name, StringType() if i == at else f.dataType) for i, f in enumerate(rows.schema)])
    return rows.mapInArrow(scan, schema).toDF(*docs.columns)
