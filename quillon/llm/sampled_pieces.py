"""SentencePiece encoding by forward filtering and backward sampling, and decoding.

All segmentations of a text into vocabulary pieces form a lattice; no piece crosses from a letter to a space,
so the lattice falls into segments (spaces and the run behind them). Forward filtering sums the weight of all
ways to each place; backward sampling draws a piece that ends at the last place, then one that ends where it
begins, and so on. Every draw takes its number from a hash of the row's key and the place in the text, so a
row's segmentation depends on nothing but its key, its text and the seed. Characters without a piece become
byte pieces; decoding gives back every text exactly.

Whole batches are handled by array operations: the distinct segments of a batch are matched against the
vocabulary's trie, filtered place by place, and all their occurrences are sampled together.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, slices

#: Exponent of the rank in a piece's weight: a merged piece of rank r weighs (r + 2) ** -POWER (Zipf's law).
POWER = 1.0
_SPACE, _MARK = 0x20, 0x2581
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * _M1
    z = (z ^ (z >> np.uint64(27))) * _M2
    return z ^ (z >> np.uint64(31))


class Pieces:
    """The vocabulary: a trie over code points, log-weights, and what each id decodes to."""

    def __init__(self, file: str, power: float = POWER):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=file)
        n = sp.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_ids = np.full(256, -1, np.int64)
        plain = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.bytes_of[i] = bytes([int(piece[1:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                text = piece.replace("▁", " ")
                self.bytes_of[i] = text.encode()
                if " " not in text.lstrip(" "):  # others could cross segments
                    plain.append((sp.get_score(i), i, text))
        self.log_weight = np.full(n, -np.inf)
        for rank, (_, i, _) in enumerate(sorted(plain, key=lambda x: (-x[0], x[1]))):
            self.log_weight[i] = -power * np.log(rank + 2.0)
        self.byte_log = float(-power * np.log(len(plain) + 2.0))
        steps: dict[tuple[int, int], int] = {}
        ends = {0: -1}
        for _, i, text in plain:
            state = 0
            for c in text:
                state = steps.setdefault((state, ord(c)), len(steps) + 1)
            ends[state] = i
        keys = np.array([s << 21 | c for s, c in steps], np.int64)
        order = np.argsort(keys)
        self.keys, self.next = keys[order], np.array(list(steps.values()), np.int64)[order]
        self.piece_at = np.full(len(steps) + 1, -1, np.int64)
        for state, i in ends.items():
            self.piece_at[state] = i

    def edges(self, text: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, id) of all pieces in ``text`` that end by ``stop`` of their start; id -1 is a character without a piece."""
        at = np.arange(len(text))
        state, depth = np.zeros(len(text), np.int64), 0
        found, single = [], np.zeros(len(text), bool)
        while len(at):
            key = state << 21 | text[at + depth].astype(np.int64)
            where = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[where] == key
            at, state = at[ok], self.next[where[ok]]
            depth += 1
            piece = self.piece_at[state]
            hit = piece >= 0
            found.append((at[hit], at[hit] + depth, piece[hit]))
            if depth == 1:
                single[at[hit]] = True
            more = at + depth < stop[at]
            at, state = at[more], state[more]
        lone = np.flatnonzero(~single)
        found.append((lone, lone + 1, np.full(len(lone), -1)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


@lru_cache(maxsize=2)
def pieces(file: str, power: float = POWER) -> Pieces:
    return Pieces(file, power)


def sample_ids(texts: list[str | None], keys: np.ndarray, vocabulary: Pieces, seed: int = 0) -> list[np.ndarray]:
    """One sampled segmentation of each text, as ids."""
    parts = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    text = np.concatenate(parts) if len(parts) else np.zeros(0, np.uint32)
    if not len(text):
        return [np.zeros(0, np.int64) for _ in texts]
    doc_start = np.cumsum(sizes) - sizes
    # a literal mark has no piece of its own: marks stand for spaces in the vocabulary
    space = text == _SPACE
    first = np.zeros(len(text), bool)
    first[doc_start[sizes > 0]] = True
    first[1:] |= space[1:] & ~space[:-1]
    begin = np.flatnonzero(first)
    length = np.diff(np.append(begin, len(text)))
    # distinct segments, by a hash of their characters; should two differ under one hash, another salt parts them
    place = np.arange(len(text)) - np.repeat(begin, length)
    for salt in itertools.count(1):
        with np.errstate(over="ignore"):
            mixed = _mix((text.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
            marks = np.add.reduceat(mixed, begin) ^ length.astype(np.uint64)
        _, sample, which = np.unique(marks, return_index=True, return_inverse=True)
        size = length[sample]
        if np.array_equal(size[which], length) and np.array_equal(text[np.repeat(begin[sample][which], length) + place], text):
            break
    base = np.cumsum(size) - size
    own = np.repeat(begin[sample] - base, size) + np.arange(size.sum())
    chars = text[own]
    start, end, piece = vocabulary.edges(chars, np.repeat(base + size, size))
    width = 1 + (chars[start] > 0x7F) + (chars[start] > 0x7FF) + (chars[start] > 0xFFFF)
    weight = np.where(piece >= 0, vocabulary.log_weight[np.maximum(piece, 0)], width * vocabulary.byte_log)
    # places: one more than characters in each segment
    segment = np.repeat(np.arange(len(size)), size)[start]
    node = base + np.arange(len(size))
    source, target = start + segment, end + segment
    level = target - node[segment]
    order = np.lexsort((source, target, level))
    source, target, piece, weight, level = source[order], target[order], piece[order], weight[order], level[order]
    total = np.full(len(chars) + len(size), -np.inf)
    total[node] = 0.0
    cuts = np.searchsorted(level, np.arange(1, size.max() + 2))
    share = np.empty(len(source))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a == b:
            continue
        way = total[source[a:b]] + weight[a:b]
        new = np.flatnonzero(np.diff(target[a:b], prepend=-1))
        count = np.diff(np.append(new, b - a))
        top = np.maximum.reduceat(way, new)
        p = np.exp(way - np.repeat(top, count))
        mass = np.add.reduceat(p, new)
        total[target[a + new]] = top + np.log(mass)
        share[a:b] = p / np.repeat(mass, count)
    # edges by target, with cumulative shares from 0 to 1; a draw walks from a target's first edge to its own
    order = np.argsort(target, kind="stable")
    source, target, piece, share = source[order], target[order], piece[order], share[order]
    head = np.flatnonzero(np.diff(target, prepend=-1))
    within = np.cumsum(share)
    within -= np.repeat((within - share)[head], np.diff(np.append(head, len(share))))
    within[np.append(head[1:], len(share)) - 1] = 1.0
    head_of = np.full(len(total), -1, np.int64)
    head_of[target[head]] = head
    out = np.full(len(text), -2, np.int64)
    now, back = node[which] + length, begin - node[which]  # place in the lattice; what leads to the text
    key = np.repeat(keys.astype(np.uint64), sizes)[begin]
    with np.errstate(over="ignore"):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        origin = np.repeat(doc_start, sizes)[begin]
        goal = node[which]
        while len(now):
            spot = (now + back - origin).astype(np.uint64)
            draw = (_mix(key + spot * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = head_of[now]
            late = np.flatnonzero(within[edge] <= draw)
            while len(late):
                edge[late] += 1
                late = late[within[edge[late]] <= draw[late]]
            now = source[edge]
            out[now + back] = piece[edge]
            go = now > goal
            now, back, key, origin, goal = now[go], back[go], key[go], origin[go], goal[go]
    at = np.flatnonzero(out != -2)
    ids, lone = out[at], out[at] == -1
    times = np.ones(len(at), np.int64)
    c = text[at[lone]].astype(np.int64)
    times[lone] = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
    full = np.repeat(ids, times)
    for char in np.unique(c):
        raw = chr(char).encode("utf-8", "surrogatepass")
        slots = (np.cumsum(times) - times)[lone][c == char]
        for k, b in enumerate(raw):
            full[slots + k] = vocabulary.byte_ids[b]
    per_doc = np.add.reduceat(np.append(times, 0), np.searchsorted(at, doc_start)) * (sizes > 0) if len(at) else sizes
    return np.split(full, np.cumsum(per_doc)[:-1])


def decode(ids: np.ndarray, vocabulary: Pieces) -> str:
    """The text of the ids."""
    table = vocabulary.bytes_of
    return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "surrogatepass")


def encode_sampled(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, power: float = POWER) -> DataFrame:
    """One row per row of ``docs``: doc_id and ids, a segmentation sampled by the row's key.

    Null and empty texts have no ids. A null key counts as 0; repeated rows get equal segmentations.
    Texts of any length are read whole; extra columns are ignored, whatever their names.
    ``model`` is the path of a SentencePiece file with byte fallback. Empty in, empty out.
    """
    docs = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model, power)
        for batch in slices(batches, "text", 2 << 20):
            keys = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            ids = sample_ids(batch.column("text").to_pylist(), keys, own, seed)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids).astype(np.int32)))], names=["doc_id", "ids"])

    return docs.mapInArrow(scan, "doc_id long, ids array<int>")


def decode_ids(rows: DataFrame, model: str) -> DataFrame:
    """One row per row of ``rows`` (doc_id, ids): doc_id, text.

    Null and empty ids give the empty text. Repeated rows come back each, a null key stays null; ids may be of any
    length, extra columns are ignored. Empty in, empty out.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in batches:
            texts = [decode(np.array(x or [], np.int64), own) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(scan, "doc_id long, text string")


def segmentation_digest(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_pieces, ids_crc32 (little-endian unsigned 32-bit ids), text_sha256 and lossless.

    Encodes and decodes in one pass: text_sha256 is of the decoded text, lossless compares it with the text. Null
    and empty texts have no pieces and are lossless as the empty text; a null key counts as 0. Repeated rows get equal results. Texts of any length
    are read whole; extra columns are ignored, whatever their names. Empty in, empty out.
    """
    docs = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in slices(batches, "text", 2 << 20):
            texts = batch.column("text").to_pylist()
            ids = sample_ids(texts, batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False), own, seed)
            back = [decode(x, own) for x in ids]
            cols = [
                batch.column("doc_id"),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
                pa.array([a == (b or "") for a, b in zip(back, texts, strict=True)], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_pieces", "ids_crc32", "text_sha256", "lossless"])

    return docs.mapInArrow(scan, "doc_id long, n_pieces long, ids_crc32 long, text_sha256 string, lossless boolean")
