"""SimHash near-duplicates through a hierarchical index in Gray order.

Distinct 64-bit fingerprints are sorted by Gray rank, so that neighbours share long bit patterns. A block
of them is a tree: a node keeps the mask of the bits all its codes share and their pattern; a child keeps
only the bits its parent has not settled yet. A search adds up differences from the root and drops a whole
group once they exceed the radius. Every code stands in two trees, as it is and rotated by 32 bits: of two
codes that differ in at most r bits one half differs in at most r // 2, so each tree also drops groups whose
leading half has more. Blocks are ranges of the Gray rank of the leading bits, balanced by a histogram; a
code is sent to the blocks its leading bits allow. A block returns a spanning forest of its links, never
all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, keep_once, numbered, pick, place, skew_join, slices, table

RADIUS = 3
#: At least so many blocks, and so many codes in a block, about; a crowded range of ranks is dealt out again by hash.
MIN_BLOCKS, BLOCK_CODES = 64, 16384
#: Leading bits that routing uses at most; their histogram is what the driver holds.
MOST_LEAD = 22
_LEAF, _FAN = 16, 8


def fingerprints(texts: list[bytes | None], words: int = 3) -> np.ndarray:
    """The SimHash of each UTF-8 text, as big-endian bytes [n, 8]."""
    from xxhash import xxh64_digest

    out = np.zeros((len(texts), 8), np.uint8)
    for i, text in enumerate(texts):
        w = (text or b"").lower().split()  # bytes: only A-Z, only ASCII white space
        if not w:
            continue
        shingles = map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False)) if len(w) > words else (b" ".join(w),)
        h = np.frombuffer(b"".join(map(xxh64_digest, shingles, repeat(42))), np.uint8).reshape(-1, 8)
        bits = np.zeros(64, np.int64)
        for a in range(0, len(h), 1 << 16):
            bits += np.unpackbits(h[a : a + (1 << 16)], axis=1).sum(axis=0, dtype=np.int32)
        out[i] = np.packbits(2 * bits > len(h))
    return out


def gray_rank(code: np.ndarray, width: int = 64) -> np.ndarray:
    """Place of each code in the reflected Gray sequence."""
    rank, shift = code.copy(), 1
    while shift < width:
        rank ^= rank >> rank.dtype.type(shift)
        shift *= 2
    return rank


def _rotate(code: np.ndarray, copy: int) -> np.ndarray:
    half = np.uint64(32)
    return (code << half) | (code >> half) if copy else code


class GrayTree:
    """The index of one block of codes."""

    def __init__(self, codes: np.ndarray):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        self.codes = codes[self.order]
        starts = np.arange(0, len(codes), _LEAF)
        both, any_ = np.bitwise_and.reduceat(self.codes, starts), np.bitwise_or.reduceat(self.codes, starts)
        levels = [(both, any_)]
        while len(both) > 1:
            starts = np.arange(0, len(both), _FAN)
            both, any_ = np.bitwise_and.reduceat(both, starts), np.bitwise_or.reduceat(any_, starts)
            levels.append((both, any_))
        self.levels, above = [], None
        for both, any_ in levels[::-1]:  # from the root: mask of shared bits that are new at this node
            mask = ~(both ^ any_)
            new = mask if above is None else mask & ~above[np.arange(len(mask)) // _FAN]
            self.levels.append((new, both))
            above = mask

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Chunks of (query number, member number) within ``radius`` whose leading half differs in at most radius // 2."""
        step = 4096
        for a in range(0, len(queries), step):
            q = queries[a : a + step]
            who, node = np.arange(len(q)), np.zeros(len(q), np.int64)
            total, lead = np.zeros(len(q), np.uint8), np.zeros(len(q), np.uint8)
            for k, (mask, pattern) in enumerate(self.levels):
                if k:
                    fan = node[:, None] * _FAN + np.arange(_FAN)
                    real = fan < len(mask)
                    who, total, lead = (np.repeat(x, _FAN).reshape(-1, _FAN)[real] for x in (who, total, lead))
                    node = fan[real]
                differ = (q[who] ^ pattern[node]) & mask[node]
                total, lead = total + np.bitwise_count(differ), lead + np.bitwise_count(differ >> np.uint64(32))
                near = (total <= radius) & (lead <= radius // 2)
                who, node, total, lead = who[near], node[near], total[near], lead[near]
            for b in range(0, len(who), 1 << 16):
                leaf = node[b : b + (1 << 16), None] * _LEAF + np.arange(_LEAF)
                real = leaf < len(self.codes)
                asked, member = np.repeat(who[b : b + (1 << 16)], _LEAF).reshape(-1, _LEAF)[real], leaf[real]
                near = np.bitwise_count(q[asked] ^ self.codes[member]) <= radius
                yield asked[near] + a, self.order[member[near]]


def _hook(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of a[i] and b[i], for all i; root points to smaller numbers only."""
    while len(a):
        ra, rb = root[a], root[b]
        while (up := root[ra] != ra).any():
            ra[up] = root[ra[up]]
        while (up := root[rb] != rb).any():
            rb[up] = root[rb[up]]
        apart = ra != rb
        a, b = ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))


def _link(rows: pd.DataFrame, radius: int) -> pd.DataFrame:
    """The spanning forest of one block's links: (a, b) ids."""
    ids, codes, inside = rows["rep"].to_numpy(np.int64), rows["code"].to_numpy(np.int64).view(np.uint64), rows["inside"].to_numpy(bool)
    members = np.flatnonzero(inside)
    root = np.arange(len(ids))
    if len(members):
        tree = GrayTree(codes[members])
        for q, m in tree.search(codes, radius):
            m = members[m]
            _hook(root, q[q != m], m[q != m])
    while (root != root[root]).any():
        root = root[root]
    joined = np.flatnonzero(root != np.arange(len(ids)))
    return pd.DataFrame({"a": ids[root[joined]], "b": ids[joined]})


def gray_links(codes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """A spanning set (a, b) of all links of ``codes`` (rep long, code long; codes distinct)."""
    codes = codes.select("rep", "code")
    total = codes.count()
    blocks = max(MIN_BLOCKS, -(-total // BLOCK_CODES))
    # leading bits that cut the blocks: a code is sent to no more blocks than it has such bits, plus its own
    lead = int(np.clip(np.ceil(np.log2(blocks)) + 4, 16, MOST_LEAD))

    def ranks(code: pd.Series) -> np.ndarray:
        c = code.to_numpy(np.int64).view(np.uint64)
        top = np.stack([(_rotate(c, k) >> np.uint64(64 - lead)).astype(np.uint32) for k in (0, 1)])
        return gray_rank(top, lead)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, 1 << lead), np.int64)
        for rows in batches:
            for k, r in enumerate(ranks(rows["code"])):
                sums[k] += np.bincount(r, minlength=1 << lead)
        copy, rank = np.nonzero(sums)
        yield pd.DataFrame({"copy": copy, "rank": rank, "n": sums[copy, rank]})

    # the histogram has at most 2 x 2**lead rows, however many codes there are
    sums = np.zeros((2, 1 << lead), np.int64)
    for row in codes.mapInPandas(count, "copy int, rank int, n long").groupBy("copy", "rank").agg(F.sum("n").alias("n")).toPandas().itertuples():
        sums[row.copy, row.rank] = row.n
    per = max(1, -(-total // blocks))
    block_of = ((np.cumsum(sums, axis=1) - sums) // per).astype(np.int32)
    sizes = [np.bincount(block_of[k], weights=sums[k]).astype(np.int64) for k in (0, 1)]
    parts = [np.maximum(1, -(-s // max(BLOCK_CODES, 2 * per))) for s in sizes]
    flips = np.uint32(1) << np.arange(lead, dtype=np.uint32)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            code, rep = rows["code"].to_numpy(np.int64).view(np.uint64), rows["rep"].to_numpy(np.int64)
            for k in (0, 1):
                turned = _rotate(code, k)
                top = (turned >> np.uint64(64 - lead)).astype(np.uint32)
                rank = gray_rank(np.concatenate([top[:, None], top[:, None] ^ flips], axis=1), lead)
                goal = np.where(sums[k][rank] > 0, block_of[k][rank], -1)  # patterns that no code has are pruned here
                own = goal[:, :1].copy()
                goal.sort(axis=1)
                first = np.concatenate([np.ones((len(goal), 1), bool), goal[:, 1:] != goal[:, :-1]], axis=1)
                i, j = np.nonzero(first & (goal >= own) & (goal >= 0))  # each pair of blocks meets once, in the later one
                block, inside = goal[i, j], goal[i, j] == own[i, 0]
                times = parts[k][block]
                part = np.where(inside, (turned[i] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % times, 0)
                at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                i, block, inside, part = (np.repeat(x, times) for x in (i, block, inside, part))
                member = inside & (at == part)
                keep = member | ~inside | (at > part)
                yield pd.DataFrame({"copy": np.full(keep.sum(), k, np.int32), "block": block[keep].astype(np.int32), "part": at[keep].astype(np.int32), "rep": rep[i[keep]], "code": turned[i[keep]].view(np.int64), "inside": member[keep]})

    routed = codes.mapInPandas(route, "copy int, block int, part int, rep long, code long, inside boolean")
    return routed.groupBy("copy", "block", "part").applyInPandas(lambda rows: _link(rows, radius), "a long, b long").distinct()


def simhash_near_dedup(docs: DataFrame, radius: int = RADIUS, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Words are lower-cased (A-Z) and split at ASCII white space; null and empty texts have the fingerprint
    zero and are linked like any other. component_id is the smallest doc_id reachable over links of at most
    ``radius`` differing bits. Rows without id get a component as well, but never name one (unless all its
    rows lack an id, then null). Repeated ids are repeated rows, linked by their own texts alone. Texts of any
    length are read whole. Extra columns are ignored. An empty table gives an empty result.
    """
    docs = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.lit("").alias("digest"))
    marked = _marked(docs, words)
    return _named(marked, _classes(marked, radius)).drop("digest", "part")


def _marked(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, digest, code) of rows (doc_id, text, digest), as a table."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            codes = fingerprints(batch.column("text").to_pylist(), words).view(">i8")[:, 0].astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(codes)], names=["doc_id", "digest", "code"])

    return table(docs.withColumn("text", F.col("text").cast("binary")).mapInArrow(scan, "doc_id long, digest string, code long"), "simhash")


def _classes(marked: DataFrame, radius: int) -> DataFrame:
    """(code, n, component, part) of every distinct code, as a table: the smallest id reachable, and a number of the component itself."""
    # every distinct code is a node; it is named by its smallest id, codes without any id by one out of reach
    codes = marked.groupBy("code").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    last = F.lit(2**63 - 1) - F.pmod(F.xxhash64("code"), F.lit(2**40))
    codes = table(codes.select("code", F.coalesce("rep", last).alias("rep"), "n"), "simhash-codes")
    # an id that stands for several codes would join them: a code is a node by its own number, ids name the result
    found = components(gray_links(codes.select(F.col("code").alias("rep"), "code"), radius), name="simhash-cc").select(F.col("node").alias("code"), "component")
    linked = codes.join(found, "code", "left").withColumn("component", F.coalesce("component", "code"))
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    return table(linked.join(least, "component").select("code", "n", F.col("least").alias("component"), F.col("component").alias("part")), "simhash-classes")


def _named(marked: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id, digest, part) of every row of ``marked``."""
    out = skew_join(marked, classes, "code", "n")
    named = F.when(F.col("component") < 2**63 - 2**41, F.col("component"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), named.alias("component_id"), "digest", "part")


def keep_representatives(docs: DataFrame, radius: int = RADIUS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that represent their component: one row, of its smallest id.

    A row is known by its id and fingerprint, so a repeated id with texts of different components keeps what
    represents each. A component without any id keeps one row too; of rows that repeat id and text one stays,
    it does not matter which. Null, empty and white texts are near-duplicates of each other. Texts may have
    any length, column names may clash in any way. Empty in, empty out.
    """
    at, text = place(docs, id_col), place(docs, text_col)
    rows = numbered(docs)
    marked = _marked(rows.select(F.col(f"c{at}").cast("long").alias("doc_id"), F.coalesce(f"c{text}", F.lit("")).alias("text"), F.sha2(F.coalesce(f"c{text}", F.lit("")), 256).alias("digest")), 3)
    found = _named(marked, _classes(marked, radius))
    # of several texts of that id the one of the smallest fingerprint, then digest
    sums = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id", "part", "fingerprint", "digest").agg(F.count("*").alias("n"))
    kept = sums.groupBy("doc_id", "part").agg(F.min(F.struct("fingerprint", "digest", "n")).alias("best")).select(F.col("doc_id").alias("id"), "best.digest", "best.n")
    return keep_once(rows, kept, at, F.sha2(F.coalesce(f"c{text}", F.lit("")), 256), name="simhash-kept").toDF(*docs.columns)
