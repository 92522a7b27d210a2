"""Exact deduplication against a minimal perfect hash of historical digests.

The distinct digests of the rows seen before ("history") are split by digest prefix into shards of a
bounded number of keys; every shard gets a minimal perfect hash (hash and displace) whose slots hold the
full digest, the winner's id and the number of rows. A new digest finds its one slot in constant time and
is compared with the full digest there, byte by byte: equal digests are repeats of history, others are
nonmembers and form groups of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_once, numbered, pick, place, skew_join, table

#: Keys of a shard, about; its index then takes some 0.4 MB.
SHARD_KEYS = 8192
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray, d: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = h + np.asarray(d, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * _M1
        z = (z ^ (z >> np.uint64(27))) * _M2
        return z ^ (z >> np.uint64(31))


def _words(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = digests.reshape(-1, 32)[:, 8:24].copy().view("<u8")
    return w[:, 0], w[:, 1]


def build_mph(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(displacements, slot of each key) of n distinct 32-byte digests, given as uint8 [n, 32].

    Buckets take their displacements largest first; a bucket of one key takes a free slot directly, kept
    as -(slot + 1).
    """
    n = len(digests)
    first, second = _words(digests)
    bucket = (first % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    names, starts, counts = np.unique(bucket[order], return_index=True, return_counts=True)
    displace, slots, used = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, bool)
    by_size = np.argsort(-counts, kind="stable")
    free = None
    for at in by_size:
        keys = order[starts[at] : starts[at] + counts[at]]
        if len(keys) == 1:
            if free is None:
                free = iter(np.flatnonzero(~used))
            slot = next(free)
            displace[names[at]], slots[keys[0]] = -(slot + 1), slot
            continue
        d = 1
        while True:
            tries = (_mix(second[keys][None, :], np.arange(d, d + 16)[:, None]) % np.uint64(n)).astype(np.int64)
            tries.sort(axis=1)
            ok = ~used[tries].any(axis=1) & (np.diff(tries, axis=1) > 0).all(axis=1)
            if ok.any():
                d += int(np.argmax(ok))
                break
            d += 16
        where = (_mix(second[keys], d) % np.uint64(n)).astype(np.int64)
        used[where], slots[keys], displace[names[at]] = True, where, d
    return displace, slots


def find_slots(digests: np.ndarray, displace: np.ndarray) -> np.ndarray:
    n = np.uint64(len(displace))
    first, second = _words(digests)
    d = displace[(first % n).astype(np.int64)]
    return np.where(d < 0, -d.astype(np.int64) - 1, (_mix(second, np.maximum(d, 0).astype(np.uint64)) % n).astype(np.int64))


def _bytes(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, 32)


def build_index(classes: DataFrame, shards: int) -> DataFrame:
    """One row per shard of ``classes`` (digest binary, keep_id, n): the hash and its slots."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        digests = _bytes(rows["digest"])
        displace, slots = build_mph(digests)
        back = np.argsort(slots)
        return pd.DataFrame({"shard": [key[0]], "displace": [displace.tobytes()], "digests": [digests[back].tobytes()], "winners": [rows["keep_id"].to_numpy(np.int64)[back].tobytes()], "counts": [rows["n"].to_numpy(np.int64)[back].tobytes()]})

    return classes.withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(build, "shard long, displace binary, digests binary, winners binary, counts binary")


def _shard(shards: int) -> Column:
    return F.pmod(F.conv(F.substring(F.hex("digest"), 1, 12), 16, 10).cast("long"), F.lit(shards))


def lookup(new: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """Merge the pre-aggregated classes ``new`` into ``index``: one row (digest, keep_id, n) per digest of either."""

    def merge(key: tuple, rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        ids, n = rows["keep_id"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
        if not len(held):
            return pd.DataFrame({"digest": rows["digest"], "keep_id": ids, "n": n})
        digests = np.frombuffer(held["digests"].iloc[0], np.uint8).reshape(-1, 32)
        winners = np.frombuffer(held["winners"].iloc[0], np.int64).copy()
        counts = np.frombuffer(held["counts"].iloc[0], np.int64).copy()
        out = pd.DataFrame({"digest": [], "keep_id": [], "n": []})
        if len(rows):
            asked = _bytes(rows["digest"])
            slots = find_slots(asked, np.frombuffer(held["displace"].iloc[0], np.int32))
            member = (digests[slots] == asked).all(axis=1)  # the byte check: a slot is only a candidate
            np.maximum.at(winners, slots[member], ids[member])
            np.add.at(counts, slots[member], n[member])
            out = pd.DataFrame({"digest": rows["digest"][~member], "keep_id": ids[~member], "n": n[~member]})
        flat = digests.tobytes()
        kept = pd.DataFrame({"digest": [flat[i : i + 32] for i in range(0, len(flat), 32)], "keep_id": winners, "n": counts})
        return pd.concat([kept, out], ignore_index=True) if len(out) else kept

    asked = new.withColumn("shard", _shard(shards)).groupBy("shard")
    return asked.cogroup(index.groupBy("shard")).applyInPandas(merge, "digest binary, keep_id long, n long")


def exact_dedup(docs: DataFrame, history: Column | None = None, *, id_col: str = "doc_id", text_col: str = "text", shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical (null counts as empty); the largest id of a group stays. ``history`` (a
    condition on ``doc_id``) names the rows that were there before and make the index; by default half of
    all rows by a hash of the id. The result does not depend on it. Rows without id share the id null:
    they never stay unless the whole group has none. An empty table gives an empty result; columns other
    than the two named are ignored. A repeated id is a repeated row: each comes back. Texts of any length
    are hashed whole.
    """
    history = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0 if history is None else history
    docs = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"))
    docs = docs.withColumn("past", F.coalesce(history, F.lit(False)))
    # one pre-aggregated pass over the texts; hot copies shrink to a row per task before the shuffle
    no_id = F.lit(-(2**63)).cast("long")
    sums = table(docs.groupBy("digest", "past").agg(F.coalesce(F.max("doc_id"), no_id).alias("keep_id"), F.count("*").alias("n")), "dedup-sums")
    shards = max(1, -(-sums.where("past").count() // shard_keys))
    index = build_index(sums.where("past").drop("past"), shards)
    classes = table(lookup(sums.where("NOT past").drop("past"), index, shards), "dedup-classes")
    out = skew_join(docs.select("doc_id", "digest"), classes, "digest", "n")
    keep = F.when(F.col("keep_id") != no_id, F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_winners(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of identical texts (null counts as empty) one row, of the largest id.

    Of a group without any id one row stays as well; of rows that repeat id and text one, it does not matter
    which (their other columns may differ). Texts may have any length. Column names may clash in any way.
    Empty in, empty out.
    """
    at, text = place(docs, id_col), place(docs, text_col)
    rows = numbered(docs)
    kept = exact_dedup(rows, id_col=f"c{at}", text_col=f"c{text}").where("kept").groupBy(F.col("doc_id").alias("id"), F.col("text_sha256").alias("digest")).agg(F.count("*").alias("n"))
    return keep_once(rows, kept, at, F.sha2(F.coalesce(f"c{text}", F.lit("")), 256), name="dedup-kept").toDF(*docs.columns)
