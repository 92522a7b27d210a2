"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

Rotations learned on a bounded sample (iterative quantisation) turn a vector into bits; the bits are split into
substrings of about log2(rows) bits and each substring is an index of its own. An index is dealt out by the
leading bits of its substrings: these are the shuffle keys, a vector goes to one bucket group of each index and
a query only to the groups that its radius can reach. By the pigeonhole principle a code within Hamming radius
``substrings * (reach + 1) - 1`` agrees with the query in at least one substring up to ``reach`` bits, so
probing the balls of that reach retrieves every such code (and those further ones that happen to agree in one
substring). Reach and number of substrings are learned on the sample, for a wanted recall at least work.

Retrieved vectors are ranked in their group by their inner product with 16-bit components, whose error is
bounded; what cannot be among the nearest goes, what is left is ranked by the exact inner product.
Equal vectors are searched once: a class of equal vectors carries its smallest ids, as many as a result holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, skew_join, table

#: Vectors that rotations, reach and substrings are learned on; queries among them that measure the recall;
#: vectors of the sample that give every query a first lower bound of its k-th score.
FIT_VECTORS, FIT_QUERIES, BOUND_VECTORS = 20_000, 400, 8192
#: Values of the sample at most, so that long vectors do not swell it.
FIT_VALUES = 4_000_000
#: Recall that reach and substrings must have on the sample.
FIT_RECALL = 0.93
ROUNDS, MOST_SUBSTRINGS, MOST_REACH = 20, 48, 6
#: Vectors of one bucket group, about; a group of more than twice as many is dealt out again by hash.
GROUP = 8192
#: Relative costs of a posting, a probe and a candidate.
_COST = (1.0, 0.005, 2.0)
_TOP = 32767


@dataclass
class Model:
    mean: np.ndarray
    turns: np.ndarray  # [dims, substrings * width]
    width: int  # bits of a substring
    lead: int  # leading bits of a substring, by which its index is dealt out
    reach: int  # bits in which a substring may differ

    @property
    def substrings(self) -> int:
        return self.turns.shape[1] // self.width

    @property
    def radius(self) -> int:
        """Every code within so many bits is retrieved."""
        return self.substrings * (self.reach + 1) - 1

    def codes(self, x: np.ndarray) -> np.ndarray:
        """[rows, substrings] values of the substrings."""
        out, places = np.empty((len(x), self.substrings), np.int64), 1 << np.arange(self.width)
        for a in range(0, len(x), 1024):
            bits = (x[a : a + 1024] - self.mean) @ self.turns > 0
            out[a : a + 1024] = bits.reshape(-1, self.substrings, self.width) @ places
        return out


def ball(bits: int, radius: int) -> np.ndarray:
    """All values of ``bits`` bits with at most ``radius`` bits set."""
    values = np.arange(1 << bits)
    return values[np.bitwise_count(values) <= radius]


def _rotations(x: np.ndarray, count: int) -> np.ndarray:
    """[dims, count * dims]: rotations that bring the vectors near the corners of the cube."""
    rng, turns = np.random.default_rng(2), []
    for _ in range(count):
        r = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
        for _ in range(ROUNDS if len(x) else 0):
            u, _, vt = np.linalg.svd(np.where(x @ r > 0, 1.0, -1.0).T @ x)
            r = (u @ vt).T
        turns.append(r)
    return np.concatenate(turns, axis=1)


def learn(x: np.ndarray, k: int, total: int, asked: int, recall: float = FIT_RECALL, group: int = GROUP, many: np.ndarray | None = None) -> Model:
    """The index for ``total`` vectors and ``asked`` queries, from a sample ``x`` of the vectors, of which there are ``many`` equal ones each."""
    n, dims = x.shape if len(x) else (0, x.shape[1] or 1)
    width = int(np.clip(round(np.log2(max(2, total))), 6, 30))
    lead = int(np.clip(np.ceil(np.log2(max(1, total / group))), 0, width))
    mean = x.mean(axis=0) if n else np.zeros(dims)
    turns = _rotations(x[:4096] - mean, -(-MOST_SUBSTRINGS * width // dims))[:, : MOST_SUBSTRINGS * width]
    every = Model(mean, turns, width, lead, width)
    if not n:
        return replace(every, turns=turns[:, :width])
    rng = np.random.default_rng(3)
    some = rng.choice(n, min(FIT_QUERIES, n), replace=False)
    score = (x[some] @ x.T).astype(np.float32)
    score[np.arange(len(some)), some] = -np.inf
    # the sample is thinner than the table: as many of its nearest as the table's k nearest would leave in it
    near = min(n, max(1, round(k * n / total)))
    places = np.stack([np.argsort(-own)[:near] for own in score])
    many = np.ones(n, np.int64) if many is None else many
    # a vector counts for as many results as it gives
    before = np.cumsum(many[places], axis=1) - many[places]
    weight = np.clip(near - before, 0, many[places]).ravel()
    near = places
    codes = every.codes(x)
    apart = np.bitwise_count(codes[some][:, None, :] ^ codes[near]).reshape(-1, MOST_SUBSTRINGS)
    other = np.bitwise_count(codes[some] ^ codes[rng.integers(0, n, (64, len(some)))])
    best = None
    for reach in range(min(MOST_REACH, width) + 1):
        found = np.average(np.logical_or.accumulate(apart <= reach, axis=1), axis=0, weights=weight)
        enough = np.flatnonzero(found >= recall)
        if len(enough):
            m, share = int(enough[0]) + 1, (other <= reach).mean()
            probes = sum(float(np.prod([(width - i) / (i + 1) for i in range(r)])) for r in range(reach + 1))
            cost = m * (total * _COST[0] + asked * (probes * _COST[1] + share * total * _COST[2]))
            best = min(best or (cost, m, reach), (cost, m, reach))
    # no reach is enough: one substring, all of whose buckets are probed
    _, m, reach = best or (0, 1, width)
    return replace(every, turns=turns[:, : m * width], reach=reach)


def _packed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(16-bit components, largest absolute component, norm of what rounding took away) of each vector."""
    top = np.maximum(np.abs(x).max(axis=1), 1e-300)
    small = np.rint(x / top[:, None] * _TOP)
    return small.astype("<i2"), top, np.linalg.norm(x / top[:, None] - small / _TOP, axis=1)


def _pairs(model: Model, lead: int, values: np.ndarray, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of (query number, member number), by query, whose substrings differ in at most the model's reach; members lie in bucket group ``lead``."""
    tail = model.width - model.lead
    left = model.reach - np.bitwise_count((asked >> tail) ^ lead).astype(int)
    order = np.argsort(values, kind="stable")
    rest, ask = values[order] & ((1 << tail) - 1), asked & ((1 << tail) - 1)
    for radius in np.unique(left[left >= 0]):
        own = np.flatnonzero(left == radius)
        # probing visits the ball's buckets; where the ball has more of them than the group has members, the members
        masks = ball(tail, radius) if tail <= 20 else None
        if masks is None or len(masks) > len(rest):
            for a in range(0, len(own), step := max(1, (1 << 20) // max(1, len(rest)))):
                q, m = np.nonzero(np.bitwise_count(ask[own[a : a + step], None] ^ rest) <= radius)
                yield own[a + q], order[m]
            continue
        starts = np.searchsorted(rest, np.arange((1 << tail) + 1))
        for a in range(0, len(own), step := max(1, (1 << 18) // len(masks))):
            bucket = (ask[own[a : a + step], None] ^ masks).ravel()
            size = starts[bucket + 1] - starts[bucket]
            hit = np.flatnonzero(size)
            size, bucket = size[hit], bucket[hit]
            at = np.arange(size.sum()) + np.repeat(starts[bucket] - np.cumsum(size) + size, size)
            yield own[a + np.repeat(hit // len(masks), size)], order[at]


def _best(query: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """Rows that may be among the k + 1 of the highest score of their query, each score lying between low and high."""
    order = np.lexsort((-low, query))
    q = query[order]
    first = np.flatnonzero(np.diff(q, prepend=-1))
    size = np.diff(np.append(first, len(q)))
    floor = np.where(size > k, low[order][np.minimum(first + k, len(q) - 1)], -np.inf)
    return order[high[order] >= np.repeat(floor, size)]


def _usable(vector: Column) -> Column:
    """Not null, not zero, no component null or not finite."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return vector.isNotNull() & F.coalesce(~F.exists(vector, bad), F.lit(False)) & F.exists(vector, lambda v: v != 0)


_ROW = [("value", pa.int32()), ("top", pa.float64()), ("gone", pa.float64()), ("body", pa.binary())]
_ROW_SQL = "value int, top double, gone double, body binary"


def _matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _search(held: DataFrame, wanted: DataFrame, model: Model, floor: np.ndarray, k: int, dims: int, group: int, count: bool = False) -> DataFrame:
    """(query, rep, low, high) of what the index retrieves for each query and cannot be ruled out; with ``count``, (query, seen): how many each bucket group brings up."""
    m, tail = model.substrings, model.width - model.lead
    near = ball(model.lead, model.reach) if model.lead <= 24 else None

    def emit(batches: Iterator[pa.RecordBatch], asks: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                x = _matrix(part.column("v"), dims)
                small, top, gone = _packed(x)
                body, codes = np.array([r.tobytes() for r in small], object), model.codes(x)
                low = []
                if asks:
                    # a score that enough vectors reach, even if the index misses some of them
                    deep = (3 * k + 4) // 2
                    own = np.sort(x @ floor.T, axis=1) if len(floor) >= deep else np.full((len(x), deep), -np.inf)
                    low = [own[:, -deep] - 1e-9 * np.abs(x).sum(axis=1) * (np.abs(floor).max() if len(floor) else 0)]
                for j in range(m):
                    leads = (codes[:, j] >> tail)[:, None] ^ (near if asks else np.zeros(1, np.int64))
                    i = np.repeat(np.arange(len(x)), leads.shape[1])
                    cols = [pa.array(np.full(len(i), j, np.int32)), pa.array(leads.ravel().astype(np.int32)), part.column("id").take(pa.array(i)), *(pa.array(c[i]) for c in low)]
                    cols += [pa.array(codes[i, j].astype(np.int32)), pa.array(top[i]), pa.array(gone[i]), pa.array(body[i], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=["j", "lead", "id", *["floor"] * len(low), *(n for n, _ in _ROW)])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leads = model.codes(_matrix(batch.column("v"), dims)) >> tail
            for j in range(m):
                lead, n = np.unique(leads[:, j], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), j, np.int32)), pa.array(lead.astype(np.int32)), pa.array(n)], names=["j", "lead", "n"])

    if near is None:
        raise ValueError("an index of more than 2**24 bucket groups")
    postings = held.mapInArrow(lambda b: emit(b, False), f"j int, lead int, id long, {_ROW_SQL}")
    probes = wanted.mapInArrow(lambda b: emit(b, True), f"j int, lead int, id long, floor double, {_ROW_SQL}")
    if model.lead:
        # crowded bucket groups (near copies of one vector) are dealt out again; the queries go to all their parts
        sizes = held.select("v").mapInArrow(tally, "j int, lead int, n long").groupBy("j", "lead").agg(F.sum("n").alias("n"))
        crowd = sizes.where(F.col("n") > 2 * group).select("j", "lead", F.ceil(F.col("n") / group).cast("int").alias("parts"))
        postings = postings.join(crowd, ["j", "lead"], "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        probes = probes.join(crowd, ["j", "lead"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    else:
        postings, probes = postings.withColumn("part", F.lit(0)), probes.withColumn("part", F.lit(0))

    def unpack(rows: pd.DataFrame) -> np.ndarray:
        return np.frombuffer(b"".join(rows["body"]), "<i2").reshape(-1, dims).astype(np.float32) / np.float32(_TOP)

    def search(key: tuple, have: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query": np.zeros(0, np.int64), "rep": np.zeros(0, np.int64), "low": np.zeros(0), "high": np.zeros(0)})]
        if not len(have) or not len(ask):
            return pd.DataFrame({"query": np.zeros(0, np.int64), "seen": np.zeros(0, np.int64)}) if count else out[0]
        x, q, ids, asked = unpack(have), unpack(ask), have["id"].to_numpy(), ask["id"].to_numpy()
        # both sides in units of their largest component; the error is that of rounding to 16 bits and of float sums
        gone_x, gone_q = have["gone"].to_numpy(), ask["gone"].to_numpy()
        size_x, size_q = np.linalg.norm(x, axis=1) + gone_x, np.linalg.norm(q, axis=1) + gone_q
        top_x, top_q, floor_q = have["top"].to_numpy(), ask["top"].to_numpy(), ask["floor"].to_numpy()
        seen = np.zeros(len(q), np.int64)
        for i, j in _pairs(model, int(key[1]), have["value"].to_numpy(np.int64), ask["value"].to_numpy(np.int64)):
            if count:
                seen += np.bincount(i, minlength=len(q))
                continue
            for a in range(0, len(i), 1 << 17):
                i2, j2 = i[a : a + (1 << 17)], j[a : a + (1 << 17)]
                score = np.einsum("ij,ij->i", x[j2], q[i2]).astype(float)
                unsure = size_q[i2] * gone_x[j2] + size_x[j2] * gone_q[i2] + (dims + 4) * 1.2e-7 * size_q[i2] * size_x[j2]
                scale = top_q[i2] * top_x[j2]
                low, high = (score - unsure) * scale, (score + unsure) * scale
                ok = np.flatnonzero(high >= floor_q[i2])
                ok = ok[_best(i2[ok], low[ok], high[ok], k)]
                out.append(pd.DataFrame({"query": asked[i2[ok]], "rep": ids[j2[ok]], "low": low[ok], "high": high[ok]}))
        return pd.DataFrame({"query": asked, "seen": seen}) if count else pd.concat(out, ignore_index=True)

    keys = ["j", "lead", "part"]
    return postings.groupBy(*keys).cogroup(probes.groupBy(*keys)).applyInPandas(search, "query long, seen long" if count else "query long, rep long, low double, high double")


def _finalists(found: DataFrame, queries: int, k: int) -> DataFrame:
    """(query, rep): per query those that may be among its k + 1 nearest, each once."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.groupby(["query", "rep"], as_index=False).agg({"low": "min", "high": "max"})
        rows = rows.iloc[_best(rows["query"].to_numpy(), rows["low"].to_numpy(), rows["high"].to_numpy(), k)]
        return rows[["query", "rep"]]

    blocks = max(1, -(-queries // 256))
    return found.groupBy(F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("block")).applyInPandas(merge, "query long, rep long")


def _prepare(vectors: DataFrame, query: Column | None, k: int, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(classes of equal vectors: key, v, ids, id; rows that ask: key, vec_id; their classes: key, id, v, n; length of a vector)."""
    query = F.col("vec_id") % 20 == 0 if query is None else query
    rows = pick(vectors, vec_id=id_col, v=vector_col).select(F.col("vec_id").cast("long"), F.col("v").cast("array<double>")).where(F.col("vec_id").isNotNull() & _usable(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dims = lengths["d"] if lengths else 1
    rows = rows.where(F.size("v") == dims).withColumn("v", F.transform("v", lambda c: c + F.lit(0.0)))
    # equal vectors are known by two hashes; classes keep their k + 1 smallest ids, in two steps so that no task sorts a hot class
    rows = rows.withColumn("key", F.concat(F.hex(F.xxhash64("v")), F.lit("-"), F.hex(F.xxhash64(F.lit(7), "v"))))
    small = rows.select("key", "vec_id").distinct().withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    small = small.withColumn("at", F.row_number().over(Window.partitionBy("key", "part").orderBy("vec_id"))).where(F.col("at") <= k + 1)
    small = small.withColumn("at", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).where(F.col("at") <= k + 1)
    small = small.groupBy("key").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    own = rows.groupBy("key").agg(F.first("v").alias("v"))
    classes = table(small.join(own, "key").withColumn("id", F.col("ids")[0]), "ann-classes")
    asked = table(rows.where(query).select("key", "vec_id").distinct(), "ann-queries")
    queries = table(asked.groupBy("key").agg(F.count("*").alias("n")).join(classes, "key").select("key", "id", "v", "n"), "ann-query-classes")
    return classes, asked, queries, dims


def _learned(classes: DataFrame, queries: int, dims: int, k: int, recall: float, group: int) -> tuple[Model, np.ndarray]:
    """(index, sample for lower bounds), from a sample of the classes by a hash of their id."""
    count = classes.count()
    share = min(1.0, min(FIT_VECTORS, FIT_VALUES // dims) / max(1, count))
    sample = classes.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("v", F.size("ids").alias("n")).toPandas()
    x = np.stack(sample["v"]) if len(sample) else np.zeros((0, dims))
    return learn(x, k, count, queries, recall, group, sample["n"].to_numpy()), x[:BOUND_VECTORS]


def candidate_counts(vectors: DataFrame, k: int = 20, query: Column | None = None, *, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = FIT_RECALL, group: int = GROUP) -> DataFrame:
    """(query, candidates) of each distinct query vector: how many vectors the index brings up for it, each as often as it does."""
    classes, _, queries, dims = _prepare(vectors, query, k, id_col, vector_col)
    model, floor = _learned(classes, queries.count(), dims, k, recall, group)
    return _search(classes.select("id", "v"), queries.select("id", "v"), model, floor, k, dims, group, count=True).groupBy("query").agg(F.sum("seen").alias("candidates"))


def nearest_neighbours(vectors: DataFrame, k: int = 20, query: Column | None = None, *, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = FIT_RECALL, group: int = GROUP) -> DataFrame:
    """The ``k`` nearest rows found for each row that ``query`` names (by default ids divisible by 20).

    Columns: query_id, rank (from 1), vec_id, score: the inner product in double precision. Ties go to the
    smaller vec_id; a row is never its own neighbour. Vectors that are null, zero or hold null or non-finite components take no part, nor do rows
    without id; of differing lengths only the commonest takes part (ties: the longer). Repeated ids are one row
    if their vectors are equal, else several. Queries that find fewer than k (and there are more) are searched
    again with twice the reach. Vectors may have any length. Extra columns are ignored. Empty in, empty out.
    """
    classes, asked, queries, dims = _prepare(vectors, query, k, id_col, vector_col)
    many = queries.count()
    total = classes.agg(F.sum(F.size("ids"))).first()[0] or 0
    model, floor = _learned(classes, many, dims, k, recall, group)
    held, wanted, lists = classes.select("id", "v"), queries.select("id", "v"), None
    product = F.aggregate(F.zip_with("qv", "v", lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p)
    while True:
        pairs = _finalists(_search(held, wanted, model, floor, k, dims, group), many, k)
        exact = pairs.join(classes.select(F.col("id").alias("rep"), "v", "ids"), "rep").join(queries.select(F.col("id").alias("query"), F.col("v").alias("qv")), "query")
        exact = exact.select("query", product.alias("score"), F.explode("ids").alias("vec_id"))
        best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
        near = exact.withColumn("at", best).where(F.col("at") <= k + 1).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("at", "vec_id", "score"))).alias("near"))
        near = table(near, "ann-lists")
        full = F.size("near") >= min(k + 1, total)
        lists = near.where(full) if lists is None else lists.unionByName(near.where(full))
        # a query that finds nothing has no list
        wanted = wanted.join(near.where(full), F.col("id") == F.col("query"), "left_anti").select("id", "v")
        if model.reach >= model.width or not wanted.head(1):
            lists = lists.unionByName(near.where(~full))
            break
        wanted, model = table(wanted, "ann-again"), replace(model, reach=min(model.width, 2 * model.reach + 1))
    # back from classes of equal queries to their rows; hot classes are joined apart
    named = queries.select("key", F.col("id").alias("query"), "n").join(lists, "query").select("key", "near", "n")
    members = skew_join(asked.select("key", F.col("vec_id").alias("query_id")), named, "key", "n").where(F.col("near").isNotNull())
    mine = F.slice(F.filter("near", lambda s: s["vec_id"] != F.col("query_id")), 1, k)
    out = members.select("query_id", F.posexplode(mine).alias("p", "s"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("s.vec_id").alias("vec_id"), F.col("s.score").alias("score"))
