"""WARC archives: write captures, read them back, and order them by an external index merge.

Records are written by Spark's own text writer (a record is UTF-8 text and ends in CR LF CR LF), so archives
land wherever Spark can write. Reading parses the bytes by Content-Length, record by record. Each archive is a
capture run: its index entries are sorted by (URL key, timestamp) where they are read and written as one table
of runs. Splitters drawn from the keys cut every run into sorted, packed blocks; the blocks of one key range,
from all runs, meet in one task, where a loser tree merges them k ways without sorting anything again. The
ranges, in order, are the globally ordered capture histories.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, shared_path, skew_join, table

#: Payloads under this length are always written in full.
REVISIT_BYTES = 1000
#: Records of an archive at most, and bytes of payload, about: archives of larger records hold fewer.
ARCHIVE_RECORDS, ARCHIVE_BYTES = 2000, 64 << 20
#: Index entries of a key range at most, about; ranges at least (if there are so many entries); splitters are drawn from so many keys a range.
RANGE_ENTRIES, MIN_RANGES, KEYS_PER_RANGE = 100_000, 64, 20
_END = "\r\n\r\n"
_EPOCH = datetime(2024, 1, 1, tzinfo=UTC)


class LoserTree:
    """K-way merge of sorted iterators: each inner node keeps the loser of its match, the root the winner."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _less(self, i: int, j: int) -> bool:
        a, b = self.heads[i], self.heads[j]
        return b is None if a is None or b is None else (a, i) < (b, j)

    def _play(self, i: int) -> None:
        at = (i + self.k) // 2
        while at > 0:
            other = self.losers[at]
            if other == -1:  # nobody came here before: wait
                self.losers[at] = i
                return
            if self._less(other, i):
                self.losers[at], i = i, other
            at //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while (head := self.heads[i := self.losers[0]]) is not None:
            yield head
            self.heads[i] = next(self.runs[i], None)
            self._play(i)


def _header(*lines: tuple[str, Column]) -> Column:
    return F.concat(*(F.concat(F.lit(f"{k}: "), v.cast("string"), F.lit("\r\n")) for k, v in lines))


def _id(page: Column) -> Column:
    h = F.sha2(page.cast("string"), 256)
    h = F.coalesce(h, F.lit("0" * 64))
    return F.concat(F.lit("<urn:uuid:"), *(x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ([F.lit("-")] if a > 1 else []) + [F.substring(h, a, n)]), F.lit(">"))


def write_archives(pages: DataFrame, path: str, *, revisit_bytes: int = REVISIT_BYTES, archive_records: int = ARCHIVE_RECORDS, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write one record per row of ``pages`` (page_id, url, html) below ``path``.

    Of equal payloads of at least ``revisit_bytes`` bytes the one of the largest page_id is the response,
    the rest revisit it; so do repeated rows, except those of that id, which are responses all. A null html is
    an empty payload, a null url an empty target. Payloads may have any length; extra columns are ignored. An
    empty table gives a folder without records.
    """
    pages = pick(pages, page_id="page_id", url="url", html="html").select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    digest, length = F.sha1(F.col("html").cast("binary")), F.octet_length("html").cast("long")
    large = pages.where(length >= revisit_bytes).groupBy(digest.alias("digest")).agg(F.max("page_id").alias("first_id"), F.count("*").alias("n"))
    repeats = table(large.where("n > 1"), "warc-repeats")
    marked = skew_join(pages.select("page_id", "url", "html", digest.alias("digest"), length.alias("bytes")), repeats, "digest", "n") if repeats.head(1) else pages.select("page_id", "url", "html", digest.alias("digest"), length.alias("bytes"), F.lit(None).cast("long").alias("first_id"))
    revisit = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    # escaped as a URI, so that no control character ends a header line
    target = F.regexp_replace(F.regexp_replace("url", r"[\r\n]", "%0A"), r"[\x00-\x20]", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), _header(("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", F.col("bytes"))), F.lit("\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    seconds = F.pmod(F.col("page_id"), F.lit(10**9))
    date = F.date_format(F.timestamp_seconds(seconds + F.lit(int(_EPOCH.timestamp()))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = _header(
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", _id(F.col("page_id"))),
        ("WARC-Date", F.coalesce(date, F.lit("1970-01-01T00:00:00Z"))),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("X-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        ("X-Refers-To-Page-ID", F.when(revisit, F.col("first_id").cast("string")).otherwise("")),
        ("Content-Type", F.lit("application/http;msgtype=response")),
        ("Content-Length", F.octet_length(block)),
    )
    extra = F.when(revisit, _header(("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Refers-To", _id(F.col("first_id"))))).otherwise("")
    record = F.concat(F.lit("WARC/1.1\r\n"), extra, head, F.lit("\r\n"), block)
    sizes = pages.agg(F.avg(length).alias("mean"), F.max(length).alias("most")).first()
    records = int(min(archive_records, max(1, archive_bytes // ((sizes["mean"] or 0) + 600))))
    told = marked.select(record.alias("value"))
    if records * ((sizes["most"] or 0) + 600) <= 4 * archive_bytes:
        told.write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", records).text(path)
        return

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The number of each record's archive in its task: a new one when so many bytes, or records, are full."""
        archive, held, n = 0, 0, 0
        for batch in batches:
            at = []
            for size in pc.binary_length(batch.column("value")).to_pylist():
                if n and (held + size > archive_bytes or n >= archive_records):
                    archive, held, n = archive + 1, 0, 0
                at.append(archive)
                held, n = held + size, n + 1
            yield pa.RecordBatch.from_arrays([batch.column("value"), pa.array(at, pa.int32())], names=["value", "archive"])

    # payloads of very unequal length: counting records would not bound an archive, so bytes are counted
    told.mapInArrow(cut, "value string, archive int").write.partitionBy("archive").option("lineSep", _END).option("compression", "gzip").text(path)


def inflate(content: memoryview | bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a gzip file, piece by piece."""
    unzip = zlib.decompressobj(31)
    for a in range(0, len(content), size):
        data = bytes(content[a : a + size])
        while data:
            yield unzip.decompress(data, size)
            data = unzip.unconsumed_tail
            if unzip.eof and unzip.unused_data:  # another member follows
                data, unzip = unzip.unused_data, zlib.decompressobj(31)
    yield unzip.flush()


def parse_archive(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """(headers with lower-case names, block, offset) of each record of an archive given in pieces; ValueError if it is damaged.

    Holds one record and one piece at a time.
    """
    pieces, held, at = iter(pieces), bytearray(), 0

    def more(n: int) -> bool:
        while len(held) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while more(1):
        seen = 0
        while (end := held.find(_MARK, max(0, seen - 3))) < 0:
            seen = len(held)
            if not more(seen + 1):
                raise ValueError(f"the record at byte {at} has no end of its header")
        first, *lines = held[:end].decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        stop = end + 4 + int(head["content-length"])
        if not more(stop + 4) or held[stop : stop + 4] != _MARK:
            raise ValueError(f"the record at byte {at} does not end where its length says")
        yield head, bytes(held[end + 4 : stop]), at
        del held[: stop + 4]
        at += stop + 4


_MARK = _END.encode()
_INDEX = "run string, url_key string, ts string, page_id long, offset long, payload_bytes long, payload_digest string, record_type string, refers_to long"


_KINDS = {"string": pa.string(), "long": pa.int64()}
_NAMES = [x.split()[0] for x in _INDEX.split(", ")]
_FIELDS = pa.schema([(n, _KINDS[x.split()[1]]) for n, x in zip(_NAMES, _INDEX.split(", "), strict=True)])


def url_keys(urls: list[str]) -> list[str]:
    """Sort keys of URLs: host labels reversed, then path and query; scheme, www, port 80 or 443 and fragment fall away."""
    keys = []
    for url in urls:
        rest = _SCHEME.sub("", url.lower()).partition("#")[0]
        host = _HOST.match(rest).group()
        keys.append(",".join(reversed(_PORT.sub("", host).split("."))) + ")" + rest[len(host) :])
    return keys


_SCHEME, _HOST, _PORT = re.compile(r"^[a-z][a-z0-9+.-]*://(www\.)?"), re.compile(r"[^/?]*"), re.compile(r":(80|443)$")
#: Bytes of index entries that a run is cut at; longer archives make several runs.
_RUN_ENTRIES = 50_000


def _order(row: tuple) -> tuple:
    """The sort key of an index entry, without ties: URL key, time, page (none first), then its place."""
    run, key, ts, page, offset = row[:5]
    return key, ts, page is not None, page or 0, run, offset


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The index entries of all archives below ``path``, those of one archive together and sorted: a capture run.

    Payloads of responses are read and digested anew; damaged archives raise ValueError. A folder without records, or
    without archives, gives no entries.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for head, block, at in parse_archive(inflate(memoryview(content.as_buffer()))):
                    http, _, payload = block.partition(_MARK)
                    told = head["warc-payload-digest"].removeprefix("sha1:")
                    size = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
                    if head["warc-type"] == "response":
                        size, found = len(payload), hashlib.sha1(payload).hexdigest()
                        if found != told:
                            raise ValueError(f"digest of record at byte {at} of {name} is wrong")
                    page, refers = head["x-page-id"], head["x-refers-to-page-id"]
                    rows.append((name, head["warc-target-uri"], head["warc-date"], int(page) if page else None, at, size, told, head["warc-type"], int(refers) if refers else None))
                    if len(rows) == _RUN_ENTRIES:
                        yield run(rows)
                        rows = []
                if rows:
                    yield run(rows)

    def run(rows: list[tuple]) -> pa.RecordBatch:
        keys = url_keys([r[1] for r in rows])
        rows = sorted(((r[0], k, *r[2:]) for r, k in zip(rows, keys, strict=True)), key=_order)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _FIELDS.types, strict=True)], schema=_FIELDS)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(scan, _INDEX)


def merge_index(entries: DataFrame, ranges: int | None = None) -> DataFrame:
    """All index entries in the order of (url_key, ts, page_id), globally: ``position`` rises with it.

    ``entries`` are runs as ``read_archives`` gives them: sorted batches, several of one run if Spark parts it
    (a batch out of order is refused). Splitters are full keys without ties, so one URL's captures may lie in
    several ranges. Null page ids come first. Repeated entries stay. Empty in, empty out.
    """
    entries = entries.select(*_NAMES)
    total = entries.count()
    n = ranges or max(-(-total // RANGE_ENTRIES), min(MIN_RANGES, -(-total // 500)), 1)
    share = min(1.0, n * KEYS_PER_RANGE / max(1, total))
    drawn = entries.where(F.pmod(F.xxhash64("run", "offset"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select(*_NAMES[:5])
    keys = sorted(_order(tuple(r)) for r in drawn.collect()) if n > 1 else []
    splitters = [keys[len(keys) * i // n] for i in range(1, n)] if keys else []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_order(r) for r in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)]
            # a batch of Spark may hold the end of one run and the start of the next
            turns = [i for i in range(1, len(keys)) if keys[i][4] != keys[i - 1][4] or keys[i] < keys[i - 1]]
            out = []
            for a, b in zip([0, *turns], [*turns, len(keys)], strict=True):
                while a < b:
                    at = bisect.bisect_right(splitters, keys[a])
                    end = bisect.bisect_left(keys, splitters[at], a, b) if at < len(splitters) else b
                    out.append((at, _pack(batch.slice(a, end - a))))
                    a = end
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["range", "block"])

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        at, out = key[0].as_py(), []
        runs = [_rows(block.as_py()) for block in table.column("block")]
        merged = [row for _, row in LoserTree(runs)]
        position = pa.array([(at << 40) + i for i in range(len(merged))], pa.int64())
        out = [pa.array(c, t) for c, t in zip(zip(*merged, strict=True), _FIELDS.types, strict=True)]
        return pa.Table.from_arrays([position, *out], names=["position", *_NAMES])

    return entries.mapInArrow(cut, "range int, block binary").groupBy("range").applyInArrow(merge, "position long, " + _INDEX)


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _rows(block: bytes) -> Iterator[tuple[tuple, tuple]]:
    """(sort key, entry) of each entry of a packed block, in its order."""
    batch = pa.ipc.open_stream(block).read_next_batch()
    for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        yield _order(row), row


def warc_roundtrip(pages: DataFrame, path: str | None = None, **options: int) -> DataFrame:
    """Write ``pages`` as archives, read them back, merge the index: one row per page in capture order.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, ts, archive, position.
    Rows without page_id are captured too (time stamp 1970). Repeated ids are repeated rows: of equal
    payloads, every row that carries the largest id is a response. Payloads may have any length: a reader holds
    one record at a time. Extra columns are ignored. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    write_archives(pages, path, **options)
    index = table(read_archives(spark, path), "warc-index")
    merged = merge_index(index)
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "ts", F.col("run").alias("archive"), "position")
