"""WARC archives: writing, reading back, and capture histories by an external index merge.

Each record is a gzip member of its own.  Reading an archive gives its captures as a locally sorted
run; the runs are written, dealt out by ranges of (URL key, timestamp), and in each range merged k
ways by a loser tree, so the whole history is globally ordered without one place that sees it all.
"""
from __future__ import annotations

import base64
import hashlib
import re
import zlib
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Payloads under so many bytes are always stored whole.
REVISIT_BYTES = 1000
#: Revisits or repeated digests (some 60 bytes each) up to which their list is broadcast; beyond, it is joined by shuffle.
BROADCAST_ROWS = 500_000
#: Bytes of one archive file, unless one record has more: an archive is read as one value.
ARCHIVE_BYTES = 32 << 20
LEVEL = 5
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
ID = "urn:tesseral:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EMPTY = zlib.compressobj(LEVEL, wbits=31).flush()
CAPTURES = "run string, place long, url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, offset long, length long, intact boolean"


def capture_time(page_id: int | None) -> str:
    """The pages carry no time; captures are dated by their id, one a minute within a year."""
    return (EPOCH + timedelta(minutes=(page_id or 0) % 525_600)).strftime("%Y-%m-%dT%H:%M:%SZ")


def url_key(url: str) -> str:
    """Sort-friendly key: lower-cased, host labels reversed, then the path and query."""
    rest = re.sub(r"^[a-z][a-z0-9+.-]*://", "", url.strip().lower(), count=1)
    host, tail = re.match(r"([^/?#]*)([^#]*)", rest, re.S).groups()
    host = re.sub(r":(80|443)$", "", host.rpartition("@")[2])
    return ",".join(reversed(host.split("."))) + ")" + (tail or "/")


def _header(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def member(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member.  ``refers_to`` None: a response with its payload, else a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = lambda i: f"<{ID}{'none' if i is None else i}>"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {capture_time(page_id)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    block = http + payload if refers_to is None else http
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(LEVEL, wbits=31)
    return z.compress("\r\n".join(head).encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def sealed(archive: bytes) -> bytes:
    """The file writer ends each row with a zero byte, which is to be the last member's own last one."""
    return archive[:-1] if archive[-1] == 0 else archive + _EMPTY[:-1]


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the rows whose payload a row with a larger page_id has too.

    Most payloads occur once: only digests with two ids go on to the join.  They are written first, so that
    both sides of a shuffled join are plain stages and a payload with a third of all rows can be split.
    """
    payload = F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary")
    slim = pages.select(pages["page_id"].cast("long").alias("page_id"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n")).where(F.col("n") >= REVISIT_BYTES).select("page_id", "digest")
    twice = common.materialise(slim.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("k")).where("k > 1").select("digest", "refers_to"), "digests")
    right = F.broadcast(twice) if twice.count() <= BROADCAST_ROWS else twice
    return slim.join(right, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")) & F.col("refers_to").isNotNull()).select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record for every row of ``pages`` (page_id, url, html) to gzip archives under ``path``.

    Of rows with equal payloads of REVISIT_BYTES or more, those with the largest page_id are
    responses and the others revisit it; all other rows are responses.  A null html is an empty
    payload, a null url leaves the target out, rows without an id are named ``none`` and revisit a
    row that has one.  Repeated rows give repeated records, rows of one id and one payload are all
    responses or all revisits.  A very long payload is one record; an archive over ``archive_bytes`` holds one record.
    """
    found = common.materialise(revisits(pages), "revisits")
    small = found.count() <= BROADCAST_ROWS
    base = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    base = base.withColumn("digest", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    right = found.select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "refers_to")
    rows = base.join(F.broadcast(right) if small else right, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left")

    def row(archive: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([sealed(b"".join(archive))], pa.binary())], names=["value"])

    def run(batches):
        archive, size = [], 0
        for whole in batches:
            for b in common.pieces(whole):
                fields = [b.column(c).to_pylist() for c in ("page_id", "url", "digest", "refers_to")]
                for i, u, d, r, t in zip(*fields, common.blobs(b.column("html"))):
                    m = member(i, u, t, bytes.fromhex(d), r)
                    if archive and size + len(m) > archive_bytes:
                        yield row(archive)
                        archive, size = [], 0
                    archive.append(m)
                    size += len(m)
        if archive:
            yield row(archive)

    records = rows.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "value binary")
    records.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\x00").option("maxRecordsPerFile", 1).text(path)


def read_members(data: bytes):
    """(offset, length, content) of each gzip member; empty members belong to the one before."""
    at, held, view = 0, None, memoryview(data)
    while at < len(data):
        z, parts, end, step = zlib.decompressobj(wbits=31), [], at, 4096
        while not z.eof and end < len(data):  # in slices: what lies behind the member is copied
            more = view[end : end + step]
            parts.append(z.decompress(more))
            end, step = end + len(more), min(2 * step, 1 << 20)
        content, size = b"".join(parts), end - at - len(z.unused_data)
        if not z.eof:
            raise ValueError(f"archive ends inside the record at byte {at}")
        if content:
            if held:
                yield held
            held = (at, size, content)
        elif held:
            held = (held[0], held[1] + size, held[2])
        at += size
    if held:
        yield held


def _page(name: str | None) -> int | None:
    text = (name or "").strip("<>").removeprefix(ID)
    return int(text) if text.lstrip("-").isdigit() else None


def parse(content: bytes) -> dict:
    """Fields of one record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = int(re.search(rb"(?i)^content-length: (\d+)", http, re.M)[1])
    stated = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    actual = hashlib.sha1(payload).hexdigest() if kind == "response" else stated
    size = len(payload) if kind == "response" else declared
    return {"page_id": _page(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "captured": fields["WARC-Date"], "payload_bytes": size, "payload_digest": actual, "record_type": kind, "refers_to": _page(fields.get("WARC-Refers-To")), "payload": payload, "intact": actual == stated and size == declared}


def _order(row: tuple) -> tuple:
    """URL key, time, then id (none first) and the place in the archive."""
    return row[2], row[3], row[4] is not None, row[4] or 0, row[0], row[1]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """CAPTURES rows of all archives under ``path``: each archive is a sorted run of its captures."""
    names = [f.split()[0] for f in CAPTURES.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                rows = []
                for offset, length, content in read_members(data.as_py()):
                    r = parse(content)
                    rows.append((name.rpartition("/")[2], 0, url_key(r["url"] or ""), r["captured"], r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], offset, length, r["intact"]))
                rows = [(x[0], i, *x[2:]) for i, x in enumerate(sorted(rows, key=lambda x: (*_order(x)[:4], x[9])))]
                cols = list(zip(*rows)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, CAPTURES)


class LoserTree:
    """k-way merge of sorted iterators: each inner node keeps the loser of its match."""

    def __init__(self, runs, key=lambda x: x):
        self.key, self.its = key, [iter(r) for r in runs]
        self.k = max(1, len(self.its))
        self.head: list = [self._next(i) for i in range(len(self.its))] or [None]
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._replay(i, filling=True)

    def _next(self, i: int):
        for x in self.its[i]:
            return (self.key(x), i), x
        return None

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return x is not None and (y is None or x[0] <= y[0])

    def _replay(self, i: int, filling: bool = False) -> None:
        node = (i + self.k) // 2
        while node:
            other = self.tree[node]
            if other < 0:
                if filling:  # the first to arrive waits for its opponent
                    self.tree[node] = i
                    return
            elif self._beats(other, i):
                self.tree[node], i = i, other
            node //= 2
        self.tree[0] = i

    def __iter__(self):
        while (best := self.head[self.tree[0]]) is not None:
            yield best[1]
            i = best[0][1]
            self.head[i] = self._next(i)
            self._replay(i)


def _merge_partition(batches):
    runs: dict[str, list] = {}
    schema = None
    for b in batches:
        schema = b.schema
        for row in zip(*(c.to_pylist() for c in b.columns)):
            runs.setdefault(row[0], []).append(row)
    if schema is None:
        return
    for r in runs.values():
        r.sort(key=lambda x: x[1])  # slices of a run come in their order; this only assures it
    merged = LoserTree([runs[k] for k in sorted(runs)], _order)
    block: list[tuple] = []
    for row in merged:
        block.append(row)
        if len(block) == 8192:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*block), schema)], schema=schema)
            block = []
    if block:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*block), schema)], schema=schema)


def merge_index(captures: DataFrame, partitions: int | None = None) -> DataFrame:
    """The rows of ``captures`` (sorted runs) in global order of URL key, time, id.

    Ranges cut through a key where it is crowded: time and id take part in the cut.
    """
    n = partitions or common.parallelism(300 * captures.count(), captures.sparkSession, 32 << 20)
    return captures.repartitionByRange(n, "url_key", "captured", F.col("page_id").asc_nulls_first()).mapInArrow(_merge_partition, CAPTURES)


def histories(pages: DataFrame) -> DataFrame:
    """Archive ``pages``, read the archives back and return their captures in global order.

    An empty table gives no archive records and no rows.  Other columns of ``pages`` do not matter.
    The archives and the sorted runs lie in the shared folder, so a lost executor repeats its own
    archives or ranges only.
    """
    spark = pages.sparkSession
    path = common.new_path(spark, "warc")
    write_archives(pages, path)
    return merge_index(common.materialise(read_archives(spark, path), "runs"))


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), q AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS kept FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN kept = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM q
"""
