"""Benchmark leaks by winnowing.

Every window of ``SPAN`` words keeps the least hash of its ``GRAM``-word grams.  Equal windows keep
equal hashes, so a document window can only equal a benchmark window where its kept hash is among
the benchmark's: no shared span of SPAN words or more is missed.  Hits are extended to the whole
window and compared word by word.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SPAN = 10
GRAM = 5
#: Bytes of benchmark text in one broadcast block; a larger benchmark is matched block by block.
BLOCK_BYTES = 8 << 20
#: Blocks matched in one pass over the documents.
BLOCKS_A_PASS = 4

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_TABLE = np.random.default_rng(77).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Words:
    """The words of several texts: byte ranges in one lower-cased buffer, hashes, and text borders."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        low = _LOWER[data]
        inside = np.zeros(len(low) + 1, bool)
        inside[:-1] = _IN_WORD[low]
        head = inside[:-1].copy()
        head[1:] &= ~inside[:-2]
        border = off[1:-1]
        border = border[border < len(low)]
        head[border] = inside[border]  # a word ends with its text
        self.begin = np.flatnonzero(head)
        tail = inside[:-1] & ~inside[1:]
        cut = border[(border > 0)]
        tail[cut - 1] = inside[cut - 1]
        self.end = np.flatnonzero(tail) + 1
        self.low = low
        self.first = np.searchsorted(self.begin, off)  # words of text i: first[i] to first[i + 1]
        n = len(self.begin)
        if n:
            size = self.end - self.begin
            power = np.ones(int(size.max()), np.uint64)
            power[1:] = _A
            power = np.multiply.accumulate(power)
            where = np.flatnonzero(inside[:-1])
            place = np.arange(len(where)) - np.repeat(np.cumsum(size) - size, size)
            self.hash = _mix(np.add.reduceat(_TABLE[low[where]] * power[place], np.cumsum(size) - size) + size.astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)
        self.raw = low.tobytes()
        self.text_of = np.repeat(np.arange(len(off) - 1), np.diff(self.first))

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on (borders are not looked at)."""
        if len(self.hash) < n:
            return np.zeros(0, np.uint64)
        h = np.zeros(len(self.hash) - n + 1, np.uint64)
        for i in range(n):
            h = h * _B + self.hash[i : i + len(h)]
        return _mix(h)

    def windows(self, n: int) -> np.ndarray:
        """Word numbers at which n words of one text start."""
        if len(self.hash) < n:
            return np.zeros(0, np.int64)
        t = self.text_of
        return np.flatnonzero(t[: len(t) - n + 1] == t[n - 1 :])

    def kept(self) -> np.ndarray:
        """The least gram hash of each SPAN-word window."""
        g, w = self.grams(GRAM), SPAN - GRAM + 1
        if len(g) < w:
            return np.zeros(0, np.uint64)
        out = g[: len(g) - w + 1].copy()
        for i in range(1, w):
            np.minimum(out, g[i : i + len(out)], out=out)
        return out

    def key(self, i: int, n: int) -> bytes:
        return b" ".join([self.raw[b:e] for b, e in zip(self.begin[i : i + n].tolist(), self.end[i : i + n].tolist())])


class Index:
    """Windows of one block of benchmark items."""

    def __init__(self, items: list[tuple[str, bytes]]):
        off = np.cumsum([0] + [len(t) for _, t in items])
        w = Words(np.frombuffer(b"".join(t for _, t in items), np.uint8), off)
        count = np.diff(w.first)
        self.items: dict[bytes, set[str]] = {}
        starts = w.windows(SPAN)
        self.kept = np.unique(w.kept()[starts]) if len(starts) else np.zeros(0, np.uint64)
        for i in starts.tolist():
            self.items.setdefault(w.key(i, SPAN), set()).add(items[w.text_of[i]][0])
        grams: dict[int, list] = {}
        for k in np.flatnonzero((count > 0) & (count < SPAN)).tolist():
            n, i = int(count[k]), int(w.first[k])
            grams.setdefault(n, []).append(w.grams(n)[i])
            self.items.setdefault(w.key(i, n), set()).add(items[k][0])
        self.short = {n: np.unique(np.array(v, np.uint64)) for n, v in grams.items()}

    @staticmethod
    def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
        if not len(known) or not len(values):
            return np.zeros(len(values), bool)
        at = np.searchsorted(known, values)
        return known[np.minimum(at, len(known) - 1)] == values

    def match(self, w: Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Words that are hit, and the items found in each text."""
        mark = np.zeros(len(w.hash) + 1, np.int64)
        found: dict[int, set[str]] = {}
        looked = [(SPAN, w.kept, self.kept)] + [(n, lambda n=n: w.grams(n), k) for n, k in self.short.items()]
        for n, hashes, known in looked:
            starts = w.windows(n) if len(known) else np.zeros(0, np.int64)
            if not len(starts):
                continue
            for i in starts[self._among(hashes()[starts], known)].tolist():
                names = self.items.get(w.key(i, n))
                if names:
                    mark[i] += 1
                    mark[i + n] -= 1
                    found.setdefault(int(w.text_of[i]), set()).update(names)
        return np.cumsum(mark[:-1]) > 0, found


_ADDED = ("n_words", "n_hit", "hits", "items")
_indexes: dict = {}


def _match_batches(batches, broadcast):
    key = broadcast.value[0]
    if key not in _indexes:
        _indexes.clear()
        _indexes[key] = Index(broadcast.value[1])
    index = _indexes[key]
    for whole in batches:
        for b in common.pieces(whole, 4 << 20):
            w = Words(*common.utf8(b.column("text")))
            hit, found = index.match(w)
            names = [n for n in b.schema.names if n not in _ADDED]
            again = "items" in b.schema.names
            before, old = (b.column("items").to_pylist(), b.column("hits").to_pylist()) if again else (None, None)
            hits, items, n_hit = [], [], []
            for i, (s, e) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
                own, of = hit[s:e], found.get(i, set())
                if again:
                    own, of = own | np.unpackbits(np.frombuffer(old[i], np.uint8), count=e - s).astype(bool), of | set(before[i])
                n_hit.append(int(np.count_nonzero(own)))
                hits.append(np.packbits(own).tobytes())
                items.append(sorted(of))
            new = [pa.array(np.diff(w.first)), pa.array(n_hit, pa.int64()), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *new], names=[*names, *_ADDED])


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, text, the other columns as c0, c1, ..., and n_words, n_hit, hits, items for each row.

    ``hits`` has a bit for each word, ``items`` the sorted names of the items with a window in the
    text.  A word is hit if it is inside any occurrence of a benchmark window: SPAN consecutive words
    of an item, or the whole of a shorter one.  Null or wordless texts have no words; wordless items
    have no windows; items without an id go under the empty name; repeated items count once.  An
    empty benchmark hits nothing, empty documents give no rows.

    The documents are never shuffled.  The benchmark is measured first and dealt into blocks of about
    ``block_bytes``; each block is broadcast on its own, and the hits of one block travel with the
    row to the next.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.coalesce(benchmark["item_id"].cast("string"), F.lit("")).alias("item"), benchmark["text"].cast("string").alias("text")).dropna(subset=["text"])
    total = bench.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block_bytes))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = docs.select(*common.doc_columns(docs, "doc_id"), *[common.of(docs, c).alias(f"c{i}") for i, c in enumerate(others)])
    fields = common.with_fields(out.schema, "n_words long, n_hit long, hits binary, items array<string>")
    for k in range(blocks):
        part = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        rows = sorted((r["item"], r["text"].encode()) for r in part.toLocalIterator())
        sent = spark.sparkContext.broadcast(((k, blocks, hash(tuple(rows))), rows))
        out = out.mapInArrow(common.tidy(lambda it, sent=sent: _match_batches(it, sent)), fields)
        if (k + 1) % BLOCKS_A_PASS == 0 and k + 1 < blocks:
            out = common.materialise(out, "leaks")
    return out


def judge(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items, contaminated for each row of ``docs``; see ``find_leaks``."""
    found = find_leaks(docs.select("doc_id", "text"), benchmark, block_bytes)
    return found.select("doc_id", "n_words", "n_hit", "items", (F.col("n_hit") > 0).alias("contaminated"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no benchmark window."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    back = {c: f"c{i}" for i, c in enumerate(others)} | {"doc_id": "doc_id", "text": "text"}
    clean = find_leaks(docs, benchmark).where(F.col("n_hit") == 0)
    return clean.select(*[F.col(back[c]).alias(c) for c in docs.columns])


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), starts AS (
  SELECT item, ws, least(len(ws), 10) AS n, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0
), wins AS (
  SELECT DISTINCT item, n, array_to_string(ws[i : i + n - 1], ' ') AS g FROM starts
), places AS (
  SELECT rid, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM wins) WHERE len(ws) >= n
), found AS (
  SELECT rid, i, p.n AS n, item FROM (SELECT rid, n, i, array_to_string(ws[i : i + n - 1], ' ') AS g FROM places) p JOIN wins USING (n, g)
), words AS (
  SELECT rid, count(DISTINCT w) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS w FROM (SELECT DISTINCT rid, i, n FROM found)) GROUP BY rid
), names AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN names USING (rid)
"""
