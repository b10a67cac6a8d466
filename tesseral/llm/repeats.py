"""Exact removal of repeated byte windows by a depth-limited radix sort of suffixes.

Suffixes are ordered only through the first ``WINDOW`` bytes, most significant digit first, and a
group that shrinks to one document drops out; the groups left after the last digit are exactly the
windows that repeat.  The first digit is dealt over the cluster: it is the least hash of a
``SEED_BYTES``-gram inside the window, which equal windows share, so neighbouring suffixes with the
same digit travel as one run of text.  Runs whose first digit occurs in one document only never
travel.  Later digits are eight bytes wide and are sorted inside a bucket.

The documents are dealt into shards once; a shard sends each distinct first digit, and each distinct
run, at most once, with the smallest document that has it.  A passage that a third of all documents
share therefore costs a bucket one row for each shard, not one for each document.

A first digit with very many runs (a common phrase in ever new surroundings) is split by its next digits: the
next least hashes of the window, more of them the more runs there are, up to all.  Equal windows share
those too, so nothing is lost; each part goes to a bucket of its own.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 50
SEED_BYTES = 16
#: Runs of one first digit from which it is split by the next one; each STEP times as many double the digits.
HOT_RUNS, STEP = 16_384, 16
GRAMS = WINDOW - SEED_BYTES + 1
#: Bytes of text that one vector step covers; bounds the memory of a task.
BLOCK = 2 << 20
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes at each start (k a power of two)."""
    h = _TABLE[data]
    w = 1
    while w < k:
        h = h[:-w] * _power(w) + h[w:]
        w *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    n = 1
    while 2 * n <= w:
        a = np.minimum(a[:-n], a[n:])
        n *= 2
    return np.minimum(a[: len(a) - (w - n)], a[w - n :]) if n < w else a


def _blocks(off: np.ndarray):
    """Row ranges of about BLOCK bytes."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + BLOCK, "right")) - 1)
        yield i, j
        i = j


def runs(data: np.ndarray, off: np.ndarray):
    """(row, first start, last start, least hash) of the runs of windows with one first digit.

    Starts are relative to the row's text.  Every window of every row is in exactly one run.
    """
    out = []
    span = GRAMS
    for i, j in _blocks(off):
        part, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        count = np.maximum(np.diff(o) - WINDOW + 1, 0)
        if not count.any():
            continue
        least = sliding_min(gram_hashes(part, SEED_BYTES), span)
        rows = np.repeat(np.arange(j - i), count)
        start = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
        value = least[start + o[:-1][rows]]
        head = np.flatnonzero(np.concatenate(([True], (value[1:] != value[:-1]) | (rows[1:] != rows[:-1]))))
        tail = np.append(head[1:], len(rows)) - 1
        out.append((rows[head] + i, start[head], start[tail], value[head]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(c) for c in zip(*out))


def repeated_starts(data: np.ndarray, start: np.ndarray, owner: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which of the suffixes at ``start`` have, through WINDOW bytes, an equal with a smaller owner.

    ``group`` is the first digit.  Passes of eight bytes, most significant first; suffixes whose
    group has one owner leave before the next pass.
    """
    hit = np.zeros(len(start), bool)
    at = np.arange(len(start))
    wide = np.lib.stride_tricks.sliding_window_view(data, 8) if len(data) >= 8 else None
    digits = [0] + [d for d in range(0, WINDOW, 8)]
    for n, depth in enumerate(digits):
        if not len(at):
            return hit
        if n == 0:
            key = group[at]
            order = np.argsort(key, kind="stable")
        else:
            begin = min(depth, WINDOW - 8)  # the last digit overlaps the one before
            key = np.ascontiguousarray(wide[start[at] + begin]).view(">u8").ravel().astype(np.uint64)
            order = np.lexsort((key, now))
        at, key = at[order], key[order]
        change = key[1:] != key[:-1]
        if n:
            now = now[order]
            change |= now[1:] != now[:-1]
        head = np.flatnonzero(np.concatenate(([True], change)))
        size = np.diff(np.append(head, len(at)))
        own = owner[at]
        low = np.minimum.reduceat(own, head)
        stay = low != np.maximum.reduceat(own, head)
        keep = np.repeat(stay, size)
        now = np.repeat(np.arange(len(head)), size)[keep]
        at = at[keep]
        low = np.repeat(low, size)[keep]
    hit[at] = owner[at] > low
    return hit


def _ranked(table: pa.Table) -> pa.Table:
    """The rows of a shard in an order that does not depend on their arrival."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _keys(value: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    return ((value >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), (value & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _by(bucket: np.ndarray):
    """(bucket, positions) for each bucket that occurs."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    head = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))) if len(b) else np.zeros(0, np.int64)
    for s, e in zip(head.tolist(), np.append(head[1:], len(b)).tolist()):
        yield int(b[s]), order[s:e]


def _digits_of_shard(table: pa.Table, buckets: int) -> pa.Table:
    """Each distinct first digit of the shard once, with its runs and a flag if two documents of it have it."""
    table = _ranked(table)
    data, off = common.utf8(table.column("text"))
    owner = common.ints(table.column("doc_id"))
    row, _, _, value = runs(data, off)
    order = np.argsort(value, kind="stable")
    value, own = value[order], owner[row[order]]
    head = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1]))) if len(value) else np.zeros(0, np.int64)
    many = np.minimum.reduceat(own, head) != np.maximum.reduceat(own, head) if len(head) else np.zeros(0, bool)
    n_runs = np.minimum(np.diff(np.append(head, len(value))), 0xFFFFFFFF).astype(np.uint32)
    bucket, low = _keys(value[head], buckets)
    shard = table.column("shard")[0].as_py()
    out = [(b, shard, low[p].tobytes(), np.packbits(many[p]).tobytes(), n_runs[p].tobytes()) for b, p in _by(bucket)]
    return pa.table({"bucket": pa.array([x[0] for x in out], pa.int32()), "shard": pa.array([x[1] for x in out], pa.int32()), **{n: pa.array([x[i] for x in out], pa.binary()) for i, n in ((2, "digits"), (3, "many"), (4, "runs"))}})


def depths(n_runs: np.ndarray, hot: int) -> np.ndarray:
    """Digits by which runs are dealt out: 1, from ``hot`` runs 2, then twice as many for STEP times the runs."""
    with np.errstate(divide="ignore"):
        level = np.floor(np.log(np.maximum(n_runs, 1) / hot) / np.log(STEP)) + 1
    return np.where(n_runs >= hot, np.minimum(2.0 ** np.maximum(level, 1), GRAMS), 1).astype(np.uint8)


def _shared_digits(table: pa.Table, hot: int) -> pa.Table:
    """For each shard the first digits of the bucket that occur in two documents or more, and their depths."""
    shards = table.column("shard").to_pylist()
    parts = [np.frombuffer(x, np.uint32) for x in table.column("digits").to_pylist()]
    flags = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)).astype(bool) for x, p in zip(table.column("many").to_pylist(), parts)]
    every, back = np.unique(np.concatenate(parts), return_inverse=True)
    twice = every[np.bincount(back) > 1]
    deep = depths(np.bincount(back, np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("runs").to_pylist()])), hot)
    out = []
    for s, p, f in zip(shards, parts, flags):
        at = np.searchsorted(twice, p)
        both = f | (twice[np.minimum(at, len(twice) - 1)] == p if len(twice) else False)
        if both.any():
            out.append((s, p[both].tobytes(), deep[np.searchsorted(every, p[both])].tobytes()))
    b = table.column("bucket")[0].as_py()
    return pa.table({"shard": pa.array([x[0] for x in out], pa.int32()), "bucket": pa.array([b] * len(out), pa.int32()), "digits": pa.array([x[1] for x in out], pa.binary()), "depths": pa.array([x[2] for x in out], pa.binary())})


_RUNS = "bucket int, shard int, digit binary, owner binary, row binary, first binary, size binary, data binary"


def _run_table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) or [[]] * 8
    kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 6
    return pa.table({n: pa.array(list(c), k) for n, c, k in zip(("bucket", "shard", "digit", "owner", "row", "first", "size", "data"), cols, kinds)})


def split_runs(data: np.ndarray, off: np.ndarray, row: np.ndarray, first: np.ndarray, last: np.ndarray, depth: np.ndarray, step: int = 32_768):
    """(row, first, last, value) of the runs cut where the ``depth`` least hashes of the window change."""
    out = []
    for i, j in _blocks(off):
        mine = np.flatnonzero((row >= i) & (row < j))
        if not len(mine):
            continue
        grams = gram_hashes(data[off[i] : off[j]], SEED_BYTES)
        count = last[mine] - first[mine] + 1
        run = np.repeat(mine, count)
        start = first[run] + np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
        value = np.empty(len(run), np.uint64)
        for a in range(0, len(run), step):
            w = slice(a, a + step)
            least = np.sort(grams[(off[row[run[w]]] - off[i] + start[w])[:, None] + np.arange(GRAMS)], axis=1)
            h, d = least[:, 0].copy(), depth[run[w]]
            for k in range(1, int(d.max())):
                h = np.where(k < d, (h ^ (h >> np.uint64(29))) * _power(1) + least[:, k], h)
            value[w] = h ^ (h >> np.uint64(31))
        head = np.flatnonzero(np.concatenate(([True], (value[1:] != value[:-1]) | (run[1:] != run[:-1]))))
        tail = np.append(head[1:], len(run)) - 1
        out.append((row[run[head]], start[head], start[tail], value[head]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _runs_of_shard(table: pa.Table, replies: pa.Table, buckets: int) -> pa.Table:
    """The shard's runs with a shared first digit: each distinct text once, with its smallest owner.

    Rows that repeat a run of a smaller document of the shard are settled here; they travel as bare
    intervals (no data) to be handed back with the rest.
    """
    if not table.num_rows or not replies.num_rows:
        return _run_table([])
    table = _ranked(table)
    shard = table.column("shard")[0].as_py()
    data, off = common.utf8(table.column("text"))
    owner = common.ints(table.column("doc_id"))
    row, first, last, value = runs(data, off)
    bucket, low = _keys(value, buckets)
    wanted = np.concatenate([np.frombuffer(d, np.uint32).astype(np.uint64) | np.uint64(b) << np.uint64(32) for b, d in zip(replies.column("bucket").to_pylist(), replies.column("digits").to_pylist())])
    depth = np.concatenate([np.frombuffer(d, np.uint8) for d in replies.column("depths").to_pylist()])
    order = np.argsort(wanted)
    wanted, depth = wanted[order], depth[order]
    key = bucket.astype(np.uint64) << np.uint64(32) | low
    at = np.searchsorted(wanted, key)
    hit = wanted[np.minimum(at, len(wanted) - 1)] == key
    row, first, last, bucket, low, deep = row[hit], first[hit], last[hit], bucket[hit], low[hit], depth[at[hit]]
    if (deep > 1).any():
        d, s = np.flatnonzero(deep > 1), np.flatnonzero(deep == 1)
        cut = split_runs(data, off, row[d], first[d], last[d], deep[d])
        row, first, last = (np.concatenate((a[s], b)) for a, b in zip((row, first, last), cut))
        more = _keys(cut[3], buckets)
        bucket, low = np.concatenate((bucket[s], more[0])), np.concatenate((low[s], more[1]))
        order = np.lexsort((first, row))  # the smallest id first, as below
        row, first, last, bucket, low = row[order], first[order], last[order], bucket[order], low[order]
    raw = data.tobytes()
    begin = (off[row] + first).tolist()
    end = (off[row] + last + WINDOW).tolist()
    size = last - first + WINDOW
    least: dict[bytes, int] = {}
    texts = [raw[b:e] for b, e in zip(begin, end)]
    own = owner[row].tolist()
    for t, o in zip(texts, own):  # rows are in the order of their ids: the first is the smallest
        least.setdefault(t, o)
    settled = np.fromiter((least[t] < o for t, o in zip(texts, own)), bool, len(own))
    out = []
    if settled.any():
        s = np.flatnonzero(settled)
        out.append((shard % buckets, shard, b"", b"", row[s].astype(np.int32).tobytes(), first[s].astype(np.int32).tobytes(), size[s].astype(np.int32).tobytes(), b""))
    open_ = np.flatnonzero(~settled)
    for b, p in _by(bucket[open_]):
        p = open_[p]
        out.append((b, shard, low[p].tobytes(), owner[row[p]].tobytes(), row[p].astype(np.int32).tobytes(), first[p].astype(np.int32).tobytes(), size[p].astype(np.int32).tobytes(), b"".join([texts[i] for i in p.tolist()])))
    return _run_table(out)


def _sort_bucket(table: pa.Table) -> pa.Table:
    """Covered intervals (shard, row, first, size) of all runs that met in a bucket."""
    names = ("shard", "digit", "owner", "row", "first", "size", "data")
    rows = list(zip(*[table.column(n).to_pylist() for n in names]))
    out = [(s, r, f, n) for s, d, _, r, f, n, x in rows if not x]
    rows = [r for r in rows if r[6]]
    if rows:
        cat = lambda i, t: np.concatenate([np.frombuffer(r[i], t) for r in rows])
        digit, owner, row, first, size = cat(1, np.uint32), cat(2, np.int64), cat(3, np.int32), cat(4, np.int32), cat(5, np.int32).astype(np.int64)
        shard = np.repeat(np.array([r[0] for r in rows], np.int32), [len(r[1]) // 4 for r in rows])
        raw = b"".join(r[6] for r in rows)
        begin = np.cumsum(size) - size
        # equal runs: all but the smallest owner are covered whole, one stands for the rest
        texts = [raw[b : b + n] for b, n in zip(begin.tolist(), size.tolist())]
        number: dict[bytes, int] = {}
        klass = np.fromiter((number.setdefault(t, len(number)) for t in texts), np.int64, len(texts))
        del texts
        low = np.full(len(number), common.NO_ID, np.int64)
        np.minimum.at(low, klass, owner)
        whole = owner > low[klass]
        rep = np.full(len(number), -1, np.int64)
        smallest = np.flatnonzero(~whole)
        rep[klass[smallest[::-1]]] = smallest[::-1]
        # several rows of the smallest owner may hold the same run: they share the answer
        pair = np.sort(digit[rep].astype(np.uint64))
        crowded = np.unique(pair[1:][pair[1:] == pair[:-1]])  # digits with two different runs
        del number
        k = np.searchsorted(crowded, digit[rep])
        live = rep[crowded[np.minimum(k, len(crowded) - 1)] == digit[rep]] if len(crowded) else rep[:0]
        count = size[live] - WINDOW + 1
        which = np.repeat(np.arange(len(live)), count)
        step = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        hit = repeated_starts(np.frombuffer(raw, np.uint8), begin[live][which] + step, owner[live][which], digit[live][which].astype(np.uint64))
        which, step = which[hit], step[hit]
        head = np.flatnonzero(np.concatenate(([True], (which[1:] != which[:-1]) | (step[1:] != step[:-1] + 1)))) if len(which) else np.zeros(0, np.int64)
        tail = np.append(head[1:], len(which)) - 1 if len(head) else head
        # hand the covered stretches of a representative to all smallest rows of its class
        k_of, lo, n = klass[live[which[head]]], step[head], step[tail] - step[head] + WINDOW
        order = np.argsort(k_of, kind="stable")
        k_of, lo, n = k_of[order], lo[order], n[order]
        left, right = np.searchsorted(k_of, klass[smallest], "left"), np.searchsorted(k_of, klass[smallest], "right")
        m = right - left
        src = np.repeat(smallest, m)
        pick = np.repeat(left, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        full = np.flatnonzero(whole)
        shard_o = np.concatenate((shard[full], shard[src]))
        row_o = np.concatenate((row[full], row[src])).astype(np.int32)
        first_o = np.concatenate((first[full], first[src] + lo[pick])).astype(np.int32)
        size_o = np.concatenate((size[full], n[pick])).astype(np.int32)
        out += [(s, row_o[p].tobytes(), first_o[p].tobytes(), size_o[p].tobytes()) for s, p in _by(shard_o)]
    return pa.table({"shard": pa.array([x[0] for x in out], pa.int32()), **{n: pa.array([x[i] for x in out], pa.binary()) for i, n in ((1, "row"), (2, "first"), (3, "size"))}})


def _valid(raw: bytes, to: np.ndarray) -> bool:
    """Whether every text of ``raw`` is UTF-8: the whole is, and no text begins inside a character."""
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    begin = to[:-1][to[:-1] < len(raw)]
    return not ((np.frombuffer(raw, np.uint8)[begin] & 0xC0) == 0x80).any()


def _cut(table: pa.Table, found: pa.Table, characters: bool = False) -> pa.Table:
    """The shard's rows with their spans, and what is left of each text.

    ``characters``: a character that lost a byte is left out whole, so that its rest does not meet
    the rest of another one, and bytes that never were UTF-8 go too.
    """
    if not table.num_rows:
        return None
    table = _ranked(table)
    data, off = common.utf8(table.column("text"))
    cat = lambda n: np.concatenate([np.frombuffer(x, np.int32) for x in found.column(n).to_pylist()] or [np.zeros(0, np.int32)]).astype(np.int64)
    row, first, size = cat("row"), cat("first"), cat("size")
    order = np.argsort(row, kind="stable")
    row, first, size = row[order], first[order], size[order]
    n_bytes = np.diff(off)
    n_gone, n_spans, n_kept, kept = np.zeros(len(n_bytes), np.int64), np.zeros(len(n_bytes), np.int64), np.zeros(len(n_bytes), np.int64), []
    for i, j in _blocks(off):
        p, o = slice(*np.searchsorted(row, (i, j))), off[i : j + 1] - off[i]
        part = data[off[i] : off[j]]
        begin = o[row[p] - i] + first[p]
        mark = np.zeros(len(part) + 1, np.int32)
        np.add.at(mark, begin, 1)
        np.add.at(mark, begin + size[p], -1)
        gone = np.cumsum(mark[:-1], dtype=np.int32) > 0
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        heads = o[:-1][o[:-1] < len(part)]
        edge[heads] = gone[heads]  # a span ends with its text
        for out, x in ((n_gone, gone), (n_spans, edge)):
            out[i:j] = np.diff(np.concatenate(([0], np.cumsum(x, dtype=np.int32)))[o])
        if characters and len(part):
            first_byte = (part & 0xC0) != 0x80
            first_byte[heads] = True
            at = np.flatnonzero(first_byte)
            gone = np.repeat(np.logical_or.reduceat(gone, at), np.diff(np.append(at, len(part))))
        n_kept[i:j] = np.diff(np.concatenate(([0], np.cumsum(~gone, dtype=np.int32)))[o])
        kept.append(part[~gone].tobytes())
    raw, to = b"".join(kept), np.concatenate(([0], np.cumsum(n_kept)))
    if characters and not _valid(raw, to):
        texts = [raw[a:b].decode("utf-8", "ignore").encode() for a, b in zip(to[:-1].tolist(), to[1:].tolist())]
        raw, to = b"".join(texts), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    left = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n_bytes), [None, pa.py_buffer(to.astype(np.int64).tobytes()), pa.py_buffer(raw)]).cast(pa.binary())
    extra = {"n_bytes": pa.array(n_bytes), "n_removed": pa.array(n_gone), "n_spans": pa.array(n_spans), "kept": left}
    for n, c in extra.items():
        table = table.append_column(n, c)
    return table


def remove_repeats(docs: DataFrame, characters: bool = False, hot_runs: int = HOT_RUNS) -> DataFrame:
    """Per row of ``docs``: doc_id, text, its other columns as c0, c1, ..., n_bytes, n_removed, n_spans, kept.

    ``kept`` (binary) is the UTF-8 text without every byte that some WINDOW-byte string covers which
    also starts in a document with a smaller doc_id; all strings are judged on the input.  Null
    texts are empty.  Rows with the same id are never smaller than each other; rows without an id
    count as larger than all others and equal to one another.  Texts under WINDOW bytes are kept
    whole, very long ones are one shard's work with memory in proportion.  Empty tables give no rows.  With ``characters`` what is left of a character that lost a
    byte is not in ``kept`` either, nor what was no UTF-8 before; the counts stay those of the windows.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    keyed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *[common.of(docs, c).alias(f"c{i}") for i, c in enumerate(others)])
    n = common.parallelism(common.text_bytes(docs), docs.sparkSession)
    mixed = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    shards = keyed.withColumn("shard", common.shard_of(mixed, n)).repartition(n, "shard")
    digits = shards.groupBy("shard").applyInArrow(common.tidy_group(lambda t: _digits_of_shard(t, n)), "bucket int, shard int, digits binary, many binary, runs binary")
    shared = digits.repartitionById(n, "bucket").mapInArrow(common.whole_partition(lambda t: _shared_digits(t, hot_runs)), "shard int, bucket int, digits binary, depths binary")
    found = shards.groupBy("shard").cogroup(shared.groupBy("shard")).applyInArrow(common.tidy_pair(lambda a, b: _runs_of_shard(a, b, n)), _RUNS)
    covered = found.repartitionById(n, "bucket").mapInArrow(common.whole_partition(_sort_bucket), "shard int, row binary, first binary, size binary")
    fields = common.with_fields(shards.schema, "n_bytes long, n_removed long, n_spans long, kept binary")
    out = shards.groupBy("shard").cogroup(covered.groupBy("shard")).applyInArrow(common.tidy_pair(lambda a, b: _cut(a, b, characters)), fields)
    return out.drop("shard")


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text``; what is left of a broken character goes too.

    All rows stay, with all their columns; a text that repeats earlier documents throughout becomes
    empty, a null text too.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = remove_repeats(docs, characters=True)
    back = {"doc_id": F.col("doc_id"), "text": F.col("kept").cast("string")} | {c: F.col(f"c{i}") for i, c in enumerate(others)}
    return out.select(*[back[c].alias(c) for c in docs.columns])


ORACLE_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, 9223372036854775807) AS place, hex(encode(coalesce(text, ''))) AS h FROM documents
), chunks AS (
  SELECT rid, place, a, substr(h, 2 * a + 1, 598) AS c FROM (SELECT rid, place, h, unnest(range(0, len(h) // 2, 250)) AS a FROM d)
), starts AS (
  SELECT rid, place, a + i AS p, substr(c, 2 * i + 1, 100) AS w FROM (SELECT rid, place, a, c, unnest(range(0, least(250, len(c) // 2 - 49))) AS i FROM chunks WHERE len(c) >= 100)
), firsts AS (
  SELECT w, min(place) AS first FROM starts GROUP BY w HAVING min(place) < max(place)
), again AS (
  SELECT rid, p FROM starts JOIN firsts USING (w) WHERE place > first
), heads AS (
  SELECT rid, p, coalesce(p > lag(p) OVER (PARTITION BY rid ORDER BY p) + 50, true) AS head FROM again
), spans AS (
  SELECT rid, min(p) AS s, max(p) + 50 AS e FROM (SELECT rid, p, count(*) FILTER (head) OVER (PARTITION BY rid ORDER BY p) AS k FROM heads) GROUP BY rid, k
), cuts AS (
  SELECT rid, s, e, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY s), 0) AS b FROM spans
), kept AS (
  SELECT rid, count(*) AS n_spans, sum(e - s) AS n_removed, string_agg(substr(h, 2 * b + 1, 2 * (s - b)), '' ORDER BY s) || substr(any_value(h), 2 * max(e) + 1) AS k FROM cuts JOIN d USING (rid) GROUP BY rid
)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""
