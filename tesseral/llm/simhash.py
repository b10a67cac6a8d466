"""Near-duplicates by SimHash: fingerprints, BK-trees in shards, connected components.

Two fingerprints within ``radius`` bits agree on at least ``blocks - radius`` of ``blocks`` blocks
of their bits, so each choice of that many blocks is a table of shards in which such a pair meets
at least once.  A shard becomes a BK-tree (children keyed by their distance to the parent) and is
searched along the edges that the triangle inequality leaves open.  A shard over ``TREE_NODES`` is
dealt out in chunks: each pair of chunks is a cell of its own with one chunk's tree and the
other's queries, so no task ever holds more than two chunks of a crowded shard.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

WORDS = 4
RADIUS = 4
BITS = 64
SEED = 42
#: Nodes of one tree at most; larger shards are dealt out in chunks of about this size.
TREE_NODES = 2048
#: Crowded shards up to which their list (24 bytes each) is broadcast; beyond, it is shuffled.
BROADCAST_ROWS = 100_000


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """XXH64 of each A-Z-lower-cased word shingle, repeats included; fewer words: the whole sequence."""
    w = text.lower().split()  # of bytes: ASCII rules only
    if not w:
        return np.zeros(0, np.uint64)
    joined = b" ".join(w)
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hash_of = xxhash.xxh64_digest
    n = len(w) - words + 1
    packed = b"".join([hash_of(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist())])
    return np.frombuffer(packed, ">u8").astype(np.uint64)


def fold(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; none: zero."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = np.ascontiguousarray(hashes[i : i + (1 << 15)].astype(">u8")).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """SimHash of A-Z-lower-cased word shingles; no words: zero."""
    return fold(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp) of every whole text, fp as a signed long; null texts have fp 0.  One narrow pass."""

    def run(batches):
        for whole in batches:
            for b in common.pieces(whole):
                fps = np.array([fingerprint(t, words) for t in common.blobs(b.column(1))], np.uint64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(*common.doc_columns(docs, "doc_id")).mapInArrow(common.tidy(run), "doc_id long, fp long")


class BKTree:
    """BK-tree over uint64 fingerprints as flat arrays; nodes are numbered in the input's order."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps
        n = len(fps)
        self.edge = np.zeros(n, np.int64)
        kids: list[tuple[int, list[int]]] = []
        stack = [np.arange(n)] if n else []
        while stack:
            group = stack.pop()
            root, rest = group[0], group[1:]
            if not len(rest):
                continue
            d = np.bitwise_count(fps[rest] ^ fps[root]).astype(np.int64)
            order = np.argsort(d, kind="stable")
            rest, d = rest[order], d[order]
            parts = np.split(rest, np.flatnonzero(d[1:] != d[:-1]) + 1)
            self.edge[[p[0] for p in parts]] = np.unique(d)
            kids.append((int(root), [int(p[0]) for p in parts]))
            stack += parts
        count = np.zeros(n, np.int64)
        for r, k in kids:
            count[r] = len(k)
        self.start = np.concatenate(([0], np.cumsum(count)))
        self.kids = np.zeros(self.start[-1], np.int64)
        for r, k in kids:
            self.kids[self.start[r] : self.start[r + 1]] = k
        self.count = count

    def search(self, queries: np.ndarray, radius: int):
        """(query number, node number) of all pairs within ``radius``, all queries level by level."""
        found_q, found_n = [], []
        q, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        if not len(self.fps):
            q = node = np.zeros(0, np.int64)
        while len(q):
            d = np.bitwise_count(queries[q] ^ self.fps[node]).astype(np.int64)
            near = d <= radius
            found_q.append(q[near])
            found_n.append(node[near])
            c = self.count[node]
            total = int(c.sum())
            if not total:
                break
            offset = np.arange(total) - np.repeat(np.cumsum(c) - c, c)
            child = self.kids[np.repeat(self.start[node], c) + offset]
            q, d = np.repeat(q, c), np.repeat(d, c)
            follow = np.abs(self.edge[child] - d) <= radius
            q, node = q[follow], child[follow]
        if not found_q:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found_q), np.concatenate(found_n)


def _join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite the classes of a[i] and b[i]: labels point to the least member, in place."""
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def link_cell(tree_side: np.ndarray, query_side: np.ndarray | None, radius: int, step: int = 256):
    """Links that span the classes of one cell: at most one for each fingerprint, never all pairs."""
    tree = BKTree(tree_side)
    everything = tree_side if query_side is None else np.concatenate((tree_side, query_side))
    shift = 0 if query_side is None else len(tree_side)
    queries = tree_side if query_side is None else query_side
    label = np.arange(len(everything))
    for i in range(0, len(queries), step):
        q, n = tree.search(queries[i : i + step], radius)
        _join_labels(label, q + i + shift, n)
    moved = np.flatnonzero(label != np.arange(len(label)))
    return everything[moved], everything[label[moved]]


def masks(radius: int, distinct: int) -> list[int]:
    """Bit masks of the tables: more blocks where there are more fingerprints, so shards stay small."""
    spare = 2
    while True:
        blocks = radius + spare
        share = 2.0 ** (BITS * spare / blocks)
        if distinct / share < 512 or spare >= 4:
            break
        spare += 1
    cuts = np.linspace(0, BITS, blocks + 1).round().astype(int)
    part = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(part, spare)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _link_partition(batches, radius: int):
    cols = [[], [], [], [], [], []]
    for b in batches:
        for c, x in zip(cols, b.columns):
            c.append(common.ints(x))
    if not cols[0]:
        return
    t, v, lo, hi, own, fp = map(np.concatenate, cols)
    order = np.lexsort((fp, hi, lo, v, t))
    t, v, lo, hi, own, fp = (x[order] for x in (t, v, lo, hi, own, fp))
    new = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (v[1:] != v[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))))
    size = np.diff(np.append(new, len(fp)))
    u = fp.view(np.uint64)
    out_a, out_b = [], []
    two = new[(size == 2) & (lo[new] == hi[new])]  # a tree of two nodes is one distance
    near = np.bitwise_count(u[two] ^ u[two + 1]) <= radius
    out_a.append(fp[two[near] + 1])
    out_b.append(fp[two[near]])
    for s, n in zip(new[(size > 2) | ((size > 1) & (lo[new] != hi[new]))].tolist(), size[(size > 2) | ((size > 1) & (lo[new] != hi[new]))].tolist()):
        g, side = u[s : s + n], own[s : s + n]
        if lo[s] == hi[s]:
            a, b = link_cell(g, None, radius)
        else:
            a, b = link_cell(g[side == lo[s]], g[side == hi[s]], radius)
        out_a.append(a.view(np.int64))
        out_b.append(b.view(np.int64))
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    pairs = np.unique(np.stack((np.maximum(a, b), np.minimum(a, b)), 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])


def dealt(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` (t, v: the shard) with own, lo and hi: the row's chunk and the pair of chunks it goes to.

    Shards of up to TREE_NODES rows have one chunk; a larger one has a cell for each pair of its chunks.
    """
    names = rows.columns
    crowded = rows.groupBy("t", "v").agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > TREE_NODES)
    crowded = common.materialise(crowded.select("t", "v", F.ceil(F.col("n_rows") / TREE_NODES).alias("chunks")), "crowded")
    n_crowded = crowded.count()
    zero = F.lit(0).cast("long")
    if not n_crowded:
        return rows.select(*names, zero.alias("own"), zero.alias("lo"), zero.alias("hi"))
    rows = rows.join(F.broadcast(crowded) if n_crowded <= BROADCAST_ROWS else crowded, ["t", "v"], "left")
    return in_pairs(rows.withColumn("chunks", F.coalesce("chunks", F.lit(1).cast("long"))), by, names)


def in_pairs(rows: DataFrame, by: str, names: list[str]) -> DataFrame:
    """A row for each pair of chunks that the row's own chunk (of ``chunks``, by its hashed ``by``) is in."""
    rows = rows.withColumn("own", F.pmod(F.xxhash64(by), F.col("chunks")))
    rows = rows.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    return rows.select(*names, "own", F.least("own", "x").alias("lo"), F.greatest("own", "x").alias("hi"))


def links(distinct: DataFrame, radius: int, partitions: int) -> DataFrame:
    """(u, v): links between the fingerprints of ``distinct`` (column fp) that span all their classes.

    Every class of fingerprints connected at ``radius`` is connected by these links; pairs inside a
    class that other links already connect may be left out.
    """
    if not 0 <= radius <= 8:
        raise ValueError("radius must be 0 to 8")
    tables = masks(radius, distinct.count())
    cells = [F.struct(F.lit(i).cast("long").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v")) for i, m in enumerate(tables)]
    rows = distinct.select("fp", F.inline(F.array(*cells)))
    rows = dealt(rows, "fp")
    return rows.repartition(partitions, "t", "v", "lo", "hi").select("t", "v", "lo", "hi", "own", "fp").mapInArrow(common.tidy(lambda it: _link_partition(it, radius)), "u long, v long")


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links of at most ``radius`` differing
    bits, the row itself included.  Null and empty texts have fingerprint zero and link like any
    other.  Repeated rows have equal fingerprints and so share a component; rows with a null id take
    part and get the least id of their component, null only if it has none.  Only doc_id and text
    are read.  An empty table gives no rows.  Exact copies collapse before any search.
    """
    prints = common.materialise(fingerprints(docs, words), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    partitions = common.parallelism(64 * prints.count(), docs.sparkSession, 1 << 20)
    root = components(links(prints.select("fp").distinct(), radius, partitions))
    # only fingerprints that have a link need the second step
    named = distinct.join(root.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    # written, so that a crowded root can be split: a side that ends in an aggregate could not
    best = common.materialise(named.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    of = named.join(best, "root").select("fp", "component_id")
    out = prints.join(of, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` without all but the first (smallest doc_id) of each component.

    Rows that repeat the surviving id are one document and stay once.  Rows without an id stay only
    where their component has no id at all, once.
    """
    found = near_duplicates(docs, words, radius)
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    names = docs.columns
    inner = docs.select(*[common.of(docs, c).alias(f"c{i}") for i, c in enumerate(names)])
    key = f"c{names.index('doc_id')}"
    left = inner.join(stay, inner[key].cast("long").eqNullSafe(stay["kept_id"]), "left_semi").dropDuplicates([key])
    return left.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
