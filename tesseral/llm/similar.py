"""Near-copies at a stated shingle similarity: SimHash fingerprints, BK-trees, exact confirmation.

A fixed similarity of shingle sets leaves the Hamming distance of 64-bit fingerprints widely spread
(0.8 gives about 10 bits, give or take 3), too far for tables of equal bits.  So the shards are made
of texts that agree on least shingle hashes: each text goes to ``BANDS`` shards, one for each
``ROWS`` of its least hashes.  In a shard a BK-tree over the fingerprints finds what lies within
``RADIUS``; sizes and sketches of least hashes thin that out, and what is left links candidates.
Texts of one candidate component then meet once, and only pairs whose shingle sets have the stated
Jaccard similarity are linked.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .simhash import BROADCAST_ROWS, TREE_NODES, BKTree, _join_labels, dealt, fold, in_pairs, shingle_hashes

WORDS, SIMILARITY = 5, 0.8
#: At the stated similarity 9.7 bits differ on average; more than these with a chance of 3e-6.
RADIUS = 24
BANDS, ROWS = 12, 3
#: Least hashes in a sketch (one byte each of which is compared), and how many must agree.  At the
#: stated similarity 38 of 48 do, and under 25 with a chance of 3e-6.
SKETCH, LEAST_EQUAL = 48, 25
#: Text bytes of one candidate component that one task confirms; larger ones are dealt out in chunks.
CHUNK_BYTES = 3 << 20
_R = np.random.default_rng(64)
_ODD = _R.integers(0, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _R.integers(0, 1 << 63, SKETCH, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SKETCHES = "doc_id long, node long, size long, fp long, n int, sig binary, keys array<long>"


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes; wordless texts share the one hash zero."""
    h = shingle_hashes(text, words)
    return np.unique(h) if len(h) else np.zeros(1, np.uint64)


def sketch(text: bytes, words: int) -> tuple[int, int, bytes, np.ndarray]:
    """(fingerprint, distinct shingles, sketch, shard keys)."""
    h = shingle_set(text, words)  # what confirm() compares: repeats move no bit
    print_ = fold(h)
    least = np.full(SKETCH, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(h), 4096):
        least = np.minimum(least, ((h[None, i : i + 4096] ^ _FLIP[:, None]) * _ODD[:, None]).min(1))
    mixed = least * _MIX
    rows = mixed[: BANDS * ROWS].reshape(BANDS, ROWS)
    key = rows[:, 0]
    for k in range(1, ROWS):
        key = (key ^ (key >> np.uint64(29))) * _MIX + rows[:, k]
    return print_, len(h), (mixed >> np.uint64(56)).astype(np.uint8).tobytes(), key.view(np.int64)


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """_SKETCHES rows of every whole text; ``node`` is the text's hash, so exact copies share it."""

    def run(batches):
        for whole in batches:
            for b in common.pieces(whole):
                found = [sketch(t, words) for t in common.blobs(b.column("text"))]
                fp, n, sig, keys = zip(*found)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * BANDS, pa.int32()), pa.array(np.concatenate(keys)))
                cols = [b.column("doc_id"), b.column("node"), b.column("size"), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(n, pa.int32()), pa.array(sig, pa.binary()), lists]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "node", "size", "fp", "n", "sig", "keys"])

    base = docs.select(*common.doc_columns(docs, "doc_id"))
    base = base.select("doc_id", node_of(F.col("text")).alias("node"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"), "text")
    return base.mapInArrow(common.tidy(run), _SKETCHES)


def node_of(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def link_candidates(fp: np.ndarray, n: np.ndarray, sig: np.ndarray, own: np.ndarray | None, similarity: float, radius: int, step: int = 128):
    """(a, b): links that span the candidate classes of one cell, at most one for each row.

    ``own`` None: all rows against each other; else the rows of the lower chunk against the others.
    """
    tree_rows = np.arange(len(fp)) if own is None else np.flatnonzero(own == own.min())
    query_rows = tree_rows if own is None else np.flatnonzero(own != own.min())
    tree, label = BKTree(fp[tree_rows]), np.arange(len(fp))
    for i in range(0, len(query_rows), step):
        q, t = tree.search(fp[query_rows[i : i + step]], radius)
        a, b = query_rows[q + i], tree_rows[t]
        keep = (label[a] != label[b]) & (np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b]) - 1e-9)
        a, b = a[keep], b[keep]
        keep = np.concatenate([(sig[a[k : k + 65536]] == sig[b[k : k + 65536]]).sum(1) >= LEAST_EQUAL for k in range(0, len(a), 65536)] or [np.zeros(0, bool)])
        _join_labels(label, a[keep], b[keep])
    moved = np.flatnonzero(label != np.arange(len(label)))
    return moved, label[moved]


def _candidates(batches, similarity: float, radius: int):
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    table = pa.Table.from_batches(got)
    t, v, lo, hi, own, node, fp, n = (common.ints(table.column(c)) for c in ("t", "v", "lo", "hi", "own", "node", "fp", "n"))
    sig = common.utf8(table.column("sig"))[0].reshape(-1, SKETCH)
    del got, table
    order = np.lexsort((node, hi, lo, v, t))
    t, v, lo, hi, own, node, n, sig = (x[order] for x in (t, v, lo, hi, own, node, n, sig))
    fp = fp[order].view(np.uint64)
    new = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (v[1:] != v[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))))
    size = np.diff(np.append(new, len(fp)))
    two = new[(size == 2) & (lo[new] == hi[new])]  # a tree of two nodes is one distance
    near = (np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius) & (np.minimum(n[two], n[two + 1]) >= similarity * np.maximum(n[two], n[two + 1]) - 1e-9)
    two = two[near]
    two = two[(sig[two] == sig[two + 1]).sum(1) >= LEAST_EQUAL]
    out_a, out_b = [node[two + 1]], [node[two]]
    more = (size > 2) | ((size > 1) & (lo[new] != hi[new]))
    for s, k in zip(new[more].tolist(), size[more].tolist()):
        w = slice(s, s + k)
        if lo[s] != hi[s] and (own[w] == own[s]).all():
            continue
        a, b = link_candidates(fp[w], n[w], sig[w], None if lo[s] == hi[s] else own[w], similarity, radius)
        out_a.append(node[w][a])
        out_b.append(node[w][b])
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    pairs = np.unique(np.stack((np.maximum(a, b), np.minimum(a, b)), 1), axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])


def confirm(table: pa.Table, words: int, similarity: float) -> pa.Table:
    """Links of exact similarity that span the classes of one cell of a candidate component."""
    node, first = np.unique(common.ints(table.column("node")), return_index=True)
    own = common.ints(table.column("own"))[first]
    across = table.column("lo")[0].as_py() != table.column("hi")[0].as_py()
    sets = [shingle_set(t, words) for t in common.blobs(table.column("text").combine_chunks().take(pa.array(first)))]
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    start = np.cumsum(n) - n
    mark, label = np.zeros(int(flat.max()) + 1, bool), np.arange(len(n))
    for i in range(len(n)):
        open_ = (label != label[i]) & (np.minimum(n, n[i]) >= similarity * np.maximum(n, n[i]) - 1e-9)
        open_[: i + 1] = False
        if across:
            open_ &= own != own[i]
        if open_.any():
            mine = flat[start[i] : start[i] + n[i]]
            mark[mine] = True
            both = np.add.reduceat(mark[flat], start, dtype=np.int64)
            mark[mine] = False
            hit = np.flatnonzero(open_ & (both >= similarity * (n + n[i] - both) - 1e-9))
            _join_labels(label, np.full(len(hit), i), hit)
    moved = np.flatnonzero(label != np.arange(len(label)))
    return pa.table({"u": pa.array(np.maximum(node[moved], node[label[moved]]), pa.int64()), "v": pa.array(np.minimum(node[moved], node[label[moved]]), pa.int64())})


def groups(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(node, root, least): a row for each distinct text, its group and the smallest doc_id that has it."""
    prints = sketches(docs, words).groupBy("node").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("size", "fp", "n", "sig", "keys")])
    distinct = common.materialise(prints, "sketches")
    partitions = common.parallelism(2000 * distinct.count(), docs.sparkSession)
    rows = distinct.select("node", "fp", "n", "sig", F.posexplode("keys").alias("t", "v")).withColumn("t", F.col("t").cast("long"))
    cells = dealt(rows, "node").repartition(partitions, "t", "v", "lo", "hi").select("t", "v", "lo", "hi", "own", "node", "fp", "n", "sig")
    root = components(cells.mapInArrow(common.tidy(lambda it: _candidates(it, similarity, radius)), "u long, v long"))
    members = root.unionByName(root.select(F.col("root").alias("node"), "root").distinct())
    known = members.join(distinct.select("node", "least", "size"), "node")
    wide = known.groupBy("root").agg(F.greatest(F.ceil(F.sum("size") / CHUNK_BYTES), F.ceil(F.count("*") / TREE_NODES)).alias("chunks")).where("chunks > 1")
    wide = common.materialise(wide, "wide")
    known = known.join(F.broadcast(wide) if wide.count() <= BROADCAST_ROWS else wide, "root", "left")
    known = common.materialise(known.select(F.col("node").alias("k_node"), "least", "root", F.coalesce("chunks", F.lit(1).cast("long")).alias("chunks")), "members")
    small = known.count() <= BROADCAST_ROWS
    texts = docs.select(*common.doc_columns(docs, "doc_id"))
    texts = texts.join(F.broadcast(known) if small else known, texts["doc_id"].eqNullSafe(known["least"]) & (node_of(texts["text"]) == known["k_node"]))
    pairs = in_pairs(texts.select(F.col("k_node").alias("node"), "root", "chunks", "text"), "node", ["root", "node", "text"])
    links = pairs.groupBy("root", "lo", "hi").applyInArrow(lambda t: confirm(t, words, similarity), "u long, v long")
    final = components(links)
    return distinct.select("node", "least").join(final, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")


def keep_one(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` without all but one of each group of near-copies.

    Two texts are linked if the sets of their ``words``-word shingles (A-Z lower-cased; fewer words:
    the whole sequence) have a Jaccard similarity of ``similarity`` or more; groups are what links
    connect.  The row with the smallest doc_id stays, once if it is repeated; a group without any id
    keeps one row of its smallest text hash.  Null texts are empty, and all wordless texts are copies
    of each other.  All columns stay; an empty table gives no rows.
    """
    best = groups(docs, words, similarity, radius).groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "node")).alias("b"))
    # no id counts as the least long: a row with that id and the same text is a copy of one without id
    none = F.lit(-(1 << 63))
    stay = best.select(F.coalesce("b.least", none).alias("kept_id"), F.col("b.node").alias("kept_node"))
    names = docs.columns
    inner = docs.select(*[common.of(docs, c).alias(f"c{i}") for i, c in enumerate(names)])
    key, text = inner[f"c{names.index('doc_id')}"].cast("long"), inner[f"c{names.index('text')}"].cast("string")
    inner = inner.withColumn("id_", F.coalesce(key, none)).withColumn("node_", node_of(text))
    # the join's own partitioning serves the removal of repeated rows too
    left = inner.join(stay, (inner["id_"] == stay["kept_id"]) & (inner["node_"] == stay["kept_node"]), "left_semi").dropDuplicates(["id_", "node_"])
    return left.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
