"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters run over overlapping chunks that cover the whole document, each
filter is max-pooled over its chunk, and the chunk vectors' maximum and mean over the document go
through one logistic unit.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CHUNK, OVERLAP = 512, 32
EMBED, WIDTH, STRIDE, FILTERS = 8, 8, 2, 24
PAD = 256
#: Labelled rows that are fitted at most, those with the smallest hashed ids, and the bytes of their whole
#: texts: rows that no longer fit are left out.
MAX_LABELLED, MAX_LABELLED_BYTES = 4000, 64 << 20
#: Texts of one step, fewer if they have more chunks; chunks that are convolved together.
EPOCHS, BATCH, BATCH_CHUNKS, BLOCK, RATE = 6, 64, 1024, 64, 0.004
THRESHOLD = 0.7
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
_PLACES = (CHUNK - WIDTH) // STRIDE + 1


def chunk_counts(lengths: np.ndarray) -> np.ndarray:
    """Chunks that cover texts of so many bytes; an empty text has one, all padding."""
    return np.maximum(1, -(-(lengths - OVERLAP) // (CHUNK - OVERLAP)))


def chunk_matrix(data: np.ndarray, off: np.ndarray, text: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Byte values of chunk index[i] of text text[i], padded with PAD."""
    begin = off[text] + index * (CHUNK - OVERLAP)
    size = np.minimum(off[text + 1] - begin, CHUNK)
    at = begin[:, None] + np.arange(CHUNK)
    live = np.arange(CHUNK) < size[:, None]
    out = np.full(at.shape, PAD, np.int16)
    out[live] = data[at[live]]
    return out


class ByteCNN:
    def __init__(self, parts: dict[str, np.ndarray]):
        self.p = parts

    @classmethod
    def start(cls, seed: int = 3) -> "ByteCNN":
        r = np.random.default_rng(seed)
        f = lambda *s, d=1.0: r.normal(0, d, s).astype(np.float32)
        return cls({"emb": f(PAD + 1, EMBED, d=0.5), "w": f(WIDTH * EMBED, FILTERS, d=0.25), "b": np.zeros(FILTERS, np.float32), "out": f(2 * FILTERS, d=0.1), "bias": np.zeros(1, np.float32)})

    def pooled(self, chunks: np.ndarray, places: bool = False):
        """(chunks, FILTERS) after rectifier and max-pool; on request also the winning places."""
        e = self.p["emb"][chunks].reshape(len(chunks), -1)
        s = e.strides
        patches = np.lib.stride_tricks.as_strided(e, (len(chunks), _PLACES, WIDTH * EMBED), (s[0], STRIDE * EMBED * s[1], s[1]))
        a = (np.ascontiguousarray(patches).reshape(-1, WIDTH * EMBED) @ self.p["w"]).reshape(len(chunks), _PLACES, FILTERS)
        top = np.maximum(a.max(1) + self.p["b"], 0)
        return (top, a.argmax(1), patches) if places else top

    def logits(self, top: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = np.diff(np.append(first, len(top)))
        x = np.concatenate((np.maximum.reduceat(top, first), np.add.reduceat(top, first) / count[:, None]), 1)
        return x, x @ self.p["out"] + self.p["bias"]

    def score(self, data: np.ndarray, off: np.ndarray, step: int = BLOCK) -> np.ndarray:
        """Probability of label 1 for each whole text."""
        count = chunk_counts(np.diff(off))
        first = np.cumsum(count) - count
        text = np.repeat(np.arange(len(count)), count)
        index = np.arange(len(text)) - first[text]
        top = np.empty((len(text), FILTERS), np.float32)
        for i in range(0, len(text), step):
            w = slice(i, i + step)
            top[w] = self.pooled(chunk_matrix(data, off, text[w], index[w]))
        _, z = self.logits(top, first)
        return 1 / (1 + np.exp(-z.astype(np.float64)))

    def gradient(self, chunks: np.ndarray, first: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        parts = []
        for i in range(0, len(chunks), BLOCK):  # of the patches only the winning ones stay
            t, p, patches = self.pooled(chunks[i : i + BLOCK], places=True)
            parts.append((t, p, patches[np.arange(len(t))[:, None], p]))
        top, place, won = (np.concatenate(c) for c in zip(*parts))  # won: chunks, filters, width * embed
        x, z = self.logits(top, first)
        count = np.diff(np.append(first, len(top)))
        d = ((1 / (1 + np.exp(-z)) - label) / len(label)).astype(np.float32)
        g = {"out": x.T @ d, "bias": d.sum(keepdims=True)}
        dx = d[:, None] * self.p["out"]
        of = np.repeat(np.arange(len(first)), count)
        best = top == x[:, :FILTERS][of]
        dtop = np.where(best, dx[:, :FILTERS][of], 0) + dx[:, FILTERS:][of] / count[of][:, None]
        dtop = (dtop * (top > 0)).astype(np.float32)
        g["b"] = dtop.sum(0)
        g["w"] = np.einsum("cfk,cf->kf", won, dtop)
        dpatch = dtop[:, :, None] * self.p["w"].T[None]
        at = place[:, :, None] * STRIDE + np.arange(WIDTH)
        byte = chunks[np.arange(len(chunks))[:, None, None], at]
        g["emb"] = np.zeros_like(self.p["emb"])
        np.add.at(g["emb"], byte.ravel(), dpatch.reshape(-1, EMBED))
        return g


def steps(order: np.ndarray, count: np.ndarray):
    """Texts in turn, BATCH of them at most and BATCH_CHUNKS chunks, or one text with more."""
    pick: list[int] = []
    for k in order.tolist():
        if pick and (len(pick) == BATCH or count[pick].sum() + count[k] > BATCH_CHUNKS):
            yield np.array(pick)
            pick = []
        pick.append(k)
    if pick:
        yield np.array(pick)


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> ByteCNN:
    """Adam on the log loss over all chunks of all ``texts``.  No texts: the start network."""
    net, r = ByteCNN.start(seed), np.random.default_rng(seed)
    if not len(labels):
        return net
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    p = np.clip(labels.mean(), 0.01, 0.99)
    net.p["bias"][:] = np.log(p / (1 - p))
    t, chunks = 0, chunk_counts(np.array([len(x) for x in texts]))
    for _ in range(epochs):
        for pick in steps(r.permutation(len(labels)), chunks):
            count = chunks[pick]
            first = np.cumsum(count) - count
            text = np.repeat(np.arange(len(pick)), count)
            off = np.cumsum([0] + [len(texts[k]) for k in pick])
            data = np.frombuffer(b"".join([texts[k] for k in pick]), np.uint8)
            g = net.gradient(chunk_matrix(data, off, text, np.arange(len(text)) - first[text]), first, labels[pick].astype(np.float32))
            t += 1
            for k, v in net.p.items():
                m[k] += 0.1 * (g[k] - m[k])
                s[k] += 0.01 * (g[k] ** 2 - s[k])
                v -= RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-7)
    return net


def held_out_column(doc_id, modulus: int = 4, remainder: int = 2):
    """crc32 of the id as text, mod 4, is 2; rows without an id are not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(modulus)) == remainder, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_bytes: int = MAX_LABELLED_BYTES) -> ByteCNN:
    """A network fitted to the whole texts of at most ``max_labelled`` labelled rows that are not held out.

    Their texts come to the driver, ``max_bytes`` at most: in the order of hashed ids, a row that no longer
    fits is left out.  Conflicting labels of one id: the lowest; of several texts of one id: the least; labels
    other than 0 and 1 and rows with nulls are left out.  Empty tables give the start network.
    """
    chosen = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality")).dropna().where("quality in (0, 1)")
    chosen = chosen.where(~held_out_column(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    known = docs.select(*common.doc_columns(docs, "doc_id")).join(F.broadcast(chosen), "doc_id").withColumn("text", F.coalesce("text", F.lit("")))
    sizes = known.groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    ids, room = [], max_bytes
    for r in sizes:
        if r["n"] <= room:
            ids.append((r["doc_id"],))
            room -= r["n"]
    fits = F.broadcast(docs.sparkSession.createDataFrame(ids, "doc_id long"))
    rows = known.join(fits, "doc_id", "left_semi").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()
    rows = sorted((r["doc_id"], r["quality"], r["text"].encode()) for r in rows)
    return fit([t for _, _, t in rows], np.array([q for _, q, _ in rows], np.float32))


def score(docs: DataFrame, net: ByteCNN) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; whole texts, one narrow pass.

    Null texts are empty; an empty text is one chunk of padding and gets a score too.  A very long text is
    covered by as many chunks as it takes, convolved in blocks.  Repeated rows are scored alike; an empty
    table gives no rows; only doc_id and text are read.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(net.p)
    base = docs.select(*common.doc_columns(docs, "doc_id"))
    base = base.select("doc_id", held_out_column(F.col("doc_id")).alias("held_out"), "text")

    def run(batches):
        model = ByteCNN(sent.value)
        for whole in batches:
            for b in common.pieces(whole, 8 << 20):
                p = model.score(*common.utf8(b.column("text")))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return base.mapInArrow(common.tidy(run), SCHEMA)
