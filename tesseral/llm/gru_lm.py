"""Language-model scores: a gated recurrent unit with a class-factored softmax, in numpy.

One narrow pass turns whole documents into chunks of token numbers, written once; later passes read
those and never split a text again, and no text is shuffled.  A chunk tells the buckets that own its
distinct tokens how often it has them and gets the corpus counts of those tokens back, so no
vocabulary is broadcast.  A chunk has at most one message for each of its distinct tokens, so the
messages grow with the input however many buckets there are.

The softmax is factored by classes, and every word of the corpus is in one.  The ``HEAD`` most frequent
words are in classes of equal size by rank and have weights of their own; the others are in ``TAIL``
classes by their last two bytes, and a class shares its probability out by counts.  Gates and candidate are
softsigns, x / (1 + abs(x)), which numpy has at a tenth of the cost of tanh.

The network learns from every training token once, by truncated backpropagation: the training
documents of a chunk are dealt to rounds, a task goes through its chunks one after the other,
and an average over the tasks follows each round.  Scoring packs whole documents into lanes and
carries the state through each whole document.
"""
from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter, defaultdict
from itertools import chain, count, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Classes of frequent words, words in each, and classes of all other words.
HEAD_CLASSES, CLASS_SIZE, TAIL = 16, 32, 16
HEAD, CLASSES = HEAD_CLASSES * CLASS_SIZE, HEAD_CLASSES + TAIL
#: Inputs: a word of its own, a tail class, or the start of a document.
START = HEAD + TAIL
HIDDEN, EMBED = 16, 8
#: Parts of each chunk's training documents, with an average over the tasks after each.
ROUNDS = 3
TRAIN_LANES, TRAIN_WINDOW = 512, 16
SCORE_LANES = 512
#: States whose softmax is computed together.
SOFTMAX_ROWS = 2048
RATE = 0.02
#: Text bytes of one chunk, unless one document has more.
CHUNK_BYTES = 6 << 20
#: Bytes of a row group where a row may have megabytes.
ROW_GROUP = 16 << 20
END = b""
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_CHUNKS = "kind int, chunk long, bucket int, tokens binary, counts binary, tails binary, ids binary, off binary, doc_id binary, no_id binary, held binary"
_REPLIES = "kind int, chunk long, bucket int, counts binary, n long, v long, words array<binary>, word_counts array<long>, tail_n array<long>, tail_v array<long>"
_MODELS = "weight double, flat binary"

#: Class and place in the class of each word; the last entry, which -1 finds, is for no word.
_CLASS = np.concatenate((np.arange(HEAD) // CLASS_SIZE, np.arange(HEAD_CLASSES, CLASSES), [255])).astype(np.uint8)
_PLACE = np.concatenate((np.arange(HEAD) % CLASS_SIZE, np.zeros(TAIL + 1, np.int64)))


def held_out_column(doc_id: Column, modulus: int = 7, remainder: int = 2) -> Column:
    """crc32 of the id as text, mod 7, is 2; rows without an id are training rows."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(modulus)) == remainder, F.lit(False))


def tail_class(token: bytes) -> int:
    return zlib.crc32(token[-2:]) % TAIL


def _softsign(a: np.ndarray) -> np.ndarray:
    b = np.abs(a)
    b += 1
    a /= b
    return a


def _exp(a: np.ndarray) -> np.ndarray:
    """exp in place, each row divided by a factor of its own where it could overflow."""
    if a.size and (a.max() > 60 or a.min() < -60):
        a -= a.max(1, keepdims=True)
    return np.exp(a, out=a)


class Network:
    """Parameters in one flat float32 vector, and the passes over them.  Gates are reset, update, candidate."""

    SHAPES = (("emb", (START + 1, EMBED)), ("wx", (3, EMBED, HIDDEN)), ("b", (3, 1, HIDDEN)), ("wh", (3, HIDDEN, HIDDEN)), ("wc", (HIDDEN, CLASSES)), ("bc", (CLASSES,)), ("ww", (HEAD_CLASSES, HIDDEN, CLASS_SIZE)), ("bw", (HEAD_CLASSES, CLASS_SIZE)))
    SIZE = sum(math.prod(s) for _, s in SHAPES)

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat, 0
        for name, shape in self.SHAPES:
            n = math.prod(shape)
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n

    @classmethod
    def start(cls, head: np.ndarray, tail: np.ndarray) -> "Network":
        """Small random weights; output biases give the unigram model of the counts."""
        net = cls(np.random.default_rng(7).normal(0, 0.1, cls.SIZE).astype(np.float32))
        p = np.full(HEAD, 1e-6)
        p[: len(head)] = np.asarray(head, float) + 0.5
        p = p.reshape(HEAD_CLASSES, CLASS_SIZE)
        c = np.concatenate((p.sum(1), np.asarray(tail, float) + 0.5))
        net.bc[:] = np.log(c / c.sum())
        net.bw[:] = np.log(p / p.sum(1, keepdims=True))
        net.emb *= 3
        net.wx *= 3
        net.b[:] = 0
        return net

    def forward(self, x: np.ndarray, fresh: np.ndarray, h: np.ndarray):
        """States, previous states (after resets), gates (time, 3, lane, HIDDEN) and the candidate's recurrent
        part for inputs x (time, lane); ``fresh`` resets the state first."""
        table = self.emb @ self.wx + self.b
        shape = (*x.shape, HIDDEN)
        out, before, part, g = np.empty(shape, np.float32), np.empty(shape, np.float32), np.empty(shape, np.float32), np.empty((len(x), 3, *shape[1:]), np.float32)
        stays = (~fresh).astype(np.float32)[:, :, None]
        for t in range(len(x)):
            np.multiply(h, stays[t], out=before[t])
            np.take(table, x[t], axis=1, out=g[t], mode="clip")
            r = before[t] @ self.wh
            part[t] = r[2]
            gates, new = g[t, :2], g[t, 2]
            gates += r[:2]
            _softsign(gates)
            gates += 1
            gates *= np.float32(0.5)
            r[2] *= gates[0]
            new += r[2]
            _softsign(new)
            h = out[t]
            np.subtract(before[t], new, out=h)
            h *= gates[1]
            h += new
        return out, before, g, part

    def log_probabilities(self, states: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log of the probability of word y[i] (for the tail: of its class) after states[i]."""
        c, w = _CLASS[y], _PLACE[y]
        out = np.empty(len(y))
        one = np.ones(CLASSES, np.float32)
        for i in range(0, len(y), SOFTMAX_ROWS):
            j = slice(i, i + SOFTMAX_ROWS)
            a = states[j] @ self.wc
            a += self.bc
            _exp(a)
            out[j] = a[np.arange(len(a)), c[j]] / (a @ one)
        order = np.argsort(c, kind="stable")
        edges = np.searchsorted(c[order], np.arange(HEAD_CLASSES + 1)).tolist()
        states, w, one = states[order[: edges[-1]]], w[order], np.ones(CLASS_SIZE, np.float32)
        inside = np.empty(edges[-1])
        for k, (a, e) in enumerate(zip(edges, edges[1:])):
            if a < e:
                b = states[a:e] @ self.ww[k]
                b += self.bw[k]
                _exp(b)
                inside[a:e] = b[np.arange(e - a), w[a:e]] / (b @ one)
        out[order[: edges[-1]]] *= inside
        return np.log(np.maximum(out, 1e-300))

    def gradient(self, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, h: np.ndarray):
        """(gradient of the mean loss, last state) of one window; targets below 0 do not count."""
        grad = Network(np.zeros(self.SIZE, np.float32))
        out, before, g, part = self.forward(x, fresh, h)
        last = out[-1].copy()
        y = y.ravel()
        c = _CLASS.take(y)
        order = np.argsort(c, kind="stable")
        c = c[order]
        edges = np.searchsorted(c, np.arange(HEAD_CLASSES + 1)).tolist()
        n = int(np.searchsorted(c, 255))
        if not n:
            return grad, last
        order, c, scale = order[:n], c[:n].astype(np.int64), np.float32(1 / n)
        w = _PLACE.take(y[order])
        s = out.reshape(-1, HIDDEN).take(order, axis=0)
        back, turned, one = np.empty_like(s), np.ascontiguousarray(self.wc.T), np.ones(SOFTMAX_ROWS, np.float32)
        rows = np.arange(SOFTMAX_ROWS)
        for i in range(0, n, SOFTMAX_ROWS):
            part_s = s[i : i + SOFTMAX_ROWS]
            m = len(part_s)
            a = part_s @ self.wc
            a += self.bc
            _exp(a)
            a *= (scale / (a @ one[:CLASSES]))[:, None]
            a[rows[:m], c[i : i + m]] -= scale
            grad.wc += part_s.T @ a
            grad.bc += one[:m] @ a
            np.matmul(a, turned, out=back[i : i + m])
        for k in range(HEAD_CLASSES):
            i, j = edges[k], edges[k + 1]
            if i < j:
                b = s[i:j] @ self.ww[k]
                b += self.bw[k]
                _exp(b)
                b *= (scale / (b @ one[:CLASS_SIZE]))[:, None]
                b[np.arange(j - i), w[i:j]] -= scale
                np.matmul(s[i:j].T, b, out=grad.ww[k])
                b.sum(0, out=grad.bw[k])
                back[i:j] += b @ self.ww[k].T
        d_out = np.zeros(out.shape, np.float32)
        d_out.reshape(-1, HIDDEN)[order] = back
        r, z, new = g[:, 0], g[:, 1], g[:, 2]
        to_new = np.abs(new)
        np.subtract(1, to_new, out=to_new)
        to_new *= to_new
        to_new *= 1 - z
        slope = np.minimum(g[:, :2], 1 - g[:, :2])  # of a gate: twice the square of this
        slope *= slope
        slope *= 2
        to_z, to_r = slope[:, 1], slope[:, 0]
        to_z *= before - new
        to_r *= part
        d, d_new = np.empty((3, *out.shape), np.float32), np.empty(out.shape, np.float32)
        turned, carry, stays = np.ascontiguousarray(self.wh.transpose(0, 2, 1)), np.zeros_like(h), (~fresh).astype(np.float32)[:, :, None]
        for t in range(len(x) - 1, -1, -1):
            dh, dn = d_out[t], d_new[t]
            dh += carry
            np.multiply(dh, to_new[t], out=dn)
            np.multiply(dn, to_r[t], out=d[0, t])
            np.multiply(dh, to_z[t], out=d[1, t])
            np.multiply(dn, r[t], out=d[2, t])
            p = d[:, t] @ turned
            carry = p[0]
            carry += p[1]
            carry += p[2]
            dh *= z[t]
            carry += dh
            carry *= stays[t]
        flat = d.reshape(3, -1, HIDDEN)
        np.matmul(before.reshape(-1, HIDDEN).T, flat, out=grad.wh)
        d[2] = d_new
        x = x.ravel()
        np.matmul(self.emb.take(x, axis=0).T, flat, out=grad.wx)
        np.matmul(np.ones((1, len(x)), np.float32), flat, out=grad.b)
        dx = (flat @ self.wx.transpose(0, 2, 1)).sum(0)
        for e in range(EMBED):
            grad.emb[:, e] = np.bincount(x, dx[:, e], START + 1)
        return grad, last


class Learner:
    """Adam steps over windows of one stream of documents after the other."""

    def __init__(self, net: Network):
        self.net, self.k, self.tokens = net, 0, 0
        self.m, self.v = np.zeros(Network.SIZE, np.float32), np.zeros(Network.SIZE, np.float32)

    def step(self, g: np.ndarray) -> None:
        self.k += 1
        norm = float(np.sqrt(g @ g))
        if norm > 1:
            g /= np.float32(norm)
        self.m += np.float32(0.1) * (g - self.m)
        g *= g
        g -= self.v
        g *= np.float32(0.01)
        self.v += g
        u = np.sqrt(self.v, out=g)
        u *= np.float32(1 / math.sqrt(1 - 0.99**self.k))
        u += np.float32(1e-6)
        np.divide(self.m, u, out=u)
        u *= np.float32(RATE / (1 - 0.9**self.k))
        self.net.flat -= u

    def learn(self, ids: np.ndarray, off: np.ndarray) -> "Learner":
        """Every token of the documents ids[off[i]:off[i + 1]] once.

        The stream of documents is cut into lanes of one length, so that none is padded and a long text does not
        have the last steps to itself; the state is carried from window to window and is fresh where
        a document or a lane begins.
        """
        n = len(ids)
        if not n:
            return self
        width = max(1, min(TRAIN_LANES, n // TRAIN_WINDOW))
        steps = -(-n // width)
        at = np.arange(steps)[:, None] + np.arange(width) * steps
        begins = np.zeros(n + 1, bool)
        begins[off[:-1]] = True
        x = np.empty(n + 1, np.int64)
        x[1:] = ids
        x[:-1][begins[:-1]] = START
        x[n] = START
        y = np.append(ids, -1)
        at = np.minimum(at, n)
        h = np.zeros((width, HIDDEN), np.float32)
        for t in range(0, steps, TRAIN_WINDOW):
            i = at[t : t + TRAIN_WINDOW]
            grad, h = self.net.gradient(x[i], y[i], begins[i], h)
            self.step(grad.flat)
        self.tokens += n
        return self


def lanes(lengths: np.ndarray, count: int) -> list[list[int]]:
    """Documents dealt to lanes of about equal length, longest first."""
    count = max(1, min(count, len(lengths)))
    heap = [(0, i) for i in range(count)]
    out: list[list[int]] = [[] for _ in range(count)]
    for d in np.argsort(-lengths, kind="stable").tolist():
        n, i = heap[0]
        out[i].append(d)
        heapq.heapreplace(heap, (n + int(lengths[d]), i))
    return out


def time_major(off: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(token numbers step by step, first place of each step): lanes are sorted by length, so the
    lanes that still run are the first ones of every step and nothing is padded."""
    dealt = lanes(np.diff(off), count)
    size = np.array([sum(int(off[d + 1] - off[d]) for d in lane) for lane in dealt])
    dealt, size = [dealt[i] for i in np.argsort(-size, kind="stable")], -np.sort(-size)
    texts = np.array([d for lane in dealt for d in lane])
    n = off[texts + 1] - off[texts]
    token = np.repeat(off[texts] - (np.cumsum(n) - n), n) + np.arange(n.sum())  # lane after lane
    lane = np.repeat(np.arange(len(size)), size)
    step = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
    running = len(size) - np.searchsorted(size[::-1], np.arange(size[0]), "right")
    base = np.concatenate(([0], np.cumsum(running)))
    at = np.empty(len(token), np.int64)
    at[base[step] + lane] = token
    return at, base


def score_tokens(net: Network, ids: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Natural log probability of each token, state carried through each whole document.

    The softmax waits until some thousand states are there.
    """
    out = np.zeros(len(ids))
    if not len(ids):
        return out
    at, base = time_major(off, SCORE_LANES)
    first = np.zeros(len(ids), bool)
    first[off[:-1]] = True
    fresh = first[at]
    x = ids[at - 1]
    x[fresh] = START
    begins = np.logical_or.reduceat(fresh, base[:-1])
    stays = (~fresh).astype(np.float32)[:, None]
    table = net.emb @ net.wx + net.b
    edges = base.tolist()
    h = np.zeros((edges[1], HIDDEN), np.float32)
    much = 8 * SOFTMAX_ROWS
    states, begin = np.empty((much + len(h), HIDDEN), np.float32), 0
    half = np.float32(0.5)
    for t in range(len(edges) - 1):
        a, b = edges[t], edges[t + 1]
        h = h[: b - a]
        if begins[t]:
            h = h * stays[a:b]
        g = table.take(x[a:b], axis=1)
        r = h @ net.wh
        gates, new = g[:2], g[2]
        gates += r[:2]
        _softsign(gates)
        gates += 1
        gates *= half
        r[2] *= gates[0]
        new += r[2]
        _softsign(new)
        s = states[a - begin : b - begin]
        np.subtract(h, new, out=s)
        s *= gates[1]
        s += new
        h = s
        if b - begin >= much or b == len(at):
            place = at[begin:b]
            h = h.copy()
            out[place] = net.log_probabilities(states[: b - begin], ids[place])
            begin = b
    return out


def tokens_of(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]  # of bytes: A-Z only, breaks at 09-0D and 20


def _owned(distinct: list[bytes], buckets: int):
    """(bucket, places of its tokens) for each bucket that owns some."""
    owner = np.fromiter(map(zlib.crc32, distinct), np.int64, len(distinct)) % buckets
    order = np.argsort(owner, kind="stable")
    head = np.flatnonzero(np.diff(owner[order], prepend=-1))
    for i, j in zip(head.tolist(), [*head[1:].tolist(), len(order)]):
        yield int(owner[order[i]]), order[i:j]


def _packed(batch: pa.RecordBatch, number: int, buckets: int) -> pa.RecordBatch:
    """One chunk: its tokens as numbers (kind 1) and its messages to the buckets (kind 0)."""
    held = np.array(batch.column("held_out").to_pylist(), bool)
    docs = [tokens_of(t) for t in common.blobs(batch.column("text"))]
    off = np.cumsum([0] + [len(d) for d in docs])
    index: defaultdict = defaultdict(count().__next__)  # numbers in the order of first use
    ids = np.fromiter(map(index.__getitem__, chain.from_iterable(docs)), np.int32, off[-1])
    del docs
    distinct = list(index)
    known = np.bincount(ids[np.repeat(~held, np.diff(off))], minlength=len(distinct))
    rows = [(0, number, b, b"\n".join([distinct[i] for i in p.tolist()]), known[p].astype(np.int32).tobytes(), None, None, None, None, None, None) for b, p in _owned(distinct, buckets)]
    no_id = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
    rows.append((1, number, -1, b"\n".join(distinct), None, np.fromiter(map(tail_class, distinct), np.uint8, len(distinct)).tobytes(), ids.tobytes(), off.astype(np.int64).tobytes(), common.ints(batch.column("doc_id")).tobytes(), no_id.tobytes(), held.tobytes()))
    kinds = [pa.int32(), pa.int64(), pa.int32()] + [pa.binary()] * 8
    names = ["kind", "chunk", "bucket", "tokens", "counts", "tails", "ids", "off", "doc_id", "no_id", "held"]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)


def _chunker(buckets: int):
    def run(batches):
        number = TaskContext.get().partitionId() << 32
        waiting, size = [], 0
        for whole in batches:
            for b in common.pieces(whole, CHUNK_BYTES):
                if waiting and size + b.nbytes > CHUNK_BYTES:
                    yield _packed(common.joined(waiting), number, buckets)
                    number, waiting, size = number + 1, [], 0
                waiting.append(b)
                size += b.nbytes
        if waiting:
            yield _packed(common.joined(waiting), number, buckets)

    return run


def _answered(table: pa.Table) -> pa.Table:
    """The bucket's total counts for each chunk that asked (kind 0); its sums and most frequent tokens once (kind 2)."""
    index: defaultdict = defaultdict(count().__next__)
    asked = []
    for s, b, toks, counts in zip(*(table.column(c).to_pylist() for c in ("chunk", "bucket", "tokens", "counts"))):
        ts = toks.split(b"\n")
        asked.append((s, b, np.fromiter(map(index.__getitem__, ts), np.int64, len(ts)), np.frombuffer(counts, np.int32)))
    out = []
    if asked:
        total = np.zeros(len(index), np.int64)
        for _, _, at, counts in asked:
            total[at] += counts  # a chunk names a token once
        for s, b, at, _ in asked:
            out.append((0, s, b, total[at].tobytes(), 0, 0, None, None, None, None))
        names, seen = list(index), np.flatnonzero(total)
        tails = np.fromiter((tail_class(names[i]) for i in seen.tolist()), np.int64, len(seen))
        top = heapq.nsmallest(HEAD, ((-c, names[i]) for i, c in zip(seen.tolist(), total[seen].tolist())))
        tail_n = np.bincount(tails, total[seen], TAIL).astype(np.int64).tolist()
        out.append((2, -1, asked[0][1], None, int(total.sum()), len(seen), [t for _, t in top], [-c for c, _ in top], tail_n, np.bincount(tails, minlength=TAIL).tolist()))
    cols = list(zip(*out)) or [[]] * 10
    longs = pa.list_(pa.int64())
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.binary()), longs, longs, longs]
    names = ("kind", "chunk", "bucket", "counts", "n", "v", "words", "word_counts", "tail_n", "tail_v")
    return pa.table({n: pa.array(list(c), k) for n, c, k in zip(names, cols, kinds)})


def _words(tokens: bytes, tails: bytes, number: dict[bytes, int]) -> np.ndarray:
    """The network's word of each distinct token of a chunk."""
    ts = tokens.split(b"\n")
    head = np.fromiter(map(number.get, ts, repeat(-1)), np.int64, len(ts))
    return np.where(head < 0, np.frombuffer(tails, np.uint8) + np.int64(HEAD), head)


def training_part(ids: np.ndarray, off: np.ndarray, held: np.ndarray, k: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-th of ``parts`` of a chunk's training documents: their tokens, and where each begins."""
    mine = np.zeros(len(held), bool)
    mine[np.flatnonzero(~held)[k::parts]] = True
    n = np.diff(off)
    return ids[np.repeat(mine, n)], np.concatenate(([0], np.cumsum(n[mine])))


def _trainer(flat: bytes, number, k: int, parts: int):
    def run(batches):
        learner = Learner(Network(np.frombuffer(flat, np.float32).copy()))
        for b in batches:
            for tokens, tails, ids, off, held in zip(*(b.column(c) for c in ("tokens", "tails", "ids", "off", "held"))):
                words = _words(tokens.as_py(), tails.as_py(), number.value)
                local, o = training_part(np.frombuffer(ids.as_buffer(), np.int32), np.frombuffer(off.as_buffer(), np.int64), np.frombuffer(held.as_buffer(), bool), k, parts)
                learner.learn(words[local], o)
        if learner.tokens:
            yield _model(learner.tokens, learner.net.flat)

    return run


def _model(weight: float, flat: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([float(weight)]), pa.array([flat.astype(np.float32).tobytes()], pa.binary())], names=["weight", "flat"])


def _mean(batches):
    """The weighted mean of all parameter vectors of a partition."""
    total, flat = 0.0, np.zeros(Network.SIZE)
    for b in batches:
        for w, f in zip(b.column("weight").to_pylist(), b.column("flat").to_pylist()):
            flat += w * np.frombuffer(f, np.float32)
            total += w
    if total:
        yield _model(total, flat / total)


def tree_mean(models: DataFrame, fan: int = 16) -> bytes | None:
    """Weighted mean of written parameter vectors in groups of about ``fan``, dealt evenly; the driver gets ``fan`` at most."""
    n = models.count()
    while n > fan:
        n = -(-n // fan)
        models = models.repartition(n).mapInArrow(_mean, _MODELS)
    rows = models.collect()
    if not rows:
        return None
    w = np.array([r["weight"] for r in rows])
    flat = sum(x * np.frombuffer(bytes(r["flat"]), np.float32).astype(float) for x, r in zip(w, rows))
    return (flat / w.sum()).astype(np.float32).tobytes()


def _scored(chunk: pa.Table, replies: pa.Table, flat: bytes, number: dict[bytes, int], n: int, v: int, tail: np.ndarray, buckets: int) -> pa.Table:
    if not chunk.num_rows:
        return _result(pa.array([], pa.int64()), [], [], [], n, [], [])
    row = {c: chunk.column(c)[0].as_py() for c in ("tokens", "tails", "ids", "off", "doc_id", "no_id", "held")}
    word = _words(row["tokens"], row["tails"], number)
    counts = np.zeros(len(word), np.int64)
    answer = dict(zip(replies.column("bucket").to_pylist(), replies.column("counts").to_pylist()))
    for b, p in _owned(row["tokens"].split(b"\n"), buckets):
        counts[p] = np.frombuffer(answer[b], np.int64)
    local, off = np.frombuffer(row["ids"], np.int32), np.frombuffer(row["off"], np.int64)
    base = np.log10((counts + 1) / (n + 1 * (v + 1)))
    share = np.where(word < HEAD, 0.0, np.log10((counts + 1) / (tail[np.maximum(word - HEAD, 0)] + 1)))
    logs = score_tokens(Network(np.frombuffer(flat, np.float32).copy()), word[local], off) / math.log(10)
    logs += share[local]
    add = lambda a: np.add.reduceat(a, off[:-1])  # noqa: E731  (every text has its end token)
    ids = pa.array(np.frombuffer(row["doc_id"], np.int64), mask=np.frombuffer(row["no_id"], bool))
    return _result(ids, np.frombuffer(row["held"], bool), np.diff(off), add((counts > 0).astype(np.int64)[local]), n, add(base[local]), add(logs))


def _result(ids, held, n_tokens, known, n, base, score) -> pa.Table:
    return pa.table({"doc_id": ids, "held_out": pa.array(held, pa.bool_()), "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array([n] * len(n_tokens), pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64())})


def score(docs: DataFrame, modulus: int = 7, remainder: int = 2, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    Tokens are A-Z-lower-cased words and one end for each text; null and empty texts are the end
    alone.  ``base_score`` is the add-one unigram log10 probability over all training counts, ``score``
    the network's log10 probability of the whole text.  The network learns from every training token
    once, in ``rounds`` parts.  Repeated rows count as often as they occur; rows without an id are
    training rows.  Among words of one count the smaller bytes come first into the head.  Without
    training rows all counts are zero and the network is the untrained one.  A very long text is a chunk
    of its own and is learned from in lanes and scored whole: a task's memory follows the longest text.
    Empty tables give no rows.  Only doc_id and text are read.
    """
    spark = docs.sparkSession
    n = common.parallelism(common.text_bytes(docs), spark)
    base = docs.select(*common.doc_columns(docs, "doc_id")).withColumn("held_out", held_out_column(F.col("doc_id"), modulus, remainder))
    packed = common.materialise(base.mapInArrow(common.tidy(_chunker(n)), _CHUNKS), "chunks", ROW_GROUP)
    chunks = packed.where("kind = 1")
    asked = packed.where("kind = 0").select("chunk", "bucket", "tokens", "counts")
    found = common.materialise(asked.groupBy("bucket").applyInArrow(common.tidy_group(_answered), _REPLIES), "counts", ROW_GROUP)
    sums = found.where("kind = 2")
    total = sums.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n_all, v_all = total["n"] or 0, total["v"] or 0
    top = sums.select(F.inline(F.arrays_zip("words", "word_counts"))).orderBy(F.desc("word_counts"), "words").limit(HEAD).collect()
    number = {bytes(r["words"]): i for i, r in enumerate(top)}
    tails = sums.select(F.posexplode(F.arrays_zip("tail_n", "tail_v"))).groupBy("pos").agg(F.sum("col.tail_n").alias("n"), F.sum("col.tail_v").alias("v")).collect()
    tail_n, tail_v = np.zeros(TAIL, np.int64), np.zeros(TAIL, np.int64)
    for r in tails:
        tail_n[r["pos"]], tail_v[r["pos"]] = r["n"], r["v"]
    for r in top:  # these words are not in the tail
        k = tail_class(bytes(r["words"]))
        tail_n[k] -= r["word_counts"]
        tail_v[k] -= 1
    flat = Network.start(np.array([r["word_counts"] for r in top], float), tail_n).flat.tobytes()
    sent = spark.sparkContext.broadcast(number)
    for k in range(rounds if n_all else 0):
        learned = chunks.select("tokens", "tails", "ids", "off", "held").mapInArrow(common.tidy(_trainer(flat, sent, k, rounds)), _MODELS)
        flat = tree_mean(common.materialise(learned, "models")) or flat
    replies = found.where("kind = 0").select("chunk", "bucket", "counts")
    final = spark.sparkContext.broadcast((flat, number, tail_n + tail_v))
    one = chunks.select("chunk", "tokens", "tails", "ids", "off", "doc_id", "no_id", "held")

    def judged(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        net, words, tail = final.value
        return _scored(chunk, answers, net, words, n_all, v_all, tail, n)

    return one.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(common.tidy_pair(judged), SCHEMA)
