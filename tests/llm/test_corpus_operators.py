"""Near-duplicates, repeated windows, language model, archives, pipeline: against brute force."""
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tesseral.llm import common, components, gru_lm, repeats, simhash, warc

SCHEMA = "doc_id long, text string, shard string, fp string"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "s", "f") for i, t in docs], SCHEMA)


# --- SimHash


def slow_print(text, n=4):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, pairs):
    at = list(range(n))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_bk_tree_finds_all():
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ sum((np.uint64(1) << np.uint64(r.integers(64)) for _ in range(k)), np.uint64(0)) for k in range(7)]))
    q, n = simhash.BKTree(fps).search(fps, 4)
    got = {(int(a), int(b)) for a, b in zip(q, n)}
    assert got == {(i, j) for i in range(len(fps)) for j in range(len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 4}
    assert len(simhash.BKTree(fps[:0]).search(fps, 4)[0]) == 0


@pytest.mark.parametrize("radius,distinct", [(4, 10), (4, 10**8), (6, 10**6), (0, 5), (8, 5)])
def test_tables_miss_no_pair(radius, distinct):
    masks, r = simhash.masks(radius, distinct), random.Random(1)
    for _ in range(300):
        flips = sum(1 << b for b in r.sample(range(64), radius))
        assert any(not flips & m for m in masks)


@pytest.mark.parametrize("tree", [2048, 8])
def test_near_duplicates(spark, monkeypatch, tree):
    monkeypatch.setattr(simhash, "TREE_NODES", tree)  # 8: crowded shards are dealt out in chunks
    r = random.Random(2)
    words = [f"W{i}" for i in range(300)]
    docs = []
    for k in range(30):
        w = [r.choice(words) for _ in range(r.choice([1, 3, 4, 60, 200]))]
        for _ in range(r.choice([1, 1, 2, 6])):
            v = w[:]
            if len(v) > 50 and r.random() < 0.7:
                v[r.randrange(len(v))] = "changed"
            docs.append((len(docs), " ".join(v)))
    base = [r.choice(words) for _ in range(400)]
    for _ in range(40):  # a crowd of near copies
        v = base[:]
        v[r.randrange(400)] = r.choice(words)
        docs.append((len(docs), " ".join(v)))
    docs += [(900, None), (901, ""), (902, " \n"), (5, docs[5][1]), (None, docs[7][1])]
    fps = [slow_print(t) for _, t in docs]
    comp = roots(len(docs), [(i, j) for i in range(len(docs)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    least = {}
    for (i, _), c in zip(docs, comp):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = sorted(((i, f"{f:016x}", least.get(c)) for (i, _), f, c in zip(docs, fps, comp)), key=str)
    assert sorted(map(tuple, simhash.near_duplicates(frame(spark, docs)).collect()), key=str) == want
    kept = simhash.keep_one(frame(spark, docs), 4, 4)
    assert kept.columns == ["doc_id", "text", "shard", "fp"]
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(set(least.values()))


def test_near_duplicates_of_nothing(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("few", [100_000, 0])
def test_components(spark, few):
    r = random.Random(3)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(7, 7), (None, 3)]
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(pairs, "u long, v long"), few_edges=few).collect()}
    want = roots(150, [p for p in pairs if None not in p])
    assert got == {i: w for i, w in enumerate(want) if w != i}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- repeated windows


def slow_repeats(docs):
    first, out = {}, []
    key = lambda i: common.NO_ID if i is None else i
    for i, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], key(i)), key(i))
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < key(i):
                gone[p : p + 50] = b"\1" * 50
        out.append((i, len(b), sum(gone), sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone)), hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_repeats(spark):
    r = random.Random(4)
    passage = "".join(r.choice("abcdefgh éß") for _ in range(400))
    docs = []
    for k in range(60):
        t = "".join(r.choice("abcdefghijkl ") for _ in range(r.choice([0, 20, 49, 50, 51, 300])))
        if k % 3 == 0:
            a = r.randrange(300)
            t += passage[a : a + r.choice([30, 49, 50, 51, 100])] + t[:60]
        docs.append((r.randrange(1000), t))
    docs += [(2000, "a" * 3000), (2001, "a" * 500 + "b"), (2002, passage * 3), (2003, None), (2004, ""), (2002, passage * 3), (None, passage), (None, passage + "x"), (2005, "ab" * 400)]
    rows = repeats.remove_repeats(frame(spark, docs)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, rows), key=str) == slow_repeats(docs)
    cut = repeats.keep_first(frame(spark, docs))
    assert cut.columns == ["doc_id", "text", "shard", "fp"] and cut.count() == len(docs)
    assert repeats.remove_repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("hot", [1, 40, 3000])
def test_hot_digits_are_split(spark, hot):
    """A common phrase in ever new surroundings, at all depths from two digits to the whole window."""
    r = random.Random(12)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    phrase, longer = "all rights are reserved by us", word(70)
    docs = [(i, " ".join(r.choice([word(r.randrange(30)), phrase, phrase, longer[: r.randrange(20, 70)]]) for _ in range(6))) for i in range(120)]
    docs += [(200, docs[5][1]), (3, docs[7][1]), (None, docs[9][1]), (201, longer), (202, None)]
    got = repeats.remove_repeats(frame(spark, docs), hot_runs=hot).collect()
    assert sorted(((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], hashlib.sha256(bytes(x["kept"])).hexdigest()) for x in got), key=str) == sorted(slow_repeats(docs), key=str)


def test_depths_grow_with_runs():
    n = np.array([0, 1, 9, 10, 159, 160, 2560, 10**6, 10**9])
    assert repeats.depths(n, 10).tolist() == [1, 1, 1, 2, 2, 4, 8, 32, 35]


def test_labels_fall_into_all_partitions(spark):
    for n in (1, 7, 97):
        labels = spark.createDataFrame([(int(x),) for x in common.even_labels(n)], "k int")
        assert {tuple(x) for x in labels.select(F.pmod(F.hash("k"), F.lit(n))).collect()} == {(i,) for i in range(n)}


# --- language model


def network():
    return gru_lm.Network.start(np.arange(gru_lm.HEAD, 0, -1.0), np.arange(1, gru_lm.TAIL + 1))


def slow_logs(net, ids, off):
    """Step by step: one token at a time, full softmax over classes and over the words of a class."""
    soft = lambda a: a / (1 + np.abs(a))
    share = lambda a: np.exp(a - a.max()) / np.exp(a - a.max()).sum()
    net, out = gru_lm.Network(net.flat.astype(np.float64)), []
    for a, b in zip(off[:-1], off[1:]):
        h, word = np.zeros(gru_lm.HIDDEN), gru_lm.START
        for t in range(a, b):
            gx = [net.emb[word] @ net.wx[k] + net.b[k, 0] for k in range(3)]
            r, z = ((1 + soft(gx[k] + h @ net.wh[k])) / 2 for k in range(2))
            n = soft(gx[2] + r * (h @ net.wh[2]))
            h = (1 - z) * n + z * h
            word = int(ids[t])
            if word < gru_lm.HEAD:
                k, w = divmod(word, gru_lm.CLASS_SIZE)
                inside = share(h @ net.ww[k] + net.bw[k])[w]
            else:
                k, inside = gru_lm.HEAD_CLASSES + word - gru_lm.HEAD, 1.0
            out.append(math.log(share(h @ net.wc + net.bc)[k] * inside))
    return np.array(out)


def test_gru_gradient():
    r = np.random.default_rng(0)
    net = network()
    ids, off = r.integers(0, gru_lm.START, 60), np.array([0, 20, 45, 60])
    x = np.append(gru_lm.START, ids[:-1])
    x[off[:-1]] = gru_lm.START
    fresh = np.isin(np.arange(60), off[:-1])
    lanes = lambda a: np.stack((a[:45], np.append(a[45:], np.full(30, a[-1]))), 1)  # noqa: E731  (the second lane ends early)
    y = lanes(ids)
    y[15:, 1] = -1
    grad, _ = net.gradient(lanes(x), y, lanes(fresh), np.zeros((2, gru_lm.HIDDEN), np.float32))
    for name, _ in net.SHAPES:
        g = getattr(grad, name).ravel()
        k, loss = int(np.argmax(np.abs(g))), []
        for e in (1e-2, -1e-2):
            other = gru_lm.Network(net.flat.copy())
            getattr(other, name).reshape(-1)[k] += e
            loss.append(-gru_lm.score_tokens(other, ids, off).sum() / 60)
        assert abs((loss[0] - loss[1]) / 2e-2 - g[k]) < 0.02 * abs(g[k]) + 1e-5


@pytest.mark.parametrize("trained", [False, True])
def test_gru_scores_as_step_by_step(trained):
    r = np.random.default_rng(4)
    n = np.append(r.integers(1, 40, 700), [1, 900])
    off = np.cumsum([0, *n])
    ids = r.integers(0, gru_lm.START, off[-1])
    net = network()
    if trained:
        gru_lm.Learner(net).learn(ids, off)
    assert np.allclose(gru_lm.score_tokens(net, ids, off), slow_logs(net, ids, off), rtol=1e-4, atol=1e-4)


def test_gru_is_a_distribution_and_carries_state():
    net = network()
    gru_lm.Learner(net).learn(np.arange(500) % 7, np.array([0, 500]))
    states = np.random.default_rng(1).normal(0, 1, (3, gru_lm.HIDDEN)).astype(np.float32)
    total = [np.exp(net.log_probabilities(np.repeat(s[None], gru_lm.START, 0), np.arange(gru_lm.START))).sum() for s in states]
    assert np.allclose(total, 1, atol=1e-4)
    ids = np.arange(90) % 11
    whole = gru_lm.score_tokens(net, ids, np.array([0, 90]))
    many = gru_lm.score_tokens(net, np.concatenate((ids[:5], ids)), np.array([0, 5, 95]))[5:]
    assert np.allclose(whole, many, atol=1e-5)


def test_gru_learns_what_follows():
    """Four words in turn: a model without context gives log(1 / 4) a word at best."""
    ids, off = np.tile([3, 9, 500, 1], 100_000), np.arange(0, 400_001, 400)
    net = network()
    gru_lm.Learner(net).learn(ids, off)
    assert gru_lm.score_tokens(net, ids[:4000], off[:11]).mean() > 0.5 * math.log(1 / 4)


def test_scores(spark):
    r = random.Random(6)
    docs = [(i, " ".join(r.choice(["The", "cat", "sat", f"w{r.randrange(200)}"]) for _ in range(r.choice([0, 1, 30])))) for i in range(120)] + [(500, None), (501, ""), (None, "The cat"), (3, "again"), (502, "x " * 4000)]
    count, own = Counter(), []
    for i, t in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [b""]
        held = i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        own.append((i, held, w))
        if not held:
            count.update(w)
    n, v = sum(count.values()), len(count)
    want = sorted(((i, held, len(w), sum(count[t] > 0 for t in w), n, round(sum(math.log10((count[t] + 1) / (n + v + 1)) for t in w), 6)) for i, held, w in own), key=str)
    rows = gru_lm.score(frame(spark, docs), rounds=1).collect()
    assert sorted(((x["doc_id"], x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"], round(x["base_score"], 6)) for x in rows), key=str) == want
    assert all(x["score"] < 0 for x in rows)
    assert sum(x["score"] for x in rows) > sum(x["base_score"] for x in rows)
    assert gru_lm.score(frame(spark, [])).count() == 0


def test_every_training_token_is_learned_from(monkeypatch):
    """All windows of all rounds together hold each training token once as a target, after the token before it."""
    r = random.Random(8)
    texts = ["x " * 40_000] + [" ".join(f"w{r.randrange(300)}" for _ in range(r.choice([0, 20, 3000]))) for _ in range(200)] + [None]
    held = [i % 7 == 2 for i in range(len(texts))]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts, "held_out": held})
    rows = gru_lm._packed(batch, 0, 4).to_pylist()
    row = rows[-1]
    tokens, ids, off = row["tokens"].split(b"\n"), np.frombuffer(row["ids"], np.int32), np.frombuffer(row["off"], np.int64)
    want = Counter()
    for x, out in zip(texts, held):
        if not out:
            w = gru_lm.tokens_of((x or "").encode())
            want.update(zip([None, *w], w))
    words = {t: k for k, t in enumerate(tokens)}  # 301 distinct: each is a word of its own
    assert len(words) < gru_lm.HEAD
    got, fresh_lanes = Counter(), 0

    def gradient(self, x, y, fresh, h):
        nonlocal fresh_lanes
        for a, b in zip(x.ravel().tolist(), y.ravel().tolist()):
            if b >= 0:
                got[None if a == gru_lm.START else tokens[a], tokens[b]] += 1
        return gru_lm.Network(np.zeros(self.SIZE, np.float32)), h

    monkeypatch.setattr(gru_lm.Network, "gradient", gradient)
    for k in range(3):
        local, o = gru_lm.training_part(ids, off, np.array(held), k, 3)
        gru_lm.Learner(network()).learn(np.array([words[t] for t in tokens])[local], o)
    assert got == want
    asked = [x for x in rows if x["kind"] == 0]
    assert sorted(t for x in asked for t in x["tokens"].split(b"\n")) == sorted(tokens)
    counts = {t: c for x in asked for t, c in zip(x["tokens"].split(b"\n"), np.frombuffer(x["counts"], np.int32).tolist())}
    known = Counter()
    for (_, t), c in want.items():
        known[t] += c
    assert {t: c for t, c in counts.items() if c} == known


# --- archives


def test_loser_tree():
    r = random.Random(7)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(r.randrange(50) for _ in range(r.randrange(20))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for run in runs for x in run)


def test_archives(spark, tmp_path):
    big = "é<p>" * 400
    pages = [(1, "http://B.example.com/z?q=1", big), (2, "https://a.example.com:443/", "small"), (3, None, big), (4, "http://b.example.com/a b\r\nX: y", None), (5, "u", ""), (6, "http://c.org", "small"), (None, "http://n.org", big), (7, "http://c.org", big + "!"), (7, "http://c.org", big + "!")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string")
    rows = warc.histories(df).collect()
    assert all(r["intact"] for r in rows) and len(rows) == len(pages)
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows), key=str)
    data = [(i, (h or "").encode()) for i, _, h in pages]
    want = []
    for i, h in data:
        top = max((j for j, g in data if g == h and j is not None), default=None)
        again = len(h) >= 1000 and i != top
        want.append((i, len(h), hashlib.sha1(h).hexdigest(), "revisit" if again else "response", top if again else None))
    assert got == sorted(want, key=str)
    keys = [(r["url_key"], r["captured"]) for r in rows]
    assert keys == sorted(keys) and any(k[0] == "com,example,b)/z?q=1" for k in keys)
    assert warc.histories(df.limit(0)).count() == 0
    path = str(tmp_path / "w")
    warc.write_archives(df, path)
    record = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).first()
    members = list(warc.read_members(bytes(record["content"])))
    assert all(gzip.decompress(bytes(record["content"])[o : o + n]) == c for o, n, c in members) and members[0][2].startswith(b"WARC/1.1\r\n")


def test_large_record_ends_with_zero():
    payload = random.Random(1).randbytes(1 << 10) * (17 << 10)
    m = warc.sealed(warc.member(1, "u", payload, hashlib.sha1(payload).digest(), None)) + b"\0"
    ((_, n, content),) = warc.read_members(m)
    assert n == len(m) and warc.parse(content)["intact"]


def test_archives_are_cut_by_bytes(spark, tmp_path):
    r = random.Random(2)
    pages = [(i, f"http://a.org/{i}", "".join(r.choice("abcdefgh") for _ in range(20_000 if i == 7 else 900))) for i in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, str(tmp_path / "w"), 5000)
    files = [bytes(x["content"]) for x in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(str(tmp_path / "w")).collect()]
    each = [[warc.parse(c)["page_id"] for _, _, c in warc.read_members(f)] for f in files]
    assert sorted(sum(each, [])) == list(range(60)) and len(files) > 5
    assert all(len(f) <= 5100 or len(e) == 1 for f, e in zip(files, each)) and [7] in each
    with pytest.raises(ValueError):
        list(warc.read_members(files[0][:-9]))


# --- pipeline


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    frames = [docs]
    for name, stage in pipeline.STAGES:
        frames.append(common.materialise(stage(spark, frames[-1], sf), "test"))
    assert all(f.columns == docs.columns for f in frames[:-1])
    ids = [{r["doc_id"] for r in f.select("doc_id").collect()} for f in frames]
    assert ids[0] > ids[1] >= ids[2] == ids[3] >= ids[4] == ids[5]
    by_id = {r["doc_id"]: r["text"] for r in frames[2].collect()}
    cut = {r["doc_id"]: r["text"] for r in frames[3].collect()}
    for i, _, gone, _, sha in slow_repeats(list(by_id.items())):
        if gone == 0:
            assert cut[i] == by_id[i]
    assert sorted(map(str, pipeline.run(spark, sf).collect())) == sorted(map(str, frames[-1].collect()))
