"""Rules, BPE, token counts, leaks, URLs, classifier: against libraries and brute force."""
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tesseral.llm import bpe, byte_cnn, decontaminate, quality_rules, queries, token_counts, url_filters

public_tokenizers = pytest.importorskip("public_tokenizers")
ODD = [(1, None, "x"), (2, "", "x"), (3, "a  b\t\n\x0bc", "x"), (4, "w " * 3000, "x"), (None, "no id", "x"), (3, "a  b\t\n\x0bc", "x"), (5, "Ünï 漢字 😀 ²½ it's THEY'LL 12345\n\n  end ", "x"), (6, "x" * 5000, "x")]
SCHEMA = "doc_id long, text string, n_words string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and a clashing column name."""
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- quality rules


def slow_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    hit = set()
    for i in range(len(words) - 2):
        if sum(words[j : j + 3] == words[i : i + 3] for j in range(len(words) - 2)) > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit)


def test_stats():
    r = random.Random(1)
    for _ in range(300):
        t = "".join(r.choice(["a", "b", "é", " ", " ", "\n", "#", "\x0b", "\xa0", "ab", "\r"]) for _ in range(r.choice([0, 3, 40, 120])))
        assert quality_rules.text_stats(t.encode())[:5] == slow_stats(t)


def test_rules_are_learned_and_ordered(spark):
    r = np.random.default_rng(0)
    x = r.random((3000, len(quality_rules.FEATURES)))
    bad = (x[:, 0] > 0.8) | ((x[:, 3] > 0.7) & (x[:, 6] < 0.3))
    rules = quality_rules.learn(x, bad, np.arange(3000) % 3 == 2)
    found = np.zeros(3000, bool)
    for rule in rules:
        found |= quality_rules.covers(rule, x)
    assert len(rules) >= 2 and (found == bad).mean() > 0.97
    text = quality_rules.verdict(rules)._jc.toString()
    assert text.count("THEN false") == len(rules)
    assert quality_rules.learn(x, np.zeros(3000, bool), np.arange(3000) % 3 == 2) == []


def test_judge_cases(spark, odd, empty):
    rows = quality_rules.judge(odd, [(quality_rules.Test(0, True, 0.5),), (quality_rules.Test(3, True, 0.9),)]).collect()
    assert len(rows) == len(ODD) and all(r["base_failed"] and not r["kept"] for r in rows)
    assert quality_rules.judge(empty, []).count() == 0
    labels = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    assert quality_rules.learn_from(odd, labels) == []


def test_held_out_verdicts(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = queries.op1_quality_rules(spark, sf).join(labels, "doc_id").where("not base_failed")
    assert out.where("quality = 1 and not kept").count() == 0
    assert out.where("quality = 0 and kept").count() <= 1
    kept = quality_rules.filter_documents(docs, quality_rules.learn_from(docs, labels))
    assert kept.columns == docs.columns and kept.count() == queries.op1_quality_rules(spark, sf).where("kept").count()


# --- BPE


@pytest.fixture(scope="module")
def vocabulary():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.PrefixBPE(ranks), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library(vocabulary):
    own, library = vocabulary
    split = bpe.Splitter(public_tokenizers.PATTERN, public_tokenizers.PATTERN)
    r = random.Random(2)
    for alphabet in ("ab", "etaoin shrdlu", "  \n\t\r\x0b\x1c\x85\xa0", "0123456789٣", "éàß漢字😀²½ x_", "'st're'LL I'm", "-=*_#", "ʰˠ́ːა"):
        for n in (1, 4, 17, 80):
            for _ in range(40):
                t = "".join(r.choice(alphabet) for _ in range(n))
                assert [i for p in split(t) for i in own.encode(p.encode())] == library.encode_ordinary(t), t


def test_bpe_appends_and_edits(vocabulary):
    own, _ = vocabulary
    r = random.Random(3)
    for _ in range(60):
        piece = bytes(r.choice(b"etaoinshrdlu") for _ in range(400))
        b = bpe.Buffer(own, piece[:200]).append(piece[200:])
        assert b.ids() == own.encode(piece) and b.computed == 200
        at, new = r.randrange(300), bytes(r.choice(b"xyz") for _ in range(r.randrange(4)))
        b.replace(at, at + 2, new)
        assert b.piece == piece[:at] + new + piece[at + 2 :] and b.ids() == own.encode(b.piece)
        assert b.computed < 400 - at + 5


def test_bpe_documents(odd, empty, vocabulary):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = bpe.digest_documents(odd, path).collect()
    want = []
    for i, t, _ in ODD:
        ids = vocabulary[1].encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    back = {(r["doc_id"], bytes(r["data"])) for r in bpe.decode_documents(bpe.encode_documents(odd, path), path).collect()}
    assert back == {(i, (t or "").encode()) for i, t, _ in ODD}
    assert bpe.digest_documents(empty, path).count() == 0


# --- token counts


def test_counts_equal_library(odd, empty):
    spm = pytest.importorskip("sentencepiece")
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = spm.SentencePieceProcessor(model_file=path)
    count = token_counts.Counter(token_counts.PieceModel(path))
    r = random.Random(4)
    for alphabet in ("ab", "etaoin shr", "     \n\t", "0123456789", "éàß漢字😀²½ x", "<s></s>a ", " ▁a", "aaab", "\x00 a​"):
        texts = ["".join(r.choice(alphabet) for _ in range(n)) for n in (0, 1, 5, 30, 300, 700) for _ in range(8)]
        assert count(texts) == [len(x) for x in library.encode(texts)]
    texts = [r.choice(["ab", "漢字", "xyzzy"]) * 60_000, "".join(r.choice("etaoinshrdlu") for _ in range(100_000)), "a" * 100_000]
    assert count(texts) == [len(x) for x in library.encode(texts)]  # one sequence each
    rows = token_counts.count_tokens(odd, path, limit=100).collect()
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "")), n > 100) for i, t, _ in ODD]
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert token_counts.count_tokens(empty, path).count() == 0


# --- leaks


WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def slow_leaks(docs, items):
    windows = {}
    for i, t in items:
        w = WORD.findall((t or "").encode().lower())
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, names = WORD.findall((t or "").encode().lower()), set()
        hit = [False] * len(w)
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                found = windows.get(tuple(w[k : k + n]))
                if found:
                    names |= found
                    hit[k : k + n] = [True] * n
        out.append((i, len(w), sum(hit), sorted(names)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [8 << 20, 60])
def test_leaks(spark, odd, block):
    r = random.Random(5)
    words = ["Alpha", "beta", "γάμμα", "d1", "e", "f"]
    text = lambda n: "".join(r.choice(words) + r.choice([" ", ", ", "\n"]) for _ in range(n))
    items = [(i, text(r.choice([0, 1, 2, 9, 10, 11, 15]))) for i in range(12)] + [(50, None), (None, "beta beta"), (51, "..."), (52, "A b"), (3, "d1 e")]
    items.append((53, items[3][1]))
    docs = [(i, text(r.choice([0, 1, 9, 10, 30, 200])) + (items[r.randrange(12)][1] or "")) for i in range(60)] + [(i, t) for i, t, _ in ODD]
    d = spark.createDataFrame([(*x, "clash") for x in docs], SCHEMA)
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.judge(d, b, block).collect()
    assert sorted(((x["doc_id"], x["n_words"], x["n_hit"], list(x["items"])) for x in rows), key=str) == slow_leaks(docs, items)
    clean = decontaminate.drop_leaks(d, b)
    assert clean.columns == d.columns and clean.count() == sum(not x["contaminated"] for x in rows)


def test_leaks_of_nothing(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(not r["contaminated"] for r in decontaminate.judge(odd, none).collect())
    assert decontaminate.judge(empty, none).count() == 0


# --- URLs


def test_urls(spark):
    rules = url_filters.HOST_RULES
    urls = [None, "", "no scheme", "http://", "HTTP://Www.Example.COM/en/x?y#z", "https://m.example.com/en/", "https://example.com/en", "http://x.net/es/a", "http://net/fr/", "http://notnet/fr/", "ftp://a.org/casino/", "http://a.org/casinos/", "http://a.org?u=http://b.net/es/", "http://a.org/x\ny/wp-login.php", "http://com", "http://.../", "http://a.org/cgi-bin/t.cgi"]
    urls += ["http://www.freeporn.org/", "http://free-porn.org/a", "http://a.org/porn", "http://a.org/porns", "http://www.cheap-pills.org/", "http://cheappills.org/", "http://a.org/x/buy_software.html", "http://a.org/buy-softwares", "http://linkfarm.org", "http://spam-farms.org/q", "http://ads3.a.org/", "http://a.org/wp-signup.php", "http://a.org/login/", "http://" + "a." * 3000 + "org/" + "b/" * 3000 + "casino"]
    rows = url_filters.judge_urls(spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")).collect()
    for row, url in zip(sorted(rows, key=lambda x: x["page_id"]), urls):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        path = re.match(r"[^/?#]*([^?#]*)", rest, re.S)[1]
        fit = [x for x in rules if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fit, key=lambda x: len(x.host + x.path), default=None)
        hit = next((p.verdict for p in url_filters.PATTERN_RULES if re.search(p.pattern, (host + path).lower())), "allow")
        assert (row["host"], row["path"], row["rule"]) == (host, path, best and best.name)
        assert row["verdict"] == (best.verdict if best else hit), url
    plan = url_filters.judge_urls(spark.createDataFrame([], "page_id long, url string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_rarest_literal():
    r = [url_filters.PatternRule("block", "/aa.bb/"), url_filters.PatternRule("block", "/aa/bb/"), url_filters.PatternRule("block", "/aa/cc/"), url_filters.PatternRule("block", "aa")]
    assert url_filters.index_patterns(tuple(r)) == ({"bb": [1], "cc": [2]}, [0, 3])


@pytest.mark.parametrize("pattern,tokens", [
    (r"(^|[./_-])casino([./_-]|$)", {"casino"}), (r"(^|[./_-])(free[._-]?)?porn([./_-]|$)", set()), (r"/wp-login\.php$", {"wp", "login", "php"}), (r"/cgi-bin/.*\.cgi$", {"cgi", "bin"}),
    (r"casino/", set()), (r"/casino", set()), (r"/casinos?/", set()), (r"/(a|b)c/", set()), (r"/[a-z]x/", set()), (r"[^a-z]x/", set()), (r"[^0-9a-z]x9/", {"x9"}), (r"/(x|y)/z/", {"z"}), (r"/(xy)/", {"xy"}), (r"(/ab/)?c", set()), (r"x{2}/", set()), (r"/a|/b/", set()),
])
def test_literals_of_a_pattern(pattern, tokens):
    assert url_filters.literals(pattern) == tokens


def test_index_loses_no_match():
    """Whatever a pattern matches holds the token that the pattern is filed under."""
    r = random.Random(5)
    index, rest = url_filters.index_patterns(url_filters.PATTERN_RULES)
    filed = {i: t for t, ids in index.items() for i in ids}
    assert len(filed) > 200 and set(filed) | set(rest) == set(range(len(url_filters.PATTERN_RULES)))
    words = [*url_filters.SPAM_WORDS, *url_filters.OFFERS, *url_filters.GOODS, "wp", "login", "php", "cgi", "bin", "xmlrpc", "x", "free", "porn", ""]
    hits = 0
    for _ in range(3000):
        url = "".join(r.choice(words) + r.choice(["", "", "-", "/", ".", "_"]) for _ in range(6))
        for i, rule in enumerate(url_filters.PATTERN_RULES):
            if re.search(rule.pattern, url):
                hits += 1
                assert i in rest or filed[i] in re.findall(url_filters.TOKEN, url)
    assert hits > 500


# --- classifier


def test_cnn_gradient():
    net, r = byte_cnn.ByteCNN.start(), np.random.default_rng(0)
    chunks, first, y = r.integers(0, 257, (6, byte_cnn.CHUNK)).astype(np.int16), np.array([0, 2, 3]), np.array([1, 0, 1], np.float32)
    grad = net.gradient(chunks, first, y)

    def loss():
        _, z = net.logits(net.pooled(chunks), first)
        p = 1 / (1 + np.exp(-z.astype(float)))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for k, v in net.p.items():
        flat, g = v.reshape(-1), grad[k].ravel()
        i = int(np.argmax(np.abs(g)))
        old, e = flat[i], 1e-3
        flat[i] = old + e
        a = loss()
        flat[i] = old - e
        b = loss()
        flat[i] = old
        assert abs((a - b) / (2 * e) - g[i]) < 1e-3 * max(1, abs(g[i]))


def slow_score(net, text):
    """One chunk, one place and one filter at a time."""
    e, w, b = (net.p[k].astype(float) for k in ("emb", "w", "b"))
    n, step = byte_cnn.CHUNK, byte_cnn.CHUNK - byte_cnn.OVERLAP
    tops = []
    for begin in range(0, max(1, len(text) - byte_cnn.OVERLAP), step):
        chunk = [*text[begin : begin + n]]
        chunk += [byte_cnn.PAD] * (n - len(chunk))
        best = np.full(byte_cnn.FILTERS, -np.inf)
        for at in range(0, n - byte_cnn.WIDTH + 1, byte_cnn.STRIDE):
            best = np.maximum(best, np.concatenate([e[c] for c in chunk[at : at + byte_cnn.WIDTH]]) @ w)
        tops.append(np.maximum(best + b, 0))
    z = np.concatenate((np.max(tops, 0), np.mean(tops, 0))) @ net.p["out"].astype(float) + float(net.p["bias"][0])
    return 1 / (1 + np.exp(-z))


def test_cnn_scores_as_place_by_place():
    r = random.Random(3)
    texts = [bytes(r.randrange(256) for _ in range(n)) for n in (0, 1, 511, 513, 992, 993, 30_000)]
    net = byte_cnn.fit(texts, np.array([0, 1, 0, 1, 0, 1, 1], np.float32), epochs=3)
    off = np.cumsum([0] + [len(t) for t in texts])
    got = net.score(np.frombuffer(b"".join(texts), np.uint8), off)
    assert np.allclose(got, [slow_score(net, t) for t in texts], atol=1e-5)


def test_cnn_fits_all_chunks(monkeypatch):
    texts = [b"a" * 100, b"b" * 40_000, b"", b"c" * 700_000]
    seen = Counter()

    def gradient(self, chunks, first, label):
        for text in np.split(chunks, first[1:]):
            seen["abc".index(chr(text[0, 0])) if text[0, 0] != byte_cnn.PAD else -1] += len(text)
        return {k: np.zeros_like(v) for k, v in self.p.items()}

    monkeypatch.setattr(byte_cnn.ByteCNN, "gradient", gradient)
    byte_cnn.fit(texts, np.array([0, 1, 0, 1], np.float32), epochs=1)
    assert [seen[k] for k in (0, 1, -1, 2)] == byte_cnn.chunk_counts(np.array([100, 40_000, 0, 700_000])).tolist()


def test_chunks_cover_whole_texts():
    for n in (0, 1, 511, 512, 513, 992, 993, 5000):
        data, off = np.arange(n).astype(np.uint8), np.array([0, n])
        c = int(byte_cnn.chunk_counts(np.array([n]))[0])
        m = byte_cnn.chunk_matrix(data, off, np.zeros(c, int), np.arange(c))
        seen = {k * (byte_cnn.CHUNK - byte_cnn.OVERLAP) + i for k in range(c) for i in np.flatnonzero(m[k] != byte_cnn.PAD).tolist()}
        assert seen == set(range(n))


def test_cnn_scores(spark, odd, empty, sf):
    net = byte_cnn.ByteCNN.start()
    rows = byte_cnn.score(odd, net).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    for r in rows:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.7)
    assert byte_cnn.score(empty, net).count() == 0
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = byte_cnn.score(docs, byte_cnn.train(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = out[out.quality == 1].score.values, out[out.quality == 0].score.values
    assert (good[:, None] > bad[None]).mean() > 0.95  # held-out area under the curve
