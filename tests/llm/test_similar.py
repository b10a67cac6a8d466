"""Near-copies at a stated similarity, against all pairs."""
import random
from fractions import Fraction

import numpy as np
import pytest

from tesseral.llm import similar, simhash

SCHEMA = "doc_id long, text string, node string, c0 long"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "s", k) for k, (i, t) in enumerate(docs)], SCHEMA)


def slow_set(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {None}


def slow_groups(docs):
    sets, at = [slow_set(t) for _, t in docs], list(range(len(docs)))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if Fraction(len(sets[i] & sets[j]), len(sets[i] | sets[j])) >= Fraction(4, 5):
                a, b = find(i), find(j)
                at[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(docs))]


def sample(seed, copies):
    r = random.Random(seed)
    words, docs = [f"W{i}" for i in range(500)], []
    shared = [r.choice(words) for _ in range(60)]
    for k in range(25):
        w = [r.choice(words) for _ in range(r.choice([1, 3, 5, 60, 150, 400]))] + (shared if k % 2 else [])
        for _ in range(r.choice([1, 1, 2, copies])):
            v = w[:]
            for _ in range(r.randrange(1 + len(v) // 40)):  # from copies to texts well under the similarity
                v[r.randrange(len(v))] = "changed"
            docs.append((len(docs), " ".join(v)))
    return docs + [(900, None), (901, ""), (902, " \n"), (5, docs[5][1]), (None, docs[7][1]), (903, docs[9][1].upper() + " "), (904, "long " * 30_000), (905, "long " * 30_001)]


@pytest.mark.parametrize("limit", [2048, 6])
def test_groups(spark, monkeypatch, limit):
    monkeypatch.setattr(similar, "TREE_NODES", limit)  # 6: shards and components are dealt out in chunks
    monkeypatch.setattr(simhash, "TREE_NODES", limit)
    docs = sample(3, 12)
    group, least = slow_groups(docs), {}
    for (i, _), g in zip(docs, group):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    kept = similar.keep_one(frame(spark, docs))
    assert kept.columns == ["doc_id", "text", "node", "c0"]
    rows = kept.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(set(least.values()))
    assert all(docs[r["c0"]][1] == r["text"] for r in rows)


def test_rows_without_an_id(spark):
    text = " ".join(map(str, range(80)))
    docs = [(None, text), (None, text), (None, text + " more"), (None, "quite another text of a few words"), (None, None)]
    assert similar.keep_one(frame(spark, docs)).count() == 3


def test_nothing(spark):
    assert similar.keep_one(frame(spark, [])).count() == 0


def test_sketches_agree_as_sets_do():
    r = random.Random(1)
    w = [str(r.random()) for _ in range(900)]
    a, b = similar.sketch(" ".join(w).encode(), 5), similar.sketch(" ".join(w[:880]).encode(), 5)
    assert a[1] == 896 and b[1] == 876
    assert (np.frombuffer(a[2], np.uint8) == np.frombuffer(b[2], np.uint8)).mean() > 0.85 and (a[3] == b[3]).sum() >= 8


def test_blocks_repeated_a_different_number_of_times(spark):
    r, docs = random.Random(4), []
    for k in range(8):
        w = [f"d{k}w{r.randrange(9000)}" for _ in range(600)]
        block = [f"d{k}b{i}" for i in range(20)]
        docs += [(2 * k, " ".join(w + block)), (2 * k + 1, " ".join(w + block * 20))]
    assert max(slow_groups(docs)) == 14 and len(set(slow_groups(docs))) == 8
    assert sorted(x["doc_id"] for x in similar.keep_one(frame(spark, docs)).collect()) == list(range(0, 16, 2))


def far_pair(seed):
    """Two texts at the stated similarity that share a shard and whose fingerprints differ in 19 bits or more."""
    r = random.Random(seed)
    while True:
        w = [str(r.randrange(10**6)) for _ in range(84)]
        a, b = " ".join(w[:74]), " ".join(w[7:81])  # 63 of 77 shingles are common
        x, y = similar.sketch(a.encode(), 5), similar.sketch(b.encode(), 5)
        if 19 <= (x[0] ^ y[0]).bit_count() and (x[3] == y[3]).any():
            return a, b


def test_pairs_with_distant_fingerprints(spark):
    a, b = far_pair(2)
    assert slow_groups([(0, a), (1, b)]) == [0, 0]
    assert [x["doc_id"] for x in similar.keep_one(frame(spark, [(0, a), (1, b)])).collect()] == [0]
