"""Every pipeline stage on odd rows: nulls, empty and very long texts, repeated rows, clashing columns."""
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql.types import ArrayType, IntegerType, LongType, MapType, StringType, StructField, StructType

import corpus_pipeline as pipeline
from tesseral.llm import bpe, repeats

R = random.Random(11)
WORDS = ["".join(R.choice("abcdefghij") for _ in range(R.randrange(2, 9))) for _ in range(900)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, node long, bucket int, c0 string, n_words string, hits string, items string, id_ long, data binary"


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


PASSAGE, QUESTION = prose(60, 1), prose(14, 2)


@pytest.fixture(scope="module")
def odd(spark):
    texts = {1: prose(120, 3), 2: prose(120, 3), 3: prose(120, 3) + " more", 4: prose(100, 4) + " " + PASSAGE, 5: PASSAGE + " " + prose(100, 5), 6: prose(80, 6) + " " + QUESTION + " " + prose(80, 7), 7: None, 8: "", 9: " \n\t", 10: "short", 11: prose(30_000, 8), 12: "x" * 200_000, 13: "é" * 60, 14: "# " * 90}
    rows = [(i, t) for i, t in texts.items()] + [(1, texts[1]), (None, prose(90, 9)), (None, prose(90, 9)), (None, None)]
    return spark.createDataFrame([(i, t, None, "s", None, "a", 1, 2, "b", "c", "d", "e", 5, b"\xff") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, 1, 0), (None, 0, 0), (4, None, 0), (14, 0, None), (99, 0, 0), (1, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([("q1", QUESTION.upper(), "x"), (None, None, "x"), ("q2", "", "x"), ("q1", QUESTION.upper(), "x"), ("q3", "...", "x")], "item_id string, text string, doc_id string").write.parquet(f"{d}/benchmark.parquet")
    return d


def kept(frame):
    return sorted((r["doc_id"] for r in frame.collect()), key=str)


@pytest.mark.parametrize("k", range(5))
def test_empty_table(spark, odd, tables, k):
    out = pipeline.STAGES[k][1](spark, odd.limit(0), tables)
    assert out.count() == 0 and (k == 4 or out.columns == odd.columns)


def test_quality(spark, odd, tables):
    out = pipeline.keep_quality(spark, odd, tables)
    assert out.columns == odd.columns
    assert kept(out) == sorted([1, 1, 2, 3, 4, 5, 6, 11, None, None], key=str)  # the rest has under 50 words or repeats itself
    assert all(bytes(r["data"]) == b"\xff" and r["lang"] is None for r in out.collect())


def test_near_copies(spark, odd, tables):
    out = pipeline.drop_near_copies(spark, odd, tables)
    assert out.columns == odd.columns
    # 2 and 3 repeat 1; 8, 9 and the row without id or text are wordless like 7
    assert kept(out) == sorted([1, 4, 5, 6, 7, 10, 11, 12, 13, 14, None], key=str)


def test_repeats(spark, odd, tables):
    out = pipeline.cut_repeats(spark, odd, tables)
    assert out.columns == odd.columns and out.count() == odd.count()
    rows = {r["doc_id"]: r for r in out.collect() if r["doc_id"] is not None}
    before = {r["doc_id"]: r["text"] for r in odd.collect()}
    assert rows[2]["text"] == "" and rows[7]["text"] == "" and rows[8]["text"] == ""
    assert PASSAGE in rows[4]["text"] and PASSAGE not in rows[5]["text"] and prose(100, 5) in rows[5]["text"]
    assert all(rows[i]["text"] == before[i] for i in (6, 9, 10, 11, 12, 13, 14))
    assert all(r["n_chars"] == len(r["text"]) for r in rows.values())


def slow_keep_first(docs, window=50):
    """{doc_id: text without characters that lost a byte to a window of an earlier document}."""
    out, seen = {}, set()
    for i, t in sorted(docs):
        b = t.encode()
        mine = [b[k : k + window] for k in range(len(b) - window + 1)]
        gone = {k + j for k, w in enumerate(mine) if w in seen for j in range(window)}
        at, left = 0, []
        for c in t:
            n = len(c.encode())
            if not gone.intersection(range(at, at + n)):
                left.append(c)
            at += n
        out[i] = "".join(left)
        seen.update(mine)
    return out


def test_repeats_inside_characters(spark):
    passage = {"р": "общий отрывок, который есть в обоих текстах без изменений", "é": "où l'été à côté près du café, déjà évoqué là-bas, très tôt", "漢": "共有される文章はここにあり同じ文字の並びが続く箇所である"}
    # letters that share their lead byte (D0, C3, E6) or their last byte (D0 BF / CE BF) around the passage
    ends = {"р": ["абвгд", "жзийк", "лмноп", "οοοοο"], "é": ["àáâãä", "çèêëì", "òóôõö", "ùúûüý"], "漢": ["漢字", "湘潮", "澄激", "濃瀬"]}
    docs = [(10 * n + k, f"{k} own words {e[::-1]} {e}{p}{e} and a clean end {k}{e[0]}{p[:9]}") for n, (s, p) in enumerate(passage.items()) for k, e in enumerate(ends[s])]
    docs += [(50, "ж" + "ab" * 40 + "ш" + "z" * 10), (51, "з" + "ab" * 40 + "щ" + "y" * 10)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in repeats.keep_first(rows).collect()}
    assert got == slow_keep_first(docs)
    raw = {r["doc_id"]: bytes(r["kept"]) for r in repeats.remove_repeats(rows).collect()}
    assert any(raw[i].decode("utf-8", "ignore").encode() != raw[i] for i in raw)  # spans do end inside characters


def test_leaks(spark, odd, tables):
    out = pipeline.drop_benchmark(spark, odd, tables)
    assert out.columns == odd.columns
    assert kept(out) == sorted([r["doc_id"] for r in odd.collect() if r["doc_id"] != 6], key=str)


def test_encoding(spark, odd, tables):
    ranks = bpe.read_ranks(public_tokenizers.path(pipeline.RANKS))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted(((r["doc_id"], library.encode_ordinary(r["text"] or "")) for r in odd.where("doc_id is null or doc_id <> 12").collect()), key=str)
    out = pipeline.encode(spark, odd, tables).collect()
    assert sorted(((r["doc_id"], list(r["ids"])) for r in out if r["doc_id"] != 12), key=str) == want
    long = [r for r in out if r["doc_id"] == 12]
    assert b"".join(library.decode_single_token_bytes(i) for i in long[0]["ids"]) == b"x" * 200_000


def test_columns_of_any_type_and_name(spark, tables):
    """Fields whose names are no plain words travel through the stages."""
    kind = StructType([StructField("my-col", IntegerType()), StructField("a b,c", StringType())])
    schema = StructType([StructField("doc_id", LongType()), StructField("odd.name", kind), StructField("text", StringType()), StructField("m", MapType(StringType(), ArrayType(IntegerType())))])
    rows = [(i, (i, "x"), prose(80, 20 + i), {"k": [i]}) for i in range(3)] + [(7, None, prose(80, 22), None)]
    docs = spark.createDataFrame(rows, schema)
    for k in (0, 1, 2, 3):
        out = pipeline.STAGES[k][1](spark, docs, tables)
        assert out.columns == docs.columns
        got = {r["doc_id"]: (r["odd.name"] and tuple(r["odd.name"]), r["m"]) for r in out.collect()}
        assert {i: got[i] for i in range(3)} == {i: ((i, "x"), {"k": [i]}) for i in range(3)}
