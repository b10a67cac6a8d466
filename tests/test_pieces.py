"""Tiles in pieces hold what tiles in one value hold."""
import random

import numpy as np
import pyarrow as pa
import pytest

from tesseral.operators import pieces, tiles

SCHEMA = "layer string, pos long, type int, rings array<array<struct<lng:double,lat:double>>>, tags array<struct<key:string,kind:string,value:string>>, explicit_id long"


@pytest.fixture
def many_pieces(spark):
    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": "37", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def shapes(spark):
    r = random.Random(5)
    ring = lambda n, lng, lat, w: [(lng + r.uniform(-w, w), lat + r.uniform(-w, w)) for _ in range(n)]
    rows = []
    for i in range(300):
        lng, lat, w = r.uniform(-170, 170), r.uniform(-75, 75), r.choice([0.01, 5, 40])
        shape = (2, [ring(r.randrange(1, 8), lng, lat, w)]) if i % 2 else (3, [ring(r.randrange(2, 7), lng, lat, w) for _ in range(r.randrange(1, 4))])
        tags = [("name", "s", r.choice(["é", "b", None, f"v{i}"])), ("n", "i", str(i % 9)), ("d", "d", r.choice(["0.0", "-0.0", "1.5"]))][: r.randrange(4)]
        rows.append((r.choice("ab"), i, *shape, tags, 10**12 + i if i % 7 == 0 else None))
    rows += [("a", 1000, 2, [[]], [], None), ("a", 1001, 3, [], None, None), ("a", 1002, 3, None, None, None), ("b", 1003, 2, [[(0.0, -90.0), (10.0, 90.0)]], [("name", "b", "true")], None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_pieces_are_the_tile(spark, tmp_path, many_pieces):
    df, path = shapes(spark), f"file://{tmp_path}/tiles"
    got = pieces.write_pieces(spark, df, 2, path).collect()
    drawn = tiles.tile_shapes(df, 2).select("z", "x", "y", "layer", "pos", "type", "commands", "tags", "explicit_id")
    want = {(t.x, t.y): tiles.decode_tile(bytes(t.data)) for t in tiles.encode_tiles(drawn).collect()}
    assert len(got) > 5 * len(want)
    whole = {}
    for h in sorted(pieces.heads(spark, path).collect(), key=lambda h: (h.x, h.y, h.place)):
        body = b"".join(bytes(p.data) for p in sorted((p for p in got if (p.x, p.y, p.layer) == (h.x, h.y, h.layer)), key=lambda p: p.piece))
        whole[h.x, h.y] = whole.get((h.x, h.y), b"") + bytes(h.head) + body + bytes(h.tail)
    assert {k: tiles.decode_tile(v) for k, v in whole.items()} == want
    assert not any(map(tiles.violations, whole.values()))
    kinds = pieces.decoded_kinds(spark.read.parquet(f"{path}/pieces")).collect()
    assert sorted(map(tuple, kinds)) == sorted((2, x, y, a["name"], f["id"], f["type"]) for (x, y), t in want.items() for a in t for f in a["features"])


def test_checks_see_all_pieces(spark, tmp_path, many_pieces):
    """A conforming store has no faults; tags without entries, wrong geometry and a number in two pieces are seen."""
    df, path = shapes(spark), f"file://{tmp_path}/checked"
    stored = pieces.write_pieces(spark, df, 0, path)
    n = stored.groupBy().sum("n_features").first()[0]
    (row,) = pieces.conformance(spark, path).collect()
    assert (row.n_features, row.violations) == (n, 0)
    one = pieces.Piece(bytes(stored.where("n_features > 1").first().data))
    assert one.faults(10**6, 10**6) == 0 and one.faults(0, 0) > 0
    one.kinds[:] = 1
    assert one.faults(10**6, 10**6) == one.n
    h = pieces._repeated((pa.scalar(0), pa.scalar(0), pa.scalar(0), pa.scalar("a"), pa.scalar(1)), pa.table({"hashes": [np.array([1, 2], np.uint64).tobytes(), np.array([2], np.uint64).tobytes()]}))
    assert h.column("repeated").to_pylist() == [True]
