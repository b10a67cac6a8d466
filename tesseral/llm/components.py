"""Connected components of a link table by alternating large-star and small-star rounds."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Edges up to which a round broadcasts the least neighbours of their nodes (two nodes an edge at most).
FEW_EDGES = 100_000


def _state(edges: DataFrame) -> tuple:
    """One row that changes whenever the set of edges does: two numbers come to the driver."""
    h = F.xxhash64("u", "v")
    row = edges.agg(F.count("*").alias("n"), F.sum(F.shiftright(h, 20)).alias("a"), F.bit_xor(h).alias("b")).first()
    return tuple(row)


def _beside_least(rows: DataFrame, least: DataFrame, few: bool) -> DataFrame:
    """``rows`` joined with ``least`` on u.

    A crowded node has as many rows as neighbours.  Few nodes are broadcast; else their table is
    written first, so that both sides of the join are plain shuffles which adaptive execution can
    split (a side that ends in an aggregate cannot be split).
    """
    return rows.join(F.broadcast(least) if few else materialise(least, "least"), "u")


def _large(edges: DataFrame, few: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _beside_least(both, least, few).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame, few: bool) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = _beside_least(edges, least, few).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, most_rounds: int = 60, few_edges: int = FEW_EDGES) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long) that is not the least of its component.

    ``root`` is the least node of the component.  Loops and repeated edges are fine; null ends are
    dropped; no edges give no rows.  Each round is written to the shared folder, so a lost executor
    costs at most one round; minima are combined before each shuffle.  Up to ``few_edges`` edges the
    minima (16 bytes a node) are broadcast, beyond they are joined by shuffles that can be split.
    """
    ordered = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), (F.col("u").isNotNull() & F.col("v").isNotNull()).alias("ok"))
    now = materialise(ordered.where("ok and u > v").select("u", "v").distinct(), "edges")
    before = _state(now)
    for _ in range(most_rounds):
        if before[0] == 0:
            break
        few = before[0] <= few_edges
        large = materialise(_large(now, few).where("u > v").distinct(), "large") if not few else _large(now, few)
        now = materialise(_small(large, few).where("u > v").distinct(), "edges")
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
