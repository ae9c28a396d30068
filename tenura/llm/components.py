"""Connected components by alternating large-star and small-star.

Each step is one aggregation (the least neighbour of each node, combined map-side) and
one equi-join that AQE can split, so a star with a third of all nodes is no single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.llm.frames import cut_lineage


def _large_star(e: DataFrame) -> DataFrame:
    """Larger neighbours of every node move to its least neighbour (or itself)."""
    s = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    m = s.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (s.filter("v > u").join(m, "u").filter("v <> m")
            .select(F.least("v", "m").alias("a"), F.greatest("v", "m").alias("b")).distinct())


def _small_star(e: DataFrame) -> DataFrame:
    """Smaller neighbours of every node, and the node, move to the least of them."""
    s = e.select(F.col("b").alias("u"), F.col("a").alias("v"))          # a < b
    m = s.groupBy("u").agg(F.min("v").alias("m"))
    moved = s.join(m, "u").filter("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return moved.unionByName(m.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return r.n, r.x


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> (v, comp) for every node with an edge; comp is the least node."""
    e = cut_lineage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                    .filter("a <> b").distinct())
    state = _state(e)
    while state[0]:
        e = cut_lineage(_small_star(_large_star(e)))
        now = _state(e)
        if now == state:
            break
        state = now
    return e.select(F.col("b").alias("v"), F.col("a").alias("comp")).unionByName(
        e.select(F.col("a").alias("v"), F.col("a").alias("comp")).distinct())
