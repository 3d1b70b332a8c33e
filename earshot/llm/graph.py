"""Connected components of a graph kept as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import checkpointed, weighted_join

#: Rounds after which components() gives up; each at least halves the distances, so this is far more than it needs.
ROUNDS = 60


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (u, v): component is the smallest node that can be reached.

    Alternating large-star and small-star steps: every node's greater neighbours, then its smaller ones and itself, are
    tied to its least neighbour, until only stars are left. Each step's least neighbours are aggregated on the map side;
    a node with many neighbours is joined by broadcast, apart from the others. Edges are checkpointed after each round.
    """
    now = checkpointed(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(now)
    for _ in range(ROUNDS):
        if not mark[0]:
            break
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("w"))
        large = weighted_join(both, least, "u", "w").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        down = checkpointed(down)
        least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("w"))
        tied = weighted_join(down, least, "u", "w").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = tied.unionAll(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now = checkpointed(small)
        last, mark = mark, _mark(now)
        if mark == last:
            break
    else:
        raise RuntimeError("components did not converge")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
