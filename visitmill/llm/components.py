"""Connected components of a graph held as an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitmill.llm.shared import attach, saved, scratch


def _minimum(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns u, v of one type): root is the smallest node of its component.

    Each round is two joins; the number of rounds grows with the logarithm of the longest path. A node with very many neighbours
    (a thousandth of all edges) gets its minimum by broadcast, so its edges never meet in one task. Loops and repeated edges do no harm; no edges give no rows.
    """
    folder = scratch(edges.sparkSession)
    both = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before, number = saved(both, "edges", folder), None, 0
    while True:
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if state == before:
            break
        before, number = state, number + 1
        around = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = saved(_minimum(around).select("u", F.least("u", "m").alias("m"), "n"), f"least{number}", folder)
        large = saved(attach(around, least, "u", state[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")),
                      f"large{number}", folder)
        small = attach(large, saved(_minimum(large), f"least_of_large{number}", folder), "u", state[0])
        now = saved(small.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                                  F.struct(F.col("u"), F.col("m").alias("v"))))).filter("u <> v").distinct(),
                    f"round{number}", folder)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
