"""Connected components by alternating large-star and small-star steps; every step is a join, nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import drop, stage


def _with_least(edges: DataFrame) -> DataFrame:
    """Each (u, v) with the least neighbour of u. Partial minima come first, so a hub is one row a task before the join."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = _with_least(down)
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, label) of every node that has an edge (u, v): label is the least id that can be reached.

    The table of each round is written to the shared folder and the one before it deleted. Loops (u = v) say nothing.
    """
    now = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        after = stage(_small_star(_large_star(now)), "edges")
        drop(now)
        now = after
        # A fingerprint of the whole edge set: rows and the sum of their hashes.
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("label")).union(now.select(F.col("v").alias("id"), F.col("v").alias("label"))).distinct()
