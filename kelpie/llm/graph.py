"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import checkpointed, written


def components(edges, rounds=60):
    """(node, root) of every node of edges (a, b; longs): root is the least node of its component.

    Each half round links nodes to the least neighbour seen, with a table of minima that is cut from its lineage and
    joined back, so that a hub's many edges can be split. It ends when every edge leads to a root. Null ends are
    ignored; nodes without edges aren't in the result.
    """
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(F.col("a") < F.col("b")).distinct(), "edges")
    for _ in range(rounds):
        # large star: the greater neighbours of u move to the least neighbour of u
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        large = checkpointed(large)
        # small star: u and its lesser neighbours move to the least of them
        least = checkpointed(large.groupBy("b").agg(F.min("a").alias("m")))
        moved = large.join(least, "b").select(F.col("m"), F.explode(F.array("a", "b")).alias("v"))
        new = checkpointed(moved.where(F.col("m") < F.col("v")).select(F.col("m").alias("a"), F.col("v").alias("b")).distinct())
        # done when no node is both a root and below one
        inner = new.select("a").distinct().join(new.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count()
        double = 0 if inner else new.groupBy("b").count().where("count > 1").limit(1).count()
        edges = new
        if not inner and not double:
            break
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
