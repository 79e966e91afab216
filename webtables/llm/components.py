"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root): each node of the edges ``a``, ``b`` with the smallest node of its component.

    Loops and repeated edges do no harm; edges with a null end are left out. Minimums are combined before they are
    shuffled and every join has one row per node on one side, so a hub with very many edges is dealt out by Spark.
    The edges are read once; each round is written, so that the next reads files of known size in few tasks, however
    many partitions its shuffles had.
    """
    ends = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    first = written(edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select(*ends).distinct())
    edges = first.where("a != b")
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b")).where(F.col("a") != F.col("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").where(F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = written(small.union(low.select("a", F.col("low").alias("b"))).distinct())
        now = _state(edges)
        if now == state:
            break
        state = now
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    own = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    linked = found.union(own)
    # every other node is an end of an edge still
    loops = first.where("a = b").join(linked.select(F.col("node").alias("a")), "a", "left_anti").select(F.col("a").alias("node"), F.col("a").alias("root"))
    return linked.union(loops)
