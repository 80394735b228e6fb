"""Connected components of a graph given as an edge table, by alternating star contractions."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precinct.session import settle


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b"), F.col("a")))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the smallest node reachable.

    A large-star step ties each larger neighbour of a node to the smallest one, a small-star step the smaller ones; both
    only keep connectivity and lower labels, and the table never grows.  The number of rounds is logarithmic in the
    longest chain.  Each round is checkpointed in the shared folder.  A node's neighbours are never gathered: a star's
    minimum is an aggregate, joined back to its edges.
    """
    now = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = _state(now)
    while before[0]:
        both = _both(now)
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = settle(small.select("e.a", "e.b").where("a <> b").distinct())
        after = _state(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b"), F.col("b")).distinct())
