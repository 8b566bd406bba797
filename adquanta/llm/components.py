"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b); the root is the smallest node reachable.

    Rounds of large and small stars: every neighbour moves to the smallest node
    that its partner knows, first the larger neighbours, then the smaller ones.
    The number of rounds grows with the logarithm of the longest path. Edges
    stay distributed; a round is one staged table and no list of neighbours.
    """
    def star(edges: DataFrame, large: bool) -> DataFrame:
        ways = edges.select("a", "b")
        if large:
            ways = ways.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = ways.join(least.hint("merge"), "a")
        if large:
            out = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")) \
                .union(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    state = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .where("a <> b").distinct(), "links")
    before = None
    for _ in range(most_rounds):
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38, 0)"))).first()
        if mark == before:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                state.select("b", "b")).distinct()
        before = mark
        state = stage(star(star(state, True), False), "links")
    raise RuntimeError(f"components are not complete after {most_rounds} rounds")
