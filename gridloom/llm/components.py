"""Connected components by alternating large-star and small-star rounds on a DataFrame of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import discard, stored


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every node passes its larger neighbours on to the smallest node that it knows.  Also the stored minima."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every node links itself and its smaller neighbours to the smallest of them.  Also the stored minima."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = stored(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))), least


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of the component of each node that has a link.

    edges: (u, v), longs, in any direction, repeats allowed.  Groups are never gathered: each round is a min
    aggregate with partial results and a join.  The minima are stored before they are joined: the links then come to
    the join by a shuffle of their own, which adaptive execution splits where a node has many.  Every round is
    stored in the shared folder, so a lost executor costs at most one round.
    """
    now = stored(edges.filter("u <> v").distinct(), "links")
    state = None
    for _ in range(max_rounds):
        large, least1 = _large_star(now)
        small, least2 = _small_star(large)
        before, now = now, stored(small.filter("u <> v").distinct(), "links")
        discard(before, least1, least2)
        row = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == state:
            break
        state = tuple(row)
    else:
        raise RuntimeError(f"no fixed point in {max_rounds} rounds")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.union(leaves.select(F.col("root").alias("node"), "root").distinct())
