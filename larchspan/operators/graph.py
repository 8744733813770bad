"""Connected components over an edge table, by alternating large-star and small-star steps as joins and minimum
aggregates.  No adjacency list is ever gathered: each step is a partial aggregate and a join, so a component of any
size is spread over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larchspan.session import checkpointed


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """`edges` (a long, b long), a <> b -> (node, root): root is the smallest node reachable; isolated nodes are absent."""
    now = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    for _ in range(most_rounds):
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small_least, "a")
        now = checkpointed(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(small_least.select("a", F.col("m").alias("b"))).distinct())
        # a forest of stars is a fixed point; its size and sums stop changing only there
        state = now.agg(F.count(F.lit(1)), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not converge")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
