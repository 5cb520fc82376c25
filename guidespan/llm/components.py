"""Connected components of an edge table, by star contraction in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guidespan.llm.common import cut, met, sized


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """From edges (a, b): every node with the least node of its component, (node, root). Nodes without an edge are not returned.

    Each round first links the larger neighbours of a node to its least one, then the smaller ones: components become stars in a
    number of rounds that grows with the logarithm of their size. A node that has a large share of all edges gets its least neighbour
    by broadcast, so no task sees all edges of a star. Every round is written to the checkpoint folder, in partitions by the number of edges. Self-loops, repeated edges
    and nulls add nothing; an empty table gives an empty result.
    """
    stars = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    rows = stars.count()
    if not rows:
        return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    stars, before = sized(stars, rows), None
    for _ in range(most_rounds):
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        stars = met(both, least, "a", "n", 2 * rows).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        stars = sized(sized(stars, rows).distinct(), rows)
        low = stars.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        stars = met(stars, low, "a", "n", rows).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b")
        stars = cut(sized(sized(stars, rows).distinct(), rows))
        # The sum over a star forest stays the same once nothing moves.
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")).first()
        if before is not None and now == before and now[0] == now[2]:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before, rows = now, now[0]
    raise RuntimeError(f"no components after {most_rounds} rounds")
