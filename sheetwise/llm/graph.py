"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest id that each id of edges (a, b) reaches. edges is read several times: pass a kept table.

    Alternating large-star and small-star steps, each a grouped minimum and a join, so that neither a long chain nor
    a vertex with very many neighbours needs many rounds or one task. Ends when what is left are stars: then every edge
    leads to the least id of its component, and no further round is needed to see it.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    while True:
        # Large star: every larger neighbour of v links to the least of v and its neighbours. An edge gives one row, so these need no distinct.
        both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        edges = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: v and its smaller neighbours link to the least of those.
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        linked = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))
        edges = cut(edges.join(low, "a").select(F.inline(linked)).where("a <> b").distinct())
        # No star: an id with two edges upwards, or one that others lead to and that leads on itself.
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
        if ends.groupBy("e.v").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty():
            break
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("comp")).union(roots)
