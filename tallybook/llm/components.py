"""Connected components by alternating large and small stars.

Edges are rewritten until every node points at the least node of its component. Each step is a minimum per node with
partial results in the map tasks and a join; the number of steps grows with the logarithm of the graph, nothing is
gathered, and every step is written to the shared folder, so a lost executor costs one step at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.observed import stored_and_counted


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    over = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return over.union(least).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has an edge, except the roots; the root is the least node of the component.

    The rows of a step and a sum over them are observed while it is written: equal to those of the step before, nothing moved.
    """
    code = F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now, seen = stored_and_counted(now, "edges", code)
    while seen[0]:
        now, mark = stored_and_counted(_small(_large(now)), "edges", code)
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) after more links (a, b): only the links between different components are followed, as edges of their roots."""
    if roots is None:
        return components(links)
    ends = links.select("a", "b")
    for end in ("a", "b"):
        of = roots.select(F.col("node").alias(end), F.col("root").alias("_root"))
        ends = ends.join(of, end, "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
    joined = components(ends.where("a <> b"))
    new = joined.select(F.col("node").alias("root"), F.col("root").alias("_new"))
    moved = roots.join(new, "root", "left").select("node", F.coalesce("_new", "root").alias("root"))
    return stored_and_counted(moved.union(joined), "roots")[0]
