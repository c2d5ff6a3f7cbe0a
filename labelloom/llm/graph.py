"""Connected components of an edge table by alternating star contraction.

Every round replaces the edges of a vertex by edges to the smallest vertex it
sees (large star: for the larger neighbours; small star: for the smaller ones),
which keeps components and ends when every edge points from a vertex to the
smallest one of its component.  A round is joins and grouped minima; hubs are
split by Spark's skew join and combined before the shuffle.  The edges of every
round are written to the shared folder, so a lost executor costs one re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from labelloom.plans.scratch import materialize


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def _star(directed: DataFrame) -> DataFrame:
    """For every edge u -> v: v with the smallest of u and its v."""
    least = directed.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return directed.join(least, "u").select("u", "v", "m")


def _edges(pairs: DataFrame) -> DataFrame:
    """Distinct edges a > b of the given columns v and m."""
    return (
        pairs.where(F.col("v") != F.col("m"))
        .select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b"))
        .groupBy("a", "b")
        .agg(F.lit(1).alias("_"))
        .select("a", "b")
    )


def components(links: DataFrame) -> DataFrame:
    """(vertex, root) of every vertex that has a link; ``links`` are columns a
    and b in any order, repeats and loops allowed."""
    edges = materialize(_edges(links.select(F.col("a").alias("v"), F.col("b").alias("m"))), "edges")
    seen = _state(edges)
    while seen[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        large = materialize(_edges(_star(both).where(F.col("v") > F.col("u"))), "large_star")
        down = _star(large.select(F.col("a").alias("u"), F.col("b").alias("v")))
        pairs = down.select("v", "m").unionAll(down.select(F.col("u").alias("v"), "m"))
        edges = materialize(_edges(pairs), "small_star")
        now = _state(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("vertex"), "root").distinct())
