"""Connected components of a link table, by alternating large-star and small-star steps.

Links stay in tables of the shared folder.  Every step joins links to one minimum per
node, so a node with very many links is split like any other skewed join key and its
neighbours are never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from rankwell.session import written


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of a node point to the least of its neighbourhood."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "u")
    return both.filter(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("u")).select(
        F.col("b").alias("a"), F.col("m").alias("b")
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and the node itself, point to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
    joined = down.join(least, F.col("a") == F.col("u")).select("b", "m").filter(F.col("b") != F.col("m"))
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
        least.select(F.col("u").alias("a"), F.col("m").alias("b"))
    )


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node with a link; the component is its least node.

    ``links`` has columns a and b, in any direction, repeated or not; a node linked
    to itself only is left out, as are NULLs.
    """
    now = links.select("a", "b").filter("a <> b").distinct()
    before = None
    while True:
        seen = Observation()
        step = _small_star(_large_star(now)).distinct().observe(
            seen,
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("sum"),
        )
        now = written(step, "links")
        state = (seen.get["n"], seen.get["sum"])
        if state == before:
            break
        before = state
    # every link now goes from a node straight to the least node of its component
    pairs = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return pairs.union(roots).distinct()
