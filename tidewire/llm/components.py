"""Connected components of an edge table, by alternating star contractions.

Each round moves every node's neighbours to the least node around it (first the
larger neighbours, then the smaller ones), which ends in stars after a number
of rounds that grows with the logarithm of the component size. All of it is
joins and partial aggregates; the driver sees one count and one checksum a
round. Tables of few edges are held in few partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, width

#: Edges that a task takes on with ease.
EDGES = 100_000


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, large: bool, fit) -> DataFrame:
    around = _both(edges)
    if not large:
        around = around.filter("b < a")
    least = fit(around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
    moved = fit(around.join(least, "a"))
    if large:
        moved = moved.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return fit(moved.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node of an edge (a long, b long)."""
    spark = edges.sparkSession
    edges = materialize(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = parts = None
    while True:
        row = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(2**40))).alias("s")).first()
        if (row["n"], row["s"]) == state or not row["n"]:
            break
        state = (row["n"], row["s"])
        # Stars never have more edges than there were at first.
        parts = parts or min(width(spark), max(8, row["n"] // EDGES + 1))
        fit = lambda df: df.coalesce(parts)
        edges = materialize(_star(_star(fit(edges), True, fit), False, fit), "edges")
    stars = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return stars.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
