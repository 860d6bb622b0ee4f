"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SALTS, Scratch


def _salted(edges: DataFrame) -> DataFrame:
    return edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))


def _least(edges: DataFrame) -> DataFrame:
    """The smallest neighbour of each node, once for each salt of its edges: a centre's edges meet it in SALTS parts, and
    only the parts' minima come together."""
    parts = edges.groupBy("a", "salt").agg(F.min("b").alias("m"))
    return parts.withColumn("m", F.min("m").over(Window.partitionBy("a")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _salted(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    least = _least(both).select("a", "salt", F.least("a", "m").alias("m"))
    return both.join(least, ["a", "salt"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = _salted(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    least = _least(down)
    others = down.join(least, ["a", "salt"]).filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges ``(a long, b long)`` to ``(node, component)``: one row per node with an edge, its component
    being the smallest node reachable.

    Alternates large-star and small-star rounds, each written to ``scratch``, until the stars stay as they
    are; the number of rounds grows with the logarithm of the longest path. Self loops and nulls are ignored,
    repeated edges count once, no edges give no rows.
    """
    now = scratch.written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct(), "edges")
    before = None
    while True:
        count, check = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if not count or (count, check) == before:
            break
        before = (count, check)
        now = scratch.written(_small_star(_large_star(now)), "stars")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
