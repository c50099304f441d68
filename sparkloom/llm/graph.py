"""Connected components of an edge table, by alternating large and small stars
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def _mark(edges: DataFrame) -> tuple:
    """Tells one set of edges from another."""
    one = edges.select(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 998_244_353))
    return tuple(one.first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges ``a``, ``b``; root is the smallest
    node of its component. Self-loops, repeated and reversed edges are harmless;
    no edges give no rows. Each round is written to the shared folder, so a lost
    executor costs at most a round. A star's centre is an aggregate (min) and its
    leaves stay rows: no task holds a whole neighbourhood."""
    now = cut(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    mark = _mark(now)
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = (
            joined.select("a", F.col("m").alias("b"))
            .union(joined.where("b <> m").select("b", "m"))
            .distinct()
        )
        new = cut(small, "edges")
        was, mark = mark, _mark(new)
        drop_cut(now)
        now = new
        if mark == was:
            roots = now.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
