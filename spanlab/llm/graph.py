"""Connected components of an edge list by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _with_least(edges: DataFrame) -> DataFrame:
    """Each edge with the least end over all edges of its first; combined before the shuffle, so a hub is no long task."""
    low = edges.groupBy(F.col("a").alias("at")).agg(F.min("b").alias("low"))
    return edges.join(low, F.col("a") == F.col("at")).select("a", "b", F.least("a", "low").alias("m"))


def _stars(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    large = _with_least(both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.filter("a <> b").distinct()
    # every edge now runs from the larger to the smaller end
    ends = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b"))))
    return _with_least(large).select(ends.alias("e")).select("e.a", "e.b").filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge and isn't its component's smallest.

    ``edges`` has long columns a and b.  Each round is written to the shared folder, so
    lineage stays short; it ends when a round changes nothing, after some log of the
    number of nodes.
    """
    seen = None
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        # the sum of hashes is an order-free mark of the edge set
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark
        before, now = now, materialize(_stars(now), "stars")
        discard(before)
