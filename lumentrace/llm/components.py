"""Connected components of link tables by alternating star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumentrace.llm.common import discard, written


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in ``links`` (a, b).

    Each round points every node's larger neighbours, then its smaller ones, at the least neighbour, until nothing
    changes; the number of rounds grows with the logarithm of the longest path. Each round is a table in the shared folder.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        new = written(small.select("e.a", "e.b").where("a <> b").distinct(), "links")
        same = new.count() == edges.count() and new.join(edges, ["a", "b"], "left_anti").isEmpty()
        discard(edges)
        edges = new
        if same:
            break
    tops = edges.select(F.col("b").alias("id"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(tops).groupBy("id").agg(F.min("component").alias("component"))
