"""Minimum spanning trees of link tables by Borůvka's rounds, as joins and aggregations on keys.

In a round every component takes its lightest link to another one; links are ordered by (length, ends), so the taken ones
hold no circle, and components at least halve. The taken links point each component at another; pointers are doubled by
self-joins until they reach the roots, which name the merged components. Links within a component go, and of those between
the same two only the lightest stays, so no component has more links than there are others.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumentrace.session import discard, written

#: Links of a group that one task may finish.
REDUCE = 500_000
#: Rows of two numbers that are broadcast at most: 16 MB.
SMALL = 1 << 20


def roots(pointers: DataFrame) -> DataFrame:
    """(c, top) of pointers (c, to) whose only circles are pairs that point at each other; the smaller of a pair is a root."""
    sized = F.broadcast if pointers.count() <= SMALL else lambda df: df
    other = sized(pointers.select(F.col("c").alias("to"), F.col("to").alias("back")))
    own = F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to"))
    held = written(pointers.join(other, "to").select("c", own.alias("top")), "roots")
    while True:
        above = sized(held.select(F.col("c").alias("top"), F.col("top").alias("next")))
        moved = written(held.join(above, "top").select("c", F.col("next").alias("top"), (F.col("next") != F.col("top")).alias("moved")), "roots")
        discard(held)
        held = moved.select("c", "top")
        if moved.where("moved").isEmpty():
            return held


def forest(links: DataFrame, finish: Callable[[pd.DataFrame], pd.DataFrame], reduce_to: int = REDUCE) -> DataFrame:
    """(sid, a, b, d): the links of a minimum spanning forest of each group ``sid`` of links (sid, a, b, d) with length d.

    Ends are numbers that no two groups share. Rounds go on while a group has more than ``reduce_to`` links between its
    components; what is left then ``finish`` does in one task for each group: of (p, q, a, b, d) rows, p and q being the
    components that a link joins, it keeps those of a spanning forest.
    """
    ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    live = written(links.where("a <> b").groupBy("sid", *ends).agg(F.min("d").alias("d")).select("sid", F.col("a").alias("p"), F.col("b").alias("q"), "a", "b", "d"), "links")
    taken = []
    while not live.groupBy("sid").count().where(F.col("count") > reduce_to).isEmpty():
        link = F.struct("d", "a", "b", "p", "q").alias("e")
        both = live.select("sid", F.explode(F.array("p", "q")).alias("c"), link)
        light = both.groupBy("sid", "c").agg(F.min("e").alias("e")).select("sid", "c", F.when(F.col("c") == F.col("e.p"), F.col("e.q")).otherwise(F.col("e.p")).alias("to"), "e.a", "e.b", "e.d")
        light = written(light, "lightest")
        taken.append(light.select("sid", "a", "b", "d").distinct())
        top = roots(light.select("c", "to"))
        sized = F.broadcast if top.count() <= SMALL else lambda df: df
        met = live.join(sized(top.select(F.col("c").alias("p"), F.col("top").alias("x"))), "p").join(sized(top.select(F.col("c").alias("q"), F.col("top").alias("y"))), "q").where("x <> y")
        kept = met.groupBy("sid", F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q")).agg(F.min(F.struct("d", "a", "b")).alias("e"))
        new = written(kept.select("sid", "p", "q", "e.a", "e.b", "e.d"), "links")
        discard(live, top)
        live = new
    rest = live.groupBy("sid").applyInPandas(finish, "sid long, a long, b long, d double")
    return reduce(DataFrame.unionByName, taken, rest)
