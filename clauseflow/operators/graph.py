"""Connected components by propagating minima: every node gets the smallest id that it is linked to.

Alternating large-star and small-star steps hang each node on the smallest neighbour it has seen. A
chain shortens by a constant factor a step, so the number of steps grows with the logarithm
of the longest chain, and no step gathers a neighbourhood in one place: minima are pre-aggregated
before the shuffle and joined back, where adaptive execution splits hot keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseflow.session import Shelf


def _star(e: DataFrame, large: bool) -> DataFrame:
    """e: (u, v), v < u. One large-star or small-star step; the result again has v < u."""
    if large:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        return both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    return (
        e.join(low, "u")
        .select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))))
        .filter("u > v")
        .distinct()
    )


def propagate_min(edges: DataFrame, shelf: Shelf | None = None) -> DataFrame:
    """(node, label): label is the smallest id of the component; edges has columns u and v of one type.

    Gives a row for every node that has an edge to another one; rows with a null on either side and loops
    are left out, repeated edges count once; an empty table gives an empty result.
    """
    shelf = shelf or Shelf(edges.sparkSession, "components")
    hi, lo = F.greatest("u", "v"), F.least("u", "v")
    e = shelf.put(edges.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(hi.alias("u"), lo.alias("v")).distinct())
    mark = None
    while True:
        # the same edges again: nothing moved
        step, now = shelf.put_seen(_star(_star(e, True), False), n=F.count(F.lit(1)), sum=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
        shelf.drop(e)
        e = step
        if now == mark:
            break
        mark = now
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots.select("node", F.col("node").alias("label")))
