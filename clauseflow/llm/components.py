"""Consolidating pairwise matches into groups.

The largest component of a match graph usually hangs on a hub. It is peeled off first: a
breadth-first search runs from the vertex of the highest degree, each frontier a table joined
to the edges, and what it reaches is anti-joined away. The rest are small components, labelled by
propagating minima (operators.graph). The search goes on until its frontier is empty; only where the component is a chain of
more than `max_hops` links from the hub, what was reached shrinks to one vertex and takes part in the propagation: the
number of rounds is bounded, and no link is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseflow.operators.graph import propagate_min
from clauseflow.session import Shelf

#: Links from the hub after which a search gives way to propagation, whose rounds grow with the logarithm of a chain.
MAX_HOPS = 64


def link_groups(links: DataFrame, one: str = "before_id", many: str = "after_ids", max_hops: int = MAX_HOPS) -> DataFrame:
    """(member_id, group_id): one row per id in `one` or `many`; group_id is the smallest id linked to it.

    All non-null ids of one row belong together. A row with one id only gives a group of that id alone
    unless other rows link it; rows without ids, null and empty arrays, null members and repeated rows change nothing;
    an empty table gives an empty result; other columns play no part.
    """
    spark = links.sparkSession
    shelf = Shelf(spark, "groups")
    ids = F.array_distinct(F.filter(F.concat(F.array(F.col(one)), F.coalesce(F.col(many), F.array().cast("array<string>"))), lambda x: x.isNotNull()))
    rows = links.select(ids.alias("ids")).filter("size(ids) > 0")
    # a row is a star round its smallest id: as many edges as ids, never all pairs
    star = shelf.put(rows.select(F.explode("ids").alias("u"), F.array_min("ids").alias("v")).distinct())
    edges = star.filter("u <> v")
    sym = shelf.put(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    hub = sym.groupBy("u").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "u").limit(1).select("u")
    hub = hub.first()
    if hub is None:
        return star.select(F.col("u").alias("member_id"), F.col("v").alias("group_id")).distinct()

    frontier = shelf.put(spark.createDataFrame([(hub[0],)], sym.select("u").schema))
    reached, hops, open_end = frontier, 0, True
    while hops < max_hops:
        new, seen = shelf.put_seen(sym.join(frontier, "u", "left_semi").select(F.col("v").alias("u")).distinct().join(reached, "u", "left_anti"), n=F.count(F.lit(1)))
        hops += 1
        if not seen["n"]:
            open_end = False
            break
        frontier, reached = new, reached.unionByName(new)
    reached, seen = shelf.put_seen(reached, low=F.min("u"))
    label = seen["low"]
    rest = edges.join(reached.select("u"), "u", "left_anti")
    if open_end:  # the search was cut: its vertices become one, under their smallest id
        giant = label
        inside = reached.withColumn("in", F.lit(True))
        a = edges.join(inside, "u", "left").select(F.when(F.col("in"), F.lit(giant)).otherwise(F.col("u")).alias("u"), "v")
        rest = a.join(inside.select(F.col("u").alias("v"), "in"), "v", "left").select("u", F.when(F.col("in"), F.lit(giant)).otherwise(F.col("v")).alias("v"))
    small = shelf.put(propagate_min(rest, shelf))
    if open_end:
        above = small.filter(F.col("node") == label).select("label").first()
        small = small.filter(F.col("node") != label)
        label = above[0] if above else label
    labels = small.unionByName(reached.select(F.col("u").alias("node"), F.lit(label).alias("label")))
    alone = star.select(F.col("u").alias("node")).distinct().join(labels, "node", "left")
    return alone.select(F.col("node").alias("member_id"), F.coalesce("label", "node").alias("group_id"))
