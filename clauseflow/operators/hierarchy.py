"""Parent-child rows to full hierarchies: paths, depths, roots, subtree sizes, descendants, circles.

Leaves are peeled off bottom-up. A peeled node sends its subtree size to its parent and lowers
the parent's count of children still to come; several rounds run in one job, one shuffle each.
What is never peeled lies on a circle. Going back through the layers in the reverse order of
peeling, a node takes path, depth and root from the ancestor it hangs on; layers are taken
in ranges that halve (64-33, 32-17, ...), and chains inside a range are shortened by doubling,
so a hierarchy H high needs about log2(H) passes on the way down, not H.

Lists of descendants are rows (ancestor, descendant, distance), never an array in one
row: one node may have a third of all nodes below it.

Where only roots and depths are asked for (`roots_and_depths`), no path is carried, and chains of nodes with one child each are
contracted between jobs of peeling, by doubling, so that a hierarchy however high is peeled in a number of rounds that grows with the
logarithm of its nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseflow.session import Shelf

ROUNDS_A_JOB = 8


def _nodes(df: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """One row per id; of several parents of one id the smallest that isn't blank."""
    p = F.col(parent_col).cast("string")
    return (
        df.select(F.col(id_col).cast("string").alias("id"), F.when(F.trim(F.regexp_replace(p, r"(?U)\s+", " ")) != "", p).alias("p"))
        .filter("id IS NOT NULL")
        .groupBy("id")
        .agg(F.min("p").alias("p"))
    )


def hierarchy(df: DataFrame, id_col: str = "id", parent_col: str = "parent") -> DataFrame:
    """(unit_id, parent_id, root_id, depth, path, subtree_size, on_circle, chain), one row per distinct id.

    parent_id is null for roots: a null, blank or unknown parent makes a root of depth 0. Where the
    chain of parents never ends, depth is -1, root_id the smallest id on the circle, path null. chain is the path, but
    there it begins with the node of the circle that the node hangs on (or is).
    subtree_size counts the node itself and all nodes below it; on a circle, the nodes
    hanging on that node from outside the circle. Null ids are left out; repeated rows count once;
    an empty table gives an empty result; other columns of df play no part.
    """
    spark = df.sparkSession
    shelf = Shelf(spark, "hierarchy")
    # a number for each id, fixed by writing it: joins and sums then move longs, not strings
    ids = shelf.put(_nodes(df, id_col, parent_col).withColumn("n", F.monotonically_increasing_id()))
    parents = ids.select(F.col("id").alias("p"), F.col("n").alias("pn"))
    linked = ids.join(parents, "p", "left").select("n", "id", "pn", F.when(F.col("pn").isNotNull(), F.col("p")).alias("parent_id"))
    linked = shelf.put(linked)
    kids = linked.filter("pn IS NOT NULL").groupBy(F.col("pn").alias("n")).agg(F.count("*").alias("pending"))
    state = linked.select("n", "pn").join(kids, "n", "left").select("n", "pn", F.coalesce("pending", F.lit(0)).alias("pending"), F.lit(1).cast("long").alias("size"), F.lit(None).cast("int").alias("peeled"))

    layers, alive, top = [], None, 0
    while True:
        for _ in range(ROUNDS_A_JOB):
            top += 1
            state = _peel(state, top)
        state = shelf.put(state)
        left, peeled = state.agg(F.count(F.when(F.col("peeled").isNull(), 1)), F.count("peeled")).first()
        layers.append(state.filter("peeled IS NOT NULL"))
        alive = state.filter("peeled IS NULL")
        if left == 0 or peeled == 0:
            break
        state = alive

    layered = layers[0]
    for x in layers[1:]:
        layered = layered.unionByName(x)
    node = linked.select("n", "id", "pn", "parent_id")
    info = shelf.put(layered.select("n", "peeled", "size").join(node, "n"))
    done = [shelf.put(_circles(shelf, alive.select("n", "size").join(node, "n")))] if left else []
    high = info.agg(F.max("peeled")).first()[0] or 0
    while high > 0:
        low = high // 2
        part = info.filter((F.col("peeled") > low) & (F.col("peeled") <= high))
        done.append(shelf.put(_assign(shelf, part, high - low, done)))
        high = low
    if not done:
        done = [shelf.put(_assign(shelf, info, 1, []))]
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select(F.col("id").alias("unit_id"), "parent_id", "root_id", "depth", F.when(F.col("depth") >= 0, F.col("chain")).alias("path"), F.col("size").alias("subtree_size"), "on_circle", "chain")


def roots_and_depths(df: DataFrame, id_col: str = "id", parent_col: str = "parent", rounds: int = ROUNDS_A_JOB) -> DataFrame:
    """(unit_id, root_id, depth), one row per distinct id, as `hierarchy` gives them.

    Leaves are peeled `rounds` times a job; then chains of nodes with one child left are contracted to one edge that remembers its steps and
    the smallest id it stands for. What is left once neither goes on are circles. Taken back in reverse order, each node finds root and
    depth at the node its edge led to when it was taken out.
    """
    shelf = Shelf(df.sparkSession, "roots")
    ids = shelf.put(_nodes(df, id_col, parent_col).withColumn("n", F.monotonically_increasing_id()))
    linked = ids.join(ids.select(F.col("id").alias("p"), F.col("n").alias("pn")), "p", "left").select("n", "id", "pn")
    kids = linked.filter("pn IS NOT NULL").groupBy(F.col("pn").alias("n")).agg(F.count("*").alias("pending"))
    state = linked.join(kids, "n", "left").select("n", "id", "pn", F.coalesce("pending", F.lit(0)).alias("pending"), F.lit(1).cast("long").alias("steps"), F.lit(None).cast("string").alias("low"), F.lit(None).cast("int").alias("peeled"))
    taken: list[tuple[DataFrame, int]] = []  # (n, id, at, steps) and over how many layers its edges may lead
    while True:
        for k in range(rounds):
            state = _strip(state, k + 1)
        state, seen = shelf.put_seen(state, left=F.count(F.when(F.col("peeled").isNull(), 1)), gone=F.count("peeled"), single=F.count(F.when(F.col("peeled").isNull() & (F.col("pending") == 1), 1)))
        if seen["gone"]:
            taken.append((state.filter("peeled IS NOT NULL").select("n", "id", F.col("pn").alias("at"), "steps"), rounds))
        state = state.filter("peeled IS NULL")
        if not seen["left"]:
            break
        # fewer single nodes than half: at least a quarter are leaves by now
        chains, state = _contracted(shelf, state, seen["single"]) if 2 * seen["single"] >= seen["left"] or not seen["gone"] else (None, state)
        if chains is not None:
            taken.append((chains, 1))
        elif not seen["gone"]:
            break
    done = [shelf.put(_circle_roots(shelf, state))] if seen["left"] else []
    for part, layers in reversed(taken):
        done.append(shelf.put(_resolved(part, layers, done)))
    out = ids.limit(0).select("n", "id", F.col("id").alias("root_id"), F.lit(0).cast("long").alias("depth"))
    for x in done:
        out = out.unionByName(x)
    return out.select(F.col("id").alias("unit_id"), "root_id", "depth")


def _strip(state: DataFrame, round_no: int) -> DataFrame:
    """One round: nodes with no child to come are taken out and tell their parent."""
    leaf = F.col("peeled").isNull() & (F.col("pending") == 0)
    none = lambda t: F.lit(None).cast(t)
    me = F.struct("n", "id", "pn", "pending", "steps", "low", F.when(leaf, F.lit(round_no)).otherwise(F.col("peeled")).alias("peeled"))
    up = F.struct(F.col("pn").alias("n"), none("string").alias("id"), none("long").alias("pn"), F.lit(-1).cast("long").alias("pending"), none("long").alias("steps"), none("string").alias("low"), none("int").alias("peeled"))
    rows = state.select(F.inline(F.when(leaf & F.col("pn").isNotNull(), F.array(me, up)).otherwise(F.array(me))))
    first = lambda c: F.max(c).alias(c)  # noqa: E731 - one row of a node has it, the others null
    return rows.groupBy("n").agg(first("id"), first("pn"), F.sum("pending").alias("pending"), first("steps"), first("low"), first("peeled"))


def _contracted(shelf: Shelf, state: DataFrame, single: int) -> tuple[DataFrame | None, DataFrame]:
    """Nodes with one child left and a parent, taken out with an edge to the first node above that isn't one (None if there are none), and the
    others, whose edges skip them. Circles of such nodes only stay."""
    if not single:
        return None, state
    cur = shelf.put(state.filter("pending = 1 AND pn IS NOT NULL AND pn <> n").select("n", "id", F.col("pn").alias("at"), "steps", "low"))
    chain = cur.select(F.col("n").alias("at"))
    before = None
    while True:
        o = cur.select(F.col("n").alias("at"), F.col("id").alias("id2"), F.col("at").alias("at2"), F.col("steps").alias("steps2"), F.col("low").alias("low2"))
        hit = F.col("at2").isNotNull()
        step = cur.join(o, "at", "left").select("n", "id", F.coalesce("at2", "at").alias("at"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), F.least("low", "low2", "id2").alias("low"), hit.alias("hit"))
        step, seen = shelf.put_seen(step, hits=F.count(F.when(F.col("hit"), 1)))
        cur = step.drop("hit")
        if seen["hits"] == before:  # a chain's end is nearer for some node after each step; these go round
            cur = cur.join(chain, "at", "left_anti")
        if seen["hits"] in (0, before):
            break
        before = seen["hits"]
    cur, seen = shelf.put_seen(cur, n=F.count(F.lit(1)))
    if not seen["n"]:
        return None, state
    over = cur.select(F.col("n").alias("pn"), F.col("id").alias("id2"), F.col("at").alias("at2"), F.col("steps").alias("steps2"), F.col("low").alias("low2"))
    rest = state.join(cur.select("n"), "n", "left_anti").join(over, "pn", "left")
    rest = rest.select("n", "id", F.coalesce("at2", "pn").alias("pn"), "pending", (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), F.least("low", "low2", "id2").alias("low"), "peeled")
    return cur.select("n", "id", "at", "steps"), shelf.put(rest)


def _circle_roots(shelf: Shelf, rest: DataFrame) -> DataFrame:
    """(n, id, root_id, depth -1): the smallest id on each circle, by doubling steps along it; edges stand for what they skip."""
    c = shelf.put(rest.select("n", "id", F.col("pn").alias("to"), F.least("id", "low").alias("low")))
    while True:
        o = c.select(F.col("n").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"))
        c, seen = shelf.put_seen(c.join(o, "to").select("n", "id", F.col("to2").alias("to"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("moved")), moved=F.count(F.when(F.col("moved"), 1)))
        c = c.drop("moved")
        if not seen["moved"]:
            return c.select("n", "id", F.col("low").alias("root_id"), F.lit(-1).cast("long").alias("depth"))


def _resolved(part: DataFrame, layers: int, done: list[DataFrame]) -> DataFrame:
    """Root and depth of nodes taken out together, from those taken out later."""
    # at: the nearest node above outside this part; null once a root leads the way, whose id is `top`
    cur = part.select("n", "id", "at", F.when(F.col("at").isNotNull(), F.col("steps")).otherwise(F.lit(0)).alias("steps"), F.when(F.col("at").isNull(), F.col("id")).alias("top"))
    span = 1
    while span < layers:
        o = cur.select(F.col("n").alias("at"), F.col("at").alias("at2"), F.col("steps").alias("steps2"), F.col("top").alias("top2"), F.lit(True).alias("hit"))
        cur = cur.join(o, "at", "left").select("n", "id", F.when(F.col("hit"), F.col("at2")).otherwise(F.col("at")).alias("at"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), F.coalesce("top", "top2").alias("top"))
        span *= 2
    if not done:
        return cur.select("n", "id", F.col("top").alias("root_id"), F.col("steps").alias("depth"))
    above = done[0]
    for x in done[1:]:
        above = above.unionByName(x)
    cur = cur.join(above.select(F.col("n").alias("at"), "root_id", F.col("depth").alias("d")), "at", "left")
    depth = F.when(F.col("d").isNull(), F.col("steps")).when(F.col("d") < 0, F.lit(-1)).otherwise(F.col("d") + F.col("steps"))
    return cur.select("n", "id", F.coalesce("top", "root_id").alias("root_id"), depth.cast("long").alias("depth"))


def _peel(state: DataFrame, round_no: int) -> DataFrame:
    """One round: nodes with no child to come are peeled and send their size to their parent."""
    leaf = F.col("peeled").isNull() & (F.col("pending") == 0)
    me = F.struct("n", "pn", "pending", "size", F.when(leaf, F.lit(round_no)).otherwise(F.col("peeled")).alias("peeled"))
    up = F.struct(F.col("pn").alias("n"), F.lit(None).cast("long").alias("pn"), F.lit(-1).cast("long").alias("pending"), F.col("size"), F.lit(None).cast("int").alias("peeled"))
    rows = state.select(F.inline(F.when(leaf & F.col("pn").isNotNull(), F.array(me, up)).otherwise(F.array(me))))
    return rows.groupBy("n").agg(F.max("pn").alias("pn"), F.sum("pending").alias("pending"), F.sum("size").alias("size"), F.max("peeled").alias("peeled"))


def _circles(shelf: Shelf, rest: DataFrame) -> DataFrame:
    """Nodes that were never peeled: the smallest id on each circle, by doubling steps along it."""
    c = shelf.put(rest.select("n", "id", "pn", "parent_id", "size", F.col("pn").alias("to"), F.col("id").alias("low")))
    while True:
        o = c.select(F.col("n").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"))
        step = shelf.put(c.join(o, "to").select("n", "id", "pn", "parent_id", "size", F.col("to2").alias("to"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("moved")))
        moved = step.filter("moved").limit(1).count()
        shelf.drop(c)
        c = step.drop("moved")
        c._shelf_path = step._shelf_path
        if not moved:
            break
    return c.select("n", "id", "parent_id", F.col("low").alias("root_id"), F.lit(-1).cast("long").alias("depth"), F.array("id").alias("chain"), "size", F.lit(True).alias("on_circle"))


def _assign(shelf: Shelf, part: DataFrame, layers: int, done: list[DataFrame]) -> DataFrame:
    """Path, depth and root for the nodes of some neighbouring layers, from those above that are done."""
    # at: the nearest ancestor outside what is already in `seg`; null once a root leads it
    cur = part.select("n", "id", "parent_id", "size", F.col("pn").alias("at"), F.array("id").alias("seg"))
    span = 1
    while span < layers:
        o = cur.select(F.col("n").alias("at"), F.col("at").alias("at2"), F.col("seg").alias("seg2"))
        cur = cur.join(o.withColumn("hit", F.lit(True)), "at", "left").select(
            "n", "id", "parent_id", "size",
            F.when(F.col("hit"), F.col("at2")).otherwise(F.col("at")).alias("at"),
            F.when(F.col("hit"), F.concat("seg2", "seg")).otherwise(F.col("seg")).alias("seg"),
        )
        span *= 2
        if span >= 4:  # cut here: each doubling reads its input twice
            cur = shelf.put(cur)
    if done:
        above = done[0]
        for x in done[1:]:
            above = above.unionByName(x)
        above = above.select(F.col("n").alias("at"), "root_id", "depth", "chain")
        cur = cur.join(above, "at", "left")
    else:
        cur = cur.select("*", F.lit(None).cast("string").alias("root_id"), F.lit(None).cast("long").alias("depth"), F.lit(None).cast("array<string>").alias("chain"))
    rooted = F.col("at").isNull()
    return cur.select(
        "n", "id", "parent_id",
        F.when(rooted, F.element_at("seg", 1)).otherwise(F.col("root_id")).alias("root_id"),
        F.when(rooted, F.size("seg").cast("long") - 1).when(F.col("depth") < 0, F.lit(-1)).otherwise(F.col("depth") + F.size("seg")).cast("long").alias("depth"),
        F.when(rooted, F.col("seg")).otherwise(F.concat("chain", "seg")).alias("chain"),
        "size", F.lit(False).alias("on_circle"),
    )


def descendants(tree: DataFrame, circles: bool = False) -> DataFrame:
    """(ancestor_id, unit_id, distance) of a `hierarchy` result: every node below every node.

    Each node's path names its ancestors, so no join is needed. circles: also what hangs on a circle, below the node of the
    circle it hangs on and all nodes between, as `subtree_size` counts; else nodes whose chain of parents never ends give no
    rows. Nodes of one circle are never below each other.
    """
    return (
        tree.select("unit_id", F.col("chain" if circles else "path").alias("p"))
        .filter("p IS NOT NULL")
        .select("unit_id", F.size("p").alias("k"), F.posexplode("p").alias("pos", "ancestor_id"))
        .filter("pos < k - 1")
        .select("ancestor_id", "unit_id", (F.col("k") - 1 - F.col("pos")).cast("long").alias("distance"))
    )
