"""Parent-child links to full hierarchies: cycles, roots, depths, paths and descendants.

Leaves are peeled for as long as a round removes a fair part of the nodes, which never removes a cycle; pointer doubling
over what is left (long bare chains, and what hangs on cycles by them) exposes the cycles in a number of rounds that grows
with the logarithm of the depth. The remaining forest is written as Euler tours, one list for each root, ranked in parallel
by pointer jumping; the ranks of a node's entry and exit give depth and descendants. No step needs a tree, or the children
of one node, in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.chunked import prefix_sums
from plumbline.session import cut, cut_with, parallelism

#: Peeling goes on while a round takes off one in so many of the remaining nodes; each node is so read a bounded number of times.
PEEL_PART = 3
SEPARATOR = " > "


def _n() -> Column:
    return F.count(F.lit(1))


def _cycle_nodes(edges: DataFrame, size: int) -> DataFrame:
    """Nodes ``v`` on cycles of ``edges(child, parent)`` with one parent for each child, and ``cycle``: the least node of it."""
    core, left = edges, size
    while left:
        core, seen = cut_with(core.join(core.select(F.col("parent").alias("child")).distinct(), "child", "left_semi"), n=_n())
        gone, left = left - seen["n"], seen["n"]
        if gone * PEEL_PART < left + gone:
            break
    if not left:
        return edges.select(F.col("child").alias("v"), F.col("parent").alias("cycle")).limit(0)
    jump = core.select(F.col("child").alias("v"), F.col("parent").alias("j"))
    last = (-1, -1)
    while True:
        size = (left, jump.select("j").distinct().count())
        if size == last or not left:
            break
        last = size
        jump, seen = cut_with(jump.alias("a").join(jump.alias("b"), F.col("a.j") == F.col("b.v")).select("a.v", "b.j"), n=_n())
        left = seen["n"]
    on = jump.select(F.col("j").alias("v")).distinct()
    ring = core.join(on, core["child"] == on["v"], "left_semi")
    ring = cut(ring.select(F.col("child").alias("v"), F.col("parent").alias("j"), F.least("child", "parent").alias("m")))
    moved = left
    while moved:
        nxt, seen = cut_with(
            ring.alias("a")
            .join(ring.alias("b"), F.col("a.j") == F.col("b.v"))
            .select("a.v", "b.j", F.least("a.m", "b.m").alias("m"), (F.col("b.m") < F.col("a.m")).alias("moved")),
            n=F.count_if(F.col("moved")),
        )
        ring, moved = nxt.drop("moved"), seen["n"]
    return ring.select("v", F.col("m").alias("cycle"))


def _tour(forest: DataFrame) -> DataFrame:
    """``(child, depth, n_desc, root, to_end_in, to_end_out)`` of each child in ``forest(child, parent)``, by ranked Euler tours.

    The last two are how many places of the root's tour are left at the node's entry and at its exit.
    """
    spark = forest.sparkSession
    keyed = forest.withColumn("order", F.concat_ws("\u0000", "parent", "child")).withColumn("one", F.lit(1).cast("long"))
    numbered = cut(prefix_sums(keyed, "order", "one", "i", parallelism(spark)).select("i", "child", "parent"))
    kids = numbered.groupBy("parent").agg(F.min("i").alias("first"), F.max("i").alias("last"))
    up = numbered.select(F.col("child").alias("parent"), F.col("i").alias("pi"))
    n = (
        numbered.join(kids.select("parent", "last"), "parent")
        .join(up, "parent", "left")
        .join(kids.select(F.col("parent").alias("child"), "first"), "child", "left")
    )
    d, u = F.lit(2) * F.col("i"), F.lit(2) * F.col("i") + 1
    end = (F.col("i") == F.col("last")) & F.col("pi").isNull()
    after = F.when(F.col("i") < F.col("last"), F.lit(2) * (F.col("i") + 1)).when(F.col("pi").isNotNull(), F.lit(2) * F.col("pi") + 1)
    steps = F.array(
        F.struct(d.alias("e"), F.coalesce(F.lit(2) * F.col("first"), u).alias("nxt"), F.lit(1).cast("long").alias("w"), F.lit(None).cast("string").alias("root")),
        F.struct(u.alias("e"), after.alias("nxt"), F.lit(-1).cast("long").alias("w"), F.when(end, F.col("parent")).alias("root")),
    )
    unfinished = F.count("nxt")
    tour, seen = cut_with(n.select(F.inline(steps)).withColumn("n", F.lit(1).cast("long")), n=unfinished)
    while seen["n"]:
        b = tour.select(F.col("e").alias("nxt"), F.col("nxt").alias("nxt2"), F.col("w").alias("w2"), F.col("n").alias("n2"), F.col("root").alias("root2"))
        tour, seen = cut_with(
            tour.join(b, "nxt", "left").select(
                "e",
                F.col("nxt2").alias("nxt"),
                (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w"),
                F.coalesce("root", "root2").alias("root"),
                (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"),
            ),
            n=unfinished,
        )
    entry, leave = F.col("e") % 2 == 0, F.col("e") % 2 == 1
    spans = tour.groupBy(F.floor(F.col("e") / 2).alias("i")).agg(
        F.max(F.when(entry, F.col("w"))).alias("w"), F.max(F.when(entry, F.col("n"))).alias("n_in"), F.max(F.when(leave, F.col("n"))).alias("n_out"), F.max("root").alias("root")
    )
    return numbered.join(spans, "i").select("child", (1 - F.col("w")).alias("depth"), F.floor((F.col("n_in") - F.col("n_out") - 1) / 2).alias("n_desc"), "root", F.col("n_in").alias("to_end_in"), F.col("n_out").alias("to_end_out"))


def _paths(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``(child, path)``: the names from the root down, doubled up in rounds."""
    p, seen = cut_with(
        edges.join(roots.select(F.col("v").alias("parent"), F.lit(True).alias("top")), "parent", "left").select(
            F.col("child").alias("v"),
            F.when(F.col("top").isNull(), F.col("parent")).alias("j"),
            F.when(F.col("top").isNull(), F.col("child")).otherwise(F.concat_ws(SEPARATOR, "parent", "child")).alias("path"),
        ),
        n=F.count("j"),
    )
    while seen["n"]:
        b = p.select(F.col("v").alias("j"), F.col("j").alias("j2"), F.col("path").alias("head"))
        p, seen = cut_with(p.join(b, "j", "left").select("v", F.col("j2").alias("j"), F.concat_ws(SEPARATOR, "head", "path").alias("path")), n=F.count("j"))
    return p.select(F.col("v").alias("child"), "path")


def hierarchy(links: DataFrame, child: str, parent: str) -> DataFrame:
    """``(node, node_kind, root_name, depth, path, n_descendants, tour, entry, exit, cycle)`` of each node on any link.

    ``node_kind`` is ``cycle`` on a cycle (a self-link included), ``below_cycle`` if the way up ends in a cycle, else
    ``tree``; root and path are empty and depth is -1 outside trees. ``n_descendants`` counts the other nodes from which the
    way up reaches the node. ``entry`` and ``exit`` are the node's places in the Euler tour of ``tour``, the root or the node on
    a cycle that it hangs on: exactly the nodes below it have both of theirs between. ``cycle`` is the least node of a node's
    cycle, else null. Repeated links count once. A link with a null end leads nowhere, its other end is still a node. A child
    with several parents goes up to the least of them; ``parents`` lists them all. No links give no rows.
    """
    c, p = F.col(f"`{child}`"), F.col(f"`{parent}`")
    ends = cut(links.select(c.alias("child"), p.alias("parent")).distinct())
    nodes = ends.select(F.explode(F.array("child", "parent")).alias("v")).where(F.col("v").isNotNull()).distinct()
    edges = ends.where(F.col("child").isNotNull() & F.col("parent").isNotNull()).groupBy("child").agg(F.min("parent").alias("parent"))
    up, seen = cut_with(edges, n=_n())
    cycles = cut(_cycle_nodes(up, seen["n"]))
    forest = up.join(cycles.select(F.col("v").alias("child")), "child", "left_anti")
    tour = cut(_tour(forest))
    below = tour.groupBy("root").agg(_n().alias("under"))
    ring = cycles.join(below.withColumnRenamed("root", "v"), "v", "left").select("v", "cycle", F.coalesce("under", F.lit(0)).alias("under"))
    rings = ring.groupBy("cycle").agg((F.sum("under") + _n() - 1).alias("n_desc"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("string")
    whole = [F.col("v").alias("tour"), zero.alias("entry"), (2 * F.col("under") + 1).cast("long").alias("exit")]
    on_cycle = ring.join(rings, "cycle").select("v", F.lit("cycle").alias("kind"), F.lit("").alias("root"), F.lit(-1).cast("long").alias("depth"), F.col("n_desc").cast("long"), *whole, "cycle")
    tagged = tour.join(below, "root").join(cycles.select(F.col("v").alias("root"), F.lit(True).alias("cyc")), "root", "left")
    hanging = F.col("cyc").isNotNull()
    inner = tagged.select(
        F.col("child").alias("v"),
        F.when(hanging, "below_cycle").otherwise("tree").alias("kind"),
        F.when(hanging, "").otherwise(F.col("root")).alias("root"),
        F.when(hanging, -1).otherwise(F.col("depth")).cast("long").alias("depth"),
        F.col("n_desc").cast("long").alias("n_desc"),
        F.col("root").alias("tour"),
        (2 * F.col("under") - F.col("to_end_in") + 1).cast("long").alias("entry"),
        (2 * F.col("under") - F.col("to_end_out") + 1).cast("long").alias("exit"),
        none.alias("cycle"),
    )
    tops = nodes.join(tour.select(F.col("child").alias("v")), "v", "left_anti").join(cycles.select("v"), "v", "left_anti")
    roots = tops.join(below.withColumnRenamed("root", "v"), "v", "left").select("v", F.coalesce("under", F.lit(0)).alias("under"))
    roots = cut(roots.select("v", F.lit("tree").alias("kind"), F.col("v").alias("root"), zero.alias("depth"), F.col("under").cast("long").alias("n_desc"), *whole, none.alias("cycle")))
    inner = cut(inner)
    tree_edges = up.join(inner.where(F.col("kind") == "tree").select(F.col("v").alias("child")), "child", "left_semi")
    paths = _paths(tree_edges, roots).unionByName(roots.select(F.col("v").alias("child"), F.col("v").alias("path")))
    every = inner.unionByName(roots).unionByName(on_cycle)
    return every.join(paths.withColumnRenamed("child", "v"), "v", "left").select(
        F.col("v").alias("node"), F.col("kind").alias("node_kind"), F.col("root").alias("root_name"), "depth", F.coalesce("path", F.lit("")).alias("path"), F.col("n_desc").alias("n_descendants"),
        "tour", "entry", "exit", "cycle",
    )


def parents(links: DataFrame, child: str, parent: str) -> DataFrame:
    """``(node, parent, is_way_up)``: every parent of each node, those included that the hierarchy doesn't go up to."""
    ends = links.select(F.col(f"`{child}`").alias("node"), F.col(f"`{parent}`").alias("parent")).where(F.col("node").isNotNull() & F.col("parent").isNotNull()).distinct()
    return ends.join(ends.groupBy("node").agg(F.min("parent").alias("least")), "node").select("node", "parent", (F.col("parent") == F.col("least")).alias("is_way_up"))


def _half(c: Column, level: Column) -> Column:
    return F.call_function("shiftright", c, level)


def descendants(tree: DataFrame) -> DataFrame:
    """``(node, descendant)`` of all nodes of a ``hierarchy``: every node below another one, on a cycle every other node of it too.

    An interval join of the tours: the places inside a node's interval are cut into blocks of two to the k places, at most
    two of a size, and each place is in one block of a size; pairs meet in exactly one block, so the work is that of the
    result. Empty for an empty hierarchy.
    """
    spans = cut(tree.select("node", "tour", "entry", "exit", "cycle"))
    top = spans.agg(F.max("exit")).first()[0] or 0
    levels = F.sequence(F.lit(0), F.lit(max(1, top.bit_length())))
    lo, hi = F.col("entry") + 1, F.col("exit")  # places from lo, before hi

    def blocks(k: Column) -> Column:
        up = lambda x, j: _half(x + F.call_function("shiftleft", F.lit(1).cast("long"), j) - 1, j)
        first, last = up(lo, k), _half(hi, k) - 1
        a, b = up(lo, k + 1), _half(hi, k + 1)  # blocks of twice the size that the next level takes
        free = lambda i: (i >= first) & (i <= last) & ~((_half(i, F.lit(1)) >= a) & (_half(i, F.lit(1)) < b))
        return F.transform(F.filter(F.array_distinct(F.array(first, last)), free), lambda i: F.struct(k.alias("k"), i.alias("i")))

    inside = spans.where(F.col("exit") > F.col("entry") + 1).select("node", "tour", F.explode(F.flatten(F.transform(levels, blocks))).alias("b")).select("node", "tour", "b.k", "b.i")
    places = spans.where(F.col("entry") > 0).select(F.col("node").alias("descendant"), "tour", F.explode(F.transform(levels, lambda k: F.struct(k.alias("k"), _half(F.col("entry"), k).alias("i")))).alias("b")).select("descendant", "tour", "b.k", "b.i")
    within = inside.join(places, ["tour", "k", "i"]).select("node", "descendant")
    # What a cycle reaches beyond a node's own tour: its other nodes and what hangs on them.
    on = spans.where(F.col("cycle").isNotNull()).select("node", "cycle")
    under = spans.join(on.select(F.col("node").alias("tour"), F.col("cycle").alias("ring")), "tour").select(F.col("node").alias("descendant"), "tour", F.col("ring").alias("cycle"))
    across = on.join(under, "cycle").where(F.col("node") != F.col("tour")).select("node", "descendant")
    return within.unionByName(across)
