"""Dependency graphs as edge tables (src, dst)."""

from __future__ import annotations

import math
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.tables import cut


def degrees(edges: DataFrame) -> DataFrame:
    """node, in_deg, out_deg of all nodes of distinct edges."""
    e = edges.select("src", "dst").distinct()
    both = e.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionAll(e.select("dst", F.lit(1), F.lit(0)))
    return both.groupBy("node").agg(F.sum("i").cast("long").alias("in_deg"), F.sum("o").cast("long").alias("out_deg"))


def roles(nodes: DataFrame, edges: DataFrame, entries: int = 20, hub_share: float = 0.1) -> DataFrame:
    """node, in_deg, out_deg, is_orphan, is_leaf, is_entry, is_hub. Entries: no importers, most imports first, `entries` of
    them. Hubs: at least 2 importers, the first max(2, share of nodes that aren't orphans)."""
    d = nodes.select("node").distinct().join(degrees(edges), "node", "left").na.fill(0, ["in_deg", "out_deg"])
    connected = d.where("in_deg + out_deg > 0").count()
    k = max(2, math.ceil(round(connected * hub_share, 9)))
    top = lambda rows, by, n, flag: rows.orderBy(F.desc(by), "node").limit(n).select("node", F.lit(True).alias(flag))
    entry = top(d.where("in_deg = 0 and out_deg > 0"), "out_deg", entries, "is_entry")
    hub = top(d.where("in_deg >= 2"), "in_deg", k, "is_hub")
    out = d.join(F.broadcast(entry), "node", "left").join(hub, "node", "left").na.fill(False, ["is_entry", "is_hub"])
    return out.withColumn("is_orphan", (F.col("in_deg") == 0) & (F.col("out_deg") == 0)).withColumn("is_leaf", (F.col("out_deg") == 0) & (F.col("in_deg") > 0))


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node, component (the smallest node) of all nodes with an edge to another."""
    moved = _components_of_others(spark, edges)
    return moved.unionByName(moved.select(F.col("component").alias("node"), "component").distinct())


def _components_of_others(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node, component without the smallest nodes themselves: each round points every node at its smallest neighbour, if that is smaller, follows the
    pointers to their ends, and links those; tables between rounds are written."""
    links = cut(spark, edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    labels = None
    while not links.isEmpty():
        to = cut(spark, links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to")))
        while True:
            ahead = to.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
            moved = cut(spark, to.join(ahead, "to", "left").select("node", F.coalesce("beyond", "to").alias("end"), "to"))
            to = moved.select("node", F.col("end").alias("to"))
            if moved.where("end <> to").isEmpty():
                break
        ended = to.select("node", F.col("to").alias("component"))
        if labels is None:
            labels = ended
        else:
            labels = cut(spark, labels.join(to.select(F.col("node").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component")).unionByName(ended))
        move = lambda c: to.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))
        links = cut(
            spark,
            links.join(move("a"), "a", "left").join(move("b"), "b", "left").select(F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        )
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("component"))


#: Entries whose visits one word of bits tells.
WORD_BITS = 64


def depths(spark: SparkSession, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """node, depth: shortest hops from each entry (node), the largest of those over all entries; entries at 0 left out.

    Where all ways from entries to a node are as long, their length is the answer, and one search from all entries at once finds it: a node is left to the search by
    entries only if an edge comes in from a node that is as far or farther, or from a node that is left. That search goes over the edges that lead to such nodes.

    Entries are bits of words, 64 of them searched as one: a row for a node and word holds the entries that have reached the node,
    and the round in which the last of them did. A round sends the bits that are new at a node to its followers, ORs what meets there, and
    keeps what hadn't been. Rows are at most nodes left and before them times entries / 64; a round costs a join of the new rows with the edges. Null nodes have no edges.
    """
    e = cut(spark, edges.select("src", "dst").where("src is not null and dst is not null"))
    starts = cut(spark, entries.select("node").where("node is not null").distinct())
    near, mixed = _least_depths(spark, e, starts)
    if mixed.isEmpty():
        return near.where("depth > 0").select("node", "depth")
    turned = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    left = _least_depths(spark, e, mixed)[0].select("node")
    before = _least_depths(spark, turned, left)[0].select("node")
    e = e.join(before.withColumnRenamed("node", "src"), "src", "left_semi").join(before.withColumnRenamed("node", "dst"), "dst", "left_semi")
    found = _depths_by_entry(spark, e, starts.join(before, "node", "left_semi")).join(left, "node", "left_semi")
    return cut(spark, near.join(left, "node", "left_anti").where("depth > 0").select("node", "depth").unionByName(found))


def _least_depths(spark: SparkSession, edges: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, depth) of all nodes that `starts` (node) reach, with the hops from the nearest of them, and (node) of those into which an edge leads from a node that
    isn't nearer. An edge is looked at once, in the round that reaches its source."""
    front = starts.withColumn("depth", F.lit(0).cast("long"))
    seen, mixed, rest = front, starts.limit(0), edges
    for step in count(1):
        went = rest.join(front.select(F.col("node").alias("src"), F.lit(True).alias("there")), "src", "left")
        went = cut(spark, went)
        came = went.where("there").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left")
        came = cut(spark, came)
        front = came.where("depth is null").select("node", F.lit(step).cast("long").alias("depth"))
        mixed = mixed.unionByName(came.where("depth is not null").select("node"))
        if front.isEmpty():
            return cut(spark, seen), cut(spark, mixed.distinct())
        seen, rest = seen.unionByName(front), went.where("there is null").select("src", "dst")


def _depths_by_entry(spark: SparkSession, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """node, depth: the largest of the hops from each entry, by words of bits."""
    e = cut(spark, edges.select("src", "dst").distinct())
    numbered = cut(spark, entries.select("node").distinct()).withColumn("number", F.monotonically_increasing_id())
    bit = F.expr(f"shiftleft(1L, cast(number % {WORD_BITS} as int))")
    seen = cut(spark, numbered.groupBy("node", F.floor(F.col("number") / WORD_BITS).alias("word")).agg(F.bit_or(bit).alias("bits")).withColumn("depth", F.lit(0).cast("long")))
    front = seen.select("node", "word", "bits")
    for step in count(1):  # ends, as bits that were seen don't come again
        came = front.join(e, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node"), "word").agg(F.bit_or("bits").alias("came"))
        both = seen.join(came, ["node", "word"], "full")
        new = F.coalesce("came", F.lit(0).cast("long")).bitwiseAND(F.bitwise_not(F.coalesce("bits", F.lit(0).cast("long"))))
        merged = both.select("node", "word", F.coalesce("bits", F.lit(0).cast("long")).bitwiseOR(F.coalesce("came", F.lit(0).cast("long"))).alias("bits"), F.when(new != 0, F.lit(step).cast("long")).otherwise(F.col("depth")).alias("depth"), new.alias("new"))
        merged = cut(spark, merged)
        seen, front = merged.drop("new"), merged.where("new <> 0").select("node", "word", F.col("new").alias("bits"))
        if front.isEmpty():
            break
    return seen.where("depth > 0").groupBy("node").agg(F.max("depth").alias("depth"))


def neighbourhood(edges: DataFrame, start: DataFrame, hops: int = 1) -> DataFrame:
    """src, dst: edges between nodes at most `hops` (1 or 2) away from `start` (node), in either direction."""
    e = edges.select("src", "dst").distinct()
    both = e.unionAll(e.select("dst", "src")).toDF("a", "b")
    nodes = start.select("node").distinct()
    for _ in range(hops):
        nodes = nodes.unionAll(nodes.join(both, F.col("node") == F.col("a")).select(F.col("b").alias("node"))).distinct()
    return e.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


def two_cycles(edges: DataFrame) -> DataFrame:
    """a, b: pairs of nodes with edges both ways."""
    e = edges.where("src <> dst").select("src", "dst").distinct()
    return e.alias("x").join(e.alias("y"), (F.col("x.src") == F.col("y.dst")) & (F.col("x.dst") == F.col("y.src")) & (F.col("x.src") < F.col("x.dst"))).select(F.col("x.src").alias("a"), F.col("x.dst").alias("b"))


def unreferenced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that nothing points at."""
    return nodes.join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def rollup_edges(edges: DataFrame, src_group, dst_group) -> DataFrame:
    """Edges between groups, with counts, without those inside a group."""
    return edges.select(src_group.alias("src"), dst_group.alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def _ends(spark: SparkSession, ways: DataFrame) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Where one-way pointers (node, to) lead, by doubling: the pointers of 1, 2, 4, ... steps, (node, end) of those that leave the pointers, and
    (node, least) of the nodes on closed ways, with the least node of each."""
    far = cut(spark, ways.select("node", "to", F.least("node", "to").alias("least")))
    levels, n, steps = [far], far.count(), 1
    while True:
        ahead = far.select(F.col("node").alias("to"), F.col("to").alias("beyond"), F.col("least").alias("more"))
        moved = cut(spark, far.join(ahead, "to", "left").select("node", F.coalesce("beyond", "to").alias("to"), F.least("least", "more").alias("least"), F.col("beyond").isNotNull().alias("moved")))
        steps *= 2
        far = moved.select("node", "to", "least")
        if steps > n or moved.where("moved").isEmpty():
            break
        levels.append(far)
    # After more steps than nodes, what still points at a pointer goes round.
    inner = far.join(ways.select(F.col("node").alias("to")), "to", "left_semi")
    rounds = cut(spark, far.join(inner.select(F.col("to").alias("node")).distinct(), "node", "left_semi").select("node", "least"))
    return levels, cut(spark, far.select("node", F.col("to").alias("end"))), rounds


def _fold(spark: SparkSession, edges: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]] | None:
    """Contract nodes with one follower into where their only ways end: (smaller edges, (node, root), pointers by doubling), or None if there
    are no such nodes. A closed way of such nodes is contracted into its least node."""
    single = edges.groupBy("src").agg(F.min("dst").alias("to"), F.count("*").alias("n")).where("n = 1").select(F.col("src").alias("node"), "to")
    ways = cut(spark, single)
    if ways.isEmpty():
        return None
    levels, ends, rounds = _ends(spark, ways)
    if not rounds.isEmpty():
        # The least node of a closed way becomes a root, and the others lead to it.
        ways = cut(spark, ways.join(rounds.where("node = least").select("node"), "node", "left_anti"))
        if not ways.isEmpty():
            levels, ends, _ = _ends(spark, ways)
        else:
            ends = ways.select("node", F.col("to").alias("end"))
    roots = cut(spark, ends.select("node", F.col("end").alias("root")))
    at = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    # Edges of contracted nodes are their ways, which say nothing more; the others end at the roots.
    smaller = edges.join(roots.select(F.col("node").alias("src")), "src", "left_anti").join(at("dst"), "dst", "left").select("src", F.coalesce("dst_root", "dst").alias("dst")).where("src <> dst").distinct()
    return cut(spark, smaller), roots, levels


def _unfold(spark: SparkSession, edges: DataFrame, roots: DataFrame, levels: list[DataFrame], found: DataFrame) -> DataFrame:
    """(node, component) of the larger graph, from that of the smaller one: a contracted node belongs to its root's component if an edge from that
    component comes in at it, or at a node whose way leads through it."""
    of = found.select("node", "component")
    whose = lambda c, name: of.select(F.col("node").alias(c), F.col("component").alias(name))
    into = edges.join(roots.select(F.col("node").alias("dst"), "root"), "dst").join(whose("src", "a"), "src", "left").join(whose("root", "b"), "root", "left")
    marked = cut(spark, into.where(F.coalesce("a", "src") == F.coalesce("b", "root")).select(F.col("dst").alias("node")).distinct())
    for far in levels:
        ahead = far.join(marked, "node", "left_semi").select(F.col("to").alias("node"))
        marked = cut(spark, marked.union(ahead).distinct())
    inner = roots.join(marked, "node", "left_semi").join(whose("root", "b"), "root", "left").select("node", F.coalesce("b", "root").alias("component"), "root")
    # A root that was alone is now in company.
    alone = inner.select(F.col("root").alias("node"), "component").distinct().join(of.select("node"), "node", "left_anti")
    return cut(spark, of.unionByName(inner.select("node", "component")).unionByName(alone))


def _furthest(spark: SparkSession, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, top): the largest node that reaches each. A node takes the largest of its predecessors' and, as what reaches its top
    reaches it, of its top's; so along a way tops move by doubling."""
    top = cut(spark, nodes.withColumn("top", F.col("node")))
    while True:
        came = edges.join(top.select(F.col("node").alias("src"), F.col("top").alias("c")), "src").groupBy(F.col("dst").alias("node")).agg(F.max("c").alias("c"))
        once = top.join(came, "node", "left").select("node", F.greatest("top", "c").alias("next"), "top")
        again = top.select(F.col("node").alias("next"), F.col("top").alias("beyond"))
        moved = cut(spark, once.join(again, "next", "left").select("node", F.greatest("next", "beyond").alias("next"), "top"))
        top = moved.select("node", F.col("next").alias("top"))
        if moved.where("next <> top").isEmpty():
            return top


def strong_components(spark: SparkSession, edges: DataFrame, rounds: list[str] | None = None) -> DataFrame:
    """node, component of nodes on directed cycles (the largest node of the cycle's strong component).

    Nodes with one follower are contracted into where their ways end, and those with one predecessor likewise on the reversed edges, by pointer doubling;
    nodes without a way in or out go. When too little is contracted, each node takes the largest node that reaches it as its
    colour; of a colour, what reaches its node is a strong component. Then contracted nodes are taken back in, last ones first. A chain or ring of n
    nodes takes the logarithm of n; `rounds`, if given, collects what was done.
    """
    rounds = rounds if rounds is not None else []
    left = cut(spark, edges.where("src <> dst").select("src", "dst").distinct())
    folds: list[tuple[DataFrame, DataFrame, list[DataFrame]]] = []
    found = cut(spark, left.limit(0).select(F.col("src").alias("node"), F.col("dst").alias("component")))
    turn = lambda d: d.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    while not left.isEmpty():
        before = left.count()
        for way, back in ((lambda d: d, lambda d: d), (turn, turn)):
            folded = _fold(spark, way(left)) if not left.isEmpty() else None
            if folded is not None:
                folds.append((way(left), folded[1], folded[2]))
                rounds += ["fold"] * len(folded[2])
                left = back(folded[0])
        left = cut(spark, left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        rounds.append("trim")
        if left.isEmpty() or 2 * left.count() <= before:
            continue
        nodes = cut(spark, left.select(F.col("src").alias("node")).union(left.select("dst")).distinct())
        colour = _furthest(spark, left, nodes)
        of = lambda c, name: colour.select(F.col("node").alias(c), F.col("top").alias(name))  # noqa: E731, B023
        inside = cut(spark, left.join(of("src", "a"), "src").join(of("dst", "b"), "dst").where("a = b").select("src", "dst"))
        reached = _furthest(spark, turn(inside), nodes)
        own = cut(spark, colour.join(reached.select("node", F.col("top").alias("reaches")), "node").where("top = reaches").select("node", F.col("top").alias("component")))
        rounds.append("colour")
        found = found.unionByName(own)
        gone = own.select("node")
        left = cut(spark, left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    for larger, roots, levels in reversed(folds):
        found = _unfold(spark, larger, roots, levels, found)
        rounds.append("unfold")
    top = found.groupBy("component").agg(F.max("node").alias("top"), F.count("*").alias("n")).where("n > 1")
    return found.join(top, "component").select("node", F.col("top").alias("component"))


def cycle_edges(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """src, dst: edges that lie on a directed cycle, and self-loops: all of them, whatever order files come in."""
    edges = cut(spark, edges)
    strong = strong_components(spark, edges)
    a, b = strong.select(F.col("node").alias("src"), F.col("component").alias("a")), strong.select(F.col("node").alias("dst"), F.col("component").alias("b"))
    e = edges.select("src", "dst").distinct()
    return e.join(a, "src").join(b, "dst").where("a = b").select("src", "dst").unionByName(e.where("src = dst"))


def spanning_forest(spark: SparkSession, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, dst) of the edges of a spanning forest of the undirected graph, each once, and (node, component) with the least node of each.

    Each round every part points at its least neighbouring part by one original edge, which joins the forest: pointers go downwards, so they close no ring."""
    one = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    links = cut(spark, one.select("a", "b", F.struct("a", "b").alias("by")))
    nodes = cut(spark, links.select(F.col("a").alias("node")).union(links.select("b")).distinct())
    forest, labels = links.select("by.a", "by.b").limit(0), nodes.withColumn("component", F.col("node"))
    while not links.isEmpty():
        # The larger part of a link may point at the smaller one; the least neighbour is the part's choice.
        to = cut(spark, links.groupBy(F.col("b").alias("node")).agg(F.min(F.struct("a", "by")).alias("m")).select("node", F.col("m.a").alias("to"), "m.by"))
        forest = forest.unionByName(to.select("by.a", "by.b"))
        ends = _ends(spark, to.select("node", "to"))[1]
        end = lambda c: ends.select(F.col("node").alias(c), F.col("end").alias(f"{c}_end"))  # noqa: E731, B023
        moved = links.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("a_end", "a").alias("x"), F.coalesce("b_end", "b").alias("y"), "by").where("x <> y")
        links = cut(spark, moved.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("by").alias("by")))
        labels = cut(spark, labels.join(end("component"), "component", "left").select("node", F.coalesce("component_end", "component").alias("component")))
    return cut(spark, forest.toDF("src", "dst")), labels


#: Parts into which the neighbours of a node are dealt when the next one of each is looked for.
FANS = 64


def euler_tours(spark: SparkSession, forest: DataFrame, labels: DataFrame) -> DataFrame:
    """node, parent, pre, post, component: trees rooted at their least nodes; `pre` and `post` are the places in the tree's tour where a node is entered and
    left, so a node's branch are the nodes entered from its `pre` on and before its `post`.

    Each edge is walked both ways. After the way from u to v comes the way from v to the neighbour after u; places are found by
    pointer doubling over the ways. Neighbours of a node are ordered within parts, and the parts after one another."""
    from pyspark.sql import Window

    ways = cut(spark, forest.unionByName(forest.select(F.col("dst").alias("src"), F.col("src").alias("dst")))).withColumn("fan", F.pmod(F.hash("dst"), F.lit(FANS)))
    inside = Window.partitionBy("src", "fan").orderBy("dst")
    fans = ways.groupBy("src", "fan").agg(F.min("dst").alias("first"))
    around = Window.partitionBy("src").orderBy("fan")
    start = F.first("first").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    fans = fans.select("src", "fan", F.lead("first").over(around).alias("on"), start.alias("start"))
    after = ways.withColumn("next", F.lead("dst").over(inside)).join(fans, ["src", "fan"])
    after = after.select(F.col("src").alias("at"), F.col("dst").alias("came"), F.coalesce("next", "on", "start").alias("leave"), (F.coalesce("next", "on").isNull()).alias("wraps"))
    numbered = cut(spark, ways.select("src", "dst").withColumn("way", F.monotonically_increasing_id()))
    pairs = numbered.join(after, (F.col("src") == F.col("came")) & (F.col("dst") == F.col("at"))).join(labels.select(F.col("node").alias("at"), "component"), "at")
    # The tour ends where it would leave the root for its first neighbour again.
    pairs = pairs.select("way", "src", "dst", "component", F.when(~(F.col("wraps") & (F.col("at") == F.col("component"))), F.col("leave")).alias("leave"))
    onward = numbered.select(F.col("src").alias("dst"), F.col("dst").alias("leave"), F.col("way").alias("to"))
    table = cut(spark, pairs.join(onward, ["dst", "leave"], "left").select("way", "src", "dst", "component", "to"))
    far = cut(spark, table.select("way", "to", F.when(F.col("to").isNotNull(), 1).otherwise(0).cast("long").alias("left")))
    while not far.where("to is not null").isEmpty():
        ahead = far.select(F.col("way").alias("to"), F.col("to").alias("beyond"), F.col("left").alias("more"))
        far = cut(spark, far.join(ahead, "to", "left").select("way", F.col("beyond").alias("to"), (F.col("left") + F.coalesce("more", F.lit(0).cast("long"))).alias("left")))
    placed = table.join(far.select("way", (-F.col("left")).alias("place")), "way").select("src", "dst", "component", "place")
    back = placed.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("place").alias("back"))
    inner = placed.join(back, ["src", "dst"]).where("place < back").select(F.col("dst").alias("node"), F.col("src").alias("parent"), F.col("place").alias("pre"), F.col("back").alias("post"), "component")
    low = F.lit(-(1 << 62)).cast("long")
    roots = labels.where("node = component").select("node", F.lit(None).cast(dict(labels.dtypes)["node"]).alias("parent"), low.alias("pre"), F.lit(1).cast("long").alias("post"), "component")
    return cut(spark, inner.unionByName(roots))


def blocks(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node, block: the biconnected parts of the undirected graph of `edges` (src, dst), and their nodes. A part is named by one of its nodes.

    Any spanning forest will do. A tree edge is known by its lower node; two tree edges are in one part if an edge outside the forest joins
    branches that don't hold each other, or if one leaves the branch of the node between them; parts are the components of that relation. What
    leaves a branch is seen in the least and largest `pre` that its nodes' other edges reach, gathered over branches by doubling parents.
    All steps take the logarithm of the number of nodes in joins; no node, part or component is walked in one task.
    """
    forest, labels = spanning_forest(spark, edges)
    if forest.isEmpty():
        return forest.select(F.col("src").alias("node"), F.col("dst").alias("block"))
    tree = euler_tours(spark, forest, labels)
    one = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    others = cut(spark, one.join(forest, ["src", "dst"], "left_anti"))
    span = lambda c: tree.select(F.col("node").alias(c), F.col("pre").alias(f"{c}_pre"), F.col("post").alias(f"{c}_post"))
    known = cut(spark, others.join(span("src"), "src").join(span("dst"), "dst"))
    seen = known.select(F.col("src").alias("node"), F.col("dst_pre").alias("p")).unionByName(known.select(F.col("dst").alias("node"), F.col("src_pre").alias("p")))
    reach = seen.groupBy("node").agg(F.min("p").alias("least"), F.max("p").alias("most"))
    state = cut(spark, tree.join(reach, "node", "left").select("node", "parent", "pre", "post", F.least("pre", "least").alias("low"), F.greatest("pre", "most").alias("high")))
    up = cut(spark, tree.where("parent is not null").select("node", F.col("parent").alias("up")))
    while not up.isEmpty():
        below = state.join(up, "node").groupBy(F.col("up").alias("node")).agg(F.min("low").alias("_low"), F.max("high").alias("_high"))
        state = cut(spark, state.join(below, "node", "left").select("node", "parent", "pre", "post", F.least("low", "_low").alias("low"), F.greatest("high", "_high").alias("high")))
        up = cut(spark, up.join(up.select(F.col("node").alias("up"), F.col("up").alias("far")), "up").select("node", F.col("far").alias("up")))
    above = state.select(F.col("node").alias("parent"), F.col("parent").alias("top"), F.col("pre").alias("p_pre"), F.col("post").alias("p_post"))
    leaves = state.join(above, "parent").where("top is not null and (low < p_pre or high > p_post)").select(F.col("node").alias("src"), F.col("parent").alias("dst"))
    held = lambda a, b: (F.col(f"{a}_pre") <= F.col(f"{b}_pre")) & (F.col(f"{b}_pre") < F.col(f"{a}_post"))
    apart = known.where(~held("src", "dst") & ~held("dst", "src")).select("src", "dst")
    parts = components(spark, cut(spark, leaves.unionByName(apart)))
    lower = state.where("parent is not null").join(parts, "node", "left").select("node", "parent", F.coalesce("component", "node").alias("block"))
    lower = cut(spark, lower)
    return lower.select("node", "block").unionByName(lower.select(F.col("parent").alias("node"), "block")).distinct()


#: Nodes, or sets of nodes, of a round of a search that are broadcast, after they were counted; more are joined by shuffle.
FEW = 100_000
#: Rounds of a search after which connectors are found by biconnected parts, which take the logarithm of any distance.
MOST_LAYERS = 24


def connectors(spark: SparkSession, edges: DataFrame, apart: bool = False) -> DataFrame:
    """node: those whose removal splits their part of the undirected graph. `apart`: no node is both a src and a dst.

    Nodes are told in stars: a src and its neighbours, or an edge as a star of its own and its two ends. A search from the smallest node of each component deals stars to layers:
    a star of a round has members that the search has reached (up) and others that it reaches now (down). From the last layer
    back, what lies below a layer and holds together has one label. What hangs on one star only, or with its stars on one node only, is split off by it: all else has a way to
    the start that goes up only, past any other node. An edge is looked at in the round that reaches it and in its layer; nothing is doubled over nodes or edges.
    """
    layers = _layers(spark, *_stars(spark, edges, apart))
    if layers is None:
        return blocks(spark, edges).groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node")
    found = edges.select(F.col("src").alias("node")).limit(0)
    label = None
    for depth in reversed(range(len(layers))):
        layer = layers[depth]
        # Stars that nothing hangs on are alone.
        alone = layer.where("size(down) = 0").select("star", "up")
        below = layer.where("size(down) > 0").select("star", F.explode("down").alias("node"))
        if label is not None:
            below = below.join(label, "node", "left").select("star", F.coalesce("component", "node").alias("node"))
        below = cut(spark, below.repartition("star").groupBy("star").agg(F.sort_array(F.collect_set("node")).alias("below")))
        if apart:
            found = found.unionByName(below.select("star", F.explode("below").alias("held")).groupBy("held").agg(F.min("star").alias("node"), F.max("star").alias("last")).where("node = last").select("node"))
        joined = _components_of_others(spark, _fans(below, "below"))
        held = below.select("star", F.col("below")[0].alias("first")).join(joined.select(F.col("node").alias("first"), "component"), "first", "left").select("star", F.coalesce("component", "first").alias("held"))
        pairs = cut(spark, held.join(layer.select("star", "up"), "star").select("held", F.explode("up").alias("node")).distinct())
        if depth == 0:
            parts = pairs.select("node").unionByName(alone.select(F.col("up")[0].alias("node")))
            found = found.unionByName(parts.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node"))
            break
        found = found.unionByName(pairs.groupBy("held").agg(F.min("node").alias("node"), F.max("node").alias("last")).where("node = last").select("node"))
        found = found.unionByName(alone.where("size(up) = 1").select(F.col("up")[0].alias("node")))
        label = _components_of_others(spark, pairs.select(F.col("held").alias("src"), F.col("node").alias("dst")).unionByName(_fans(alone, "up")))
    return found.distinct()


def _fans(sets: DataFrame, name: str) -> DataFrame:
    """src, dst: links of the first of each set with its others."""
    return sets.where(F.size(name) > 1).select(F.col(name)[0].alias("src"), F.explode(F.slice(name, 2, F.size(name))).alias("dst"))


def _stars(spark: SparkSession, edges: DataFrame, apart: bool) -> tuple[DataFrame, DataFrame]:
    """(star, nodes) with distinct nodes in order, and (node) of the smallest node of each component of them."""
    e = edges.where("src <> dst")
    if apart:
        stars = e.select("src", "dst").repartition("src").groupBy(F.col("src").alias("star")).agg(F.sort_array(F.collect_set("dst")).alias("nodes"))
    else:
        stars = e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().select(F.monotonically_increasing_id().alias("star"), F.array("a", "b").alias("nodes"))
    stars = cut(spark, stars)
    labels = _components_of_others(spark, _fans(stars, "nodes"))
    least = stars.where("size(nodes) = 1").select(F.col("nodes")[0].alias("node")).unionByName(labels.select(F.col("component").alias("node"))).distinct()
    return stars, cut(spark, least.join(labels.select("node"), "node", "left_anti"))


def _layers(spark: SparkSession, stars: DataFrame, front: DataFrame) -> list[DataFrame] | None:
    """(star, up, down) of each round of a search from `front` (node), which has a node of each component; None if there are more than MOST_LAYERS.

    All members of a star that a round reaches are of this round or new, so none has to be looked up among those that were seen."""
    layers: list[DataFrame] = []
    n = front.count()
    while n:
        if len(layers) == MOST_LAYERS:
            return None
        ways = stars.select("star", F.explode("nodes").alias("node"))
        near, touched = front.select("node", F.lit(True).alias("near")), None
        if n <= FEW:
            touched = cut(spark, ways.join(F.broadcast(front), "node", "left_semi").select("star").distinct())
            if touched.count() > FEW:
                touched = None
        if touched is not None:
            reached = stars.join(F.broadcast(touched), "star", "left_semi").select("star", F.explode("nodes").alias("node"))
            layer = cut(spark, _dealt(reached.join(F.broadcast(near), "node", "left")))
            stars = stars.join(F.broadcast(touched), "star", "left_anti")
        else:
            dealt = cut(spark, _dealt(ways.join(near.hint("merge"), "node", "left")))
            layer = dealt.where("size(up) > 0")
            stars = dealt.where("size(up) = 0").select("star", F.col("down").alias("nodes"))
        layers.append(layer)
        front = cut(spark, layer.select(F.explode("down").alias("node")).distinct())
        n = front.count()
    return layers


def _dealt(ways: DataFrame) -> DataFrame:
    """(star, node, near) -> star, up (the near ones), down."""
    return ways.repartition("star").groupBy("star").agg(F.collect_list(F.when(F.col("near"), F.col("node"))).alias("up"), F.collect_list(F.when(F.col("near").isNull(), F.col("node"))).alias("down"))


def entry_tree(edges: DataFrame, entries: DataFrame, width: int = 10) -> DataFrame:
    """entry, child, grandchild: what entries (node) import and what that imports, `width` of each in order. No side is small, whatever the tables are made from, so none is broadcast."""
    from pyspark.sql import Window

    e = edges.where("src <> dst").select("src", "dst").distinct()
    first = lambda rows, by: rows.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy("dst"))).where(F.col("rn") <= width).drop("rn")
    one = first(e.join(entries.select(F.col("node").alias("src")).distinct().hint("merge"), "src", "left_semi"), "src").toDF("entry", "child")
    two = first(e.join(one.select(F.col("child").alias("src")).distinct().hint("merge"), "src", "left_semi"), "src").toDF("child", "grandchild")
    return one.join(two.hint("merge"), "child", "left").select("entry", "child", F.when(F.col("grandchild") != F.col("entry"), F.col("grandchild")).alias("grandchild"))


def clusters(components_: DataFrame, least: int = 2) -> DataFrame:
    """component, size, nodes: components of `least` nodes or more, largest first."""
    return components_.groupBy("component").agg(F.count("*").alias("size"), F.sort_array(F.collect_list("node")).alias("nodes")).where(F.col("size") >= least).orderBy(F.desc("size"), "component")


def common_stats(files: DataFrame, edges: DataFrame) -> DataFrame:
    """edges, files, avg_deps (one decimal), most_imported, most_dependent (of equals the first by name)."""
    from lodestone.functions.text import round_half_up

    d = degrees(edges)
    top = lambda c: F.max_by("node", F.struct(c, F.transform(F.split("node", ""), lambda x: -F.ascii(x)).alias("name")))
    stats = d.agg(F.sum("out_deg").alias("edges"), F.when(F.max("in_deg") > 0, top("in_deg")).alias("most_imported"), F.when(F.max("out_deg") > 0, top("out_deg")).alias("most_dependent"))
    return stats.crossJoin(F.broadcast(files.agg(F.countDistinct("path").alias("files")))).select(F.coalesce("edges", F.lit(0)).cast("long").alias("edges"), "files", F.when(F.col("files") > 0, round_half_up(F.coalesce("edges", F.lit(0)) / F.col("files"), 1)).otherwise(0.0).alias("avg_deps"), "most_imported", "most_dependent")


#: Roles of a folder: the first that one of its files has.
ROLE_ORDER = ("entry", "hub", "connector", "regular", "leaf", "orphan")


def folder_roles(roles_: DataFrame) -> DataFrame:
    """(path, role) -> folder, files, role: by the order of ROLE_ORDER."""
    from lodestone.functions.text import ordinal

    rank = F.min(ordinal(F.col("role"), ROLE_ORDER))
    return roles_.groupBy(F.element_at(F.split("path", "/"), 1).alias("folder")).agg(F.count("*").alias("files"), F.get(F.array(*map(F.lit, ROLE_ORDER)), rank).alias("role"))


def health_issues(stats: DataFrame) -> DataFrame:
    """(project, files, cycles, orphans, depth, split), (coupled: files with more importers than max(10, 30 %)) -> project, note."""
    c = F.col
    s = lambda x: F.when(c(x) > 1, "s").otherwise("")
    text = lambda x: c(x).cast("string")
    notes = F.array(
        F.when(c("cycles") > 0, F.concat(text("cycles"), F.lit(" circular dependency pair"), s("cycles"), F.lit(" detected"))),
        F.when(c("orphans") > 5, F.concat(text("orphans"), F.lit(" orphan files may be dead code"))),
        F.when(c("depth") > 8, F.concat(F.lit("deepest dependency chain is "), text("depth"), F.lit(" levels"))),
        F.when(c("coupled") > 0, F.concat(text("coupled"), F.lit(" file"), s("coupled"), F.lit(" imported by more than 30% of the project"))),
        F.when(c("split") > 0, F.concat(text("split"), F.lit(" connector file"), s("split"), F.lit(" would split the graph"))),
    )
    return stats.select("project", F.explode(F.array_compact(notes)).alias("note"))
