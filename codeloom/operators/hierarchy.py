"""Parent-child links to full hierarchies.

The method: a spanning forest of the links is numbered by nested sets. Subtree sizes are summed
upward and preorder offsets downward, both by pointer doubling (the number of rounds is the
logarithm of the depth), and siblings get their ranges by prefix sums in two levels, so a parent
with a third of all rows never lands in one task. Nodes that no round finishes lie on or below a
cycle; one link of each cycle is set aside. Ancestors and descendants come from the ranges by an
equi-join over dyadic blocks. Links that the forest does not hold (further uppers of a node, links
set aside, loops) are closed over afterwards, whole subtrees at a time.

Names are replaced by numbers in their order before the first round, so the rounds move longs only;
a round moves the nodes that are still open, and what it finishes is written once. Names come back
in one join at the end.

Defined results: rows with a null key are ignored; repeated rows count once; links whose upper is
no node are ignored; an empty table gives an empty result; columns other than those named are not
looked at.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.runtime import checkpoint, checkpoint_counting, scan

#: Siblings are numbered in this many blocks, and the blocks then among one another.
SIBLING_BLOCKS = 256


class Forest(NamedTuple):
    """names: (id, tree, node), ids in the order of tree and node; nodes: (id, up, root, depth, pre, size); aside: (id, up).

    A node's descendants in the forest are the nodes of its root with pre in (pre, pre + size). aside holds the links that
    are not in the forest.
    """

    names: DataFrame
    nodes: DataFrame
    aside: DataFrame


def _sizes_up(step: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Subtree size, depth and root of each node by pointer doubling.

    step: (id, up), one row a node, up null at a root. Returns the finished nodes (id, up, root, depth, size), those that no
    round finishes (id, up, jump), and how many these are.
    """
    is_root, is_open = F.col("up").isNull(), F.col("jump").isNotNull()
    state = step.select("id", "up", F.col("up").alias("jump"), F.lit(1).cast("long").alias("size"), F.when(is_root, 0).otherwise(1).cast("long").alias("depth"), F.when(is_root, F.col("id")).alias("root"))
    state, still_open = checkpoint_counting(state, is_open)
    states, open_before = [state], -1
    # A round halves the open depth of every chain that ends: equal counts mean only cycles are left.
    while still_open not in (0, open_before):
        open_before, open_ = still_open, states[-1].filter(is_open)
        gain = open_.groupBy(F.col("jump").alias("id")).agg(F.sum("size").alias("more"))
        known = scan(states).filter("jump is null").unionByName(open_) if len(states) > 1 else states[0]
        known = known.select(F.col("id").alias("jump"), F.col("jump").alias("jump2"), F.col("depth").alias("depth2"), F.col("root").alias("root2"))
        after = open_.join(known, "jump").join(gain, "id", "left")
        after = after.select("id", "up", F.col("jump2").alias("jump"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"), (F.col("depth") + F.col("depth2")).alias("depth"), F.col("root2").alias("root"))
        after, still_open = checkpoint_counting(after, is_open)
        states.append(after)
    # What the rounds added to a node, all together, is its subtree but itself.
    total = scan(states).filter(is_open).groupBy(F.col("jump").alias("id")).agg(F.sum("size").alias("more"))
    done = scan(states).filter("jump is null").join(total, "id", "left").select("id", "up", "root", "depth", (1 + F.coalesce("more", F.lit(0))).alias("size"))
    return done, states[-1].filter(is_open).select("id", "up", "jump"), still_open


def _cut_cycles(open_nodes: DataFrame) -> DataFrame:
    """The nodes (id) whose link to ``up`` is set aside: the least node of each cycle.

    open_nodes: nodes on or below cycles, with one upper each and a jump that outruns other chains. The
    image under ever larger jumps shrinks to the nodes on cycles; there the least name goes round by
    doubling.
    """
    state, size = open_nodes.select("id", "jump"), -1
    while True:
        image, now = checkpoint_counting(state.select(F.col("jump").alias("id")).distinct())
        if now == size:
            break
        size = now
        ahead = state.select(F.col("id").alias("jump"), F.col("jump").alias("jump2"))
        state = checkpoint(state.join(ahead, "jump").select("id", F.col("jump2").alias("jump")))
    ring = open_nodes.join(image, "id", "left_semi").select("id", F.col("up").alias("jump"), F.least("id", "up").alias("least"))
    moved = 1
    while moved:
        ahead = ring.select(F.col("id").alias("jump"), F.col("jump").alias("jump2"), F.col("least").alias("least2"))
        after = ring.join(ahead, "jump").select("id", F.col("jump2").alias("jump"), F.least("least", "least2").alias("least"), (F.col("least2") < F.col("least")).alias("moved"))
        ring, moved = checkpoint_counting(after, F.col("moved"))
        ring = ring.drop("moved")
    return ring.filter(F.col("id") == F.col("least")).select("id")


def _sibling_offsets(sized: DataFrame) -> DataFrame:
    """Offset of each node's range within its parent's: 1 plus the sizes of the siblings before it."""
    kids = sized.filter(F.col("up").isNotNull()).select("id", "up", "size", F.pmod(F.xxhash64("id"), F.lit(SIBLING_BLOCKS)).alias("block"))
    before = Window.partitionBy("up", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    blocks = kids.groupBy("up", "block").agg(F.sum("size").alias("total"))
    ahead = Window.partitionBy("up").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("start", F.coalesce(F.sum("total").over(ahead), F.lit(0))).drop("total")
    return kids.withColumn("within", F.coalesce(F.sum("size").over(before), F.lit(0))).join(blocks, ["up", "block"]).select("id", (1 + F.col("start") + F.col("within")).alias("offset"))


def _offsets_down(sized: DataFrame) -> DataFrame:
    """The nodes with pre, the sum of the offsets on the way from the root, by pointer doubling."""
    rows = sized.join(_sibling_offsets(sized), "id", "left").select("id", "up", "root", "depth", "size", F.coalesce("offset", F.lit(0)).cast("long").alias("pre"), F.col("up").alias("jump"))
    rows, still_open = checkpoint_counting(rows, F.col("jump").isNotNull())
    states = [rows]
    while still_open:
        open_ = states[-1].filter("jump is not null")
        known = scan(states).filter("jump is null").unionByName(open_) if len(states) > 1 else rows
        known = known.select(F.col("id").alias("jump"), F.col("jump").alias("jump2"), F.col("pre").alias("pre2"))
        after = open_.join(known, "jump").select("id", "up", "root", "depth", "size", (F.col("pre") + F.col("pre2")).alias("pre"), F.col("jump2").alias("jump"))
        after, still_open = checkpoint_counting(after, F.col("jump").isNotNull())
        states.append(after)
    return scan(states).filter("jump is null").drop("jump")


def numbered(nodes: DataFrame, edges: DataFrame) -> Forest:
    """Number a spanning forest of the links by nested sets; of several uppers the least is taken.

    nodes: (tree, node); edges: (tree, node, up). ``tree`` names the kind of link.
    """
    names = checkpoint(nodes.select("tree", "node").dropna().distinct().orderBy("tree", "node").select(F.monotonically_increasing_id().alias("id"), "tree", "node"))
    links = edges.select("tree", "node", "up").dropna().join(names, ["tree", "node"]).select("tree", "id", "up")
    links = checkpoint(links.join(names.select("tree", F.col("node").alias("up"), F.col("id").alias("above")), ["tree", "up"]).select("id", F.col("above").alias("up")).distinct())
    first = links.filter("id <> up").groupBy("id").agg(F.min("up").alias("up"))
    done, stuck, n = _sizes_up(names.select("id").join(first, "id", "left"))
    if n:
        cut = _cut_cycles(stuck).withColumn("cut", F.lit(True))
        again = stuck.join(cut, "id", "left").select("id", F.when(F.col("cut").isNull(), F.col("up")).alias("up"))
        done = done.unionByName(_sizes_up(again)[0])
    forest = _offsets_down(checkpoint(done))
    aside = links.join(forest.filter("up is not null").select("id", "up"), ["id", "up"], "left_anti")
    return Forest(names, forest, checkpoint(aside))


def nested_sets(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The numbered nodes by name (tree, node, up, root, depth, pre, size), and the links left aside (tree, node, up)."""
    forest = numbered(nodes, edges)
    name = lambda c: forest.names.select(F.col("id").alias(c), F.col("node").alias(f"{c}_name"))
    rows = forest.nodes.join(forest.names, "id").join(name("up"), "up", "left").join(name("root"), "root")
    aside = forest.aside.join(forest.names, "id").join(name("up"), "up")
    return rows.select("tree", "node", F.col("up_name").alias("up"), F.col("root_name").alias("root"), "depth", "pre", "size"), aside.select("tree", "node", F.col("up_name").alias("up"))


def forest_pairs(nodes: DataFrame, below: DataFrame | None = None, above: DataFrame | None = None) -> DataFrame:
    """All (id, above) of the numbered nodes, id below above; of given nodes only, where a column of ids says which.

    A range is the union of at most two aligned blocks of each power of two, a number lies in one
    block of each; so the containment join is an equi-join that meets each pair once.
    """
    tops = nodes.filter("up is null and size > 1").select("root", F.ceil(F.log2("size")).cast("int").alias("bits"))
    spans = nodes.join(tops, "root")
    some = lambda only: spans if only is None else spans.join(only.select(F.col(only.columns[0]).alias("id")).distinct(), "id", "left_semi")
    points = some(below).filter("up is not null").select("root", "id", "pre", F.explode(F.expr("sequence(0, bits)")).alias("level")).withColumn("block", F.expr("shiftright(pre, level)")).drop("pre")
    ranges = some(above).filter("size > 1").select(
        "root",
        F.col("id").alias("above"),
        F.explode(
            F.expr(
                """flatten(transform(transform(sequence(0, bits), l -> named_struct('l', l,
                    'lo', shiftright(pre + shiftleft(1L, l), l), 'hi', shiftright(pre + size, l))),
                    s -> filter(array(
                        if(s.lo < s.hi and s.lo % 2 = 1, named_struct('level', s.l, 'block', s.lo), null),
                        if(s.hi % 2 = 1 and s.hi - 1 >= s.lo + s.lo % 2, named_struct('level', s.l, 'block', s.hi - 1), null)),
                        b -> b is not null)))"""
            )
        ).alias("b"),
    ).select("root", "above", "b.level", "b.block")
    return points.join(ranges, ["root", "level", "block"]).select("id", "above")


def pairs_beyond(forest: Forest) -> DataFrame | None:
    """(id, above) of the ancestors that are reached over links aside only, or None if there are no such links.

    The rounds hold the nodes below links aside and the ancestors above them, whole subtrees at a time.
    """
    nodes, aside = forest.nodes, forest.aside
    if aside.isEmpty():
        return None
    tails, vias = aside.select(F.col("id").alias("tail"), F.col("up").alias("via")), aside.select(F.col("up").alias("id")).distinct()
    own = lambda ids: ids.select("id", F.col("id").alias("above"))
    beyond = checkpoint(forest_pairs(nodes, below=vias).unionByName(own(vias))).select(F.col("id").alias("via"), "above")
    ends = aside.select("id").distinct()
    fresh = checkpoint(forest_pairs(nodes, above=ends).unionByName(own(ends)))
    known = checkpoint(forest_pairs(nodes, below=fresh.select("id")))
    found: list[DataFrame] = []
    while True:
        met = fresh.join(tails, fresh["above"] == tails["tail"]).select("id", "via").distinct()
        met = met.join(beyond, "via").select("id", "above").distinct()
        fresh, n = checkpoint_counting(met.join(scan([known, *found]), ["id", "above"], "left_anti"))
        if not n:
            return scan(found) if found else None
        found.append(fresh)


def id_pairs(forest: Forest) -> DataFrame:
    """All distinct (id, above): above is an ancestor of the node over one or more links; a node on a cycle is its own."""
    pairs, beyond = forest_pairs(forest.nodes), pairs_beyond(forest)
    return pairs if beyond is None else pairs.unionByName(beyond)


def named(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """(tree, node, above): pairs of ids by their names."""
    above = names.select(F.col("id").alias("above"), F.col("node").alias("above_name"))
    return pairs.join(names, "id").join(above, "above").select("tree", "node", F.col("above_name").alias("above"))


def ancestor_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All distinct (tree, node, above): above is an ancestor of node over one or more links.

    A node on a cycle is its own ancestor. nodes: (tree, node); edges: (tree, node, up).
    """
    forest = numbered(nodes, edges)
    return named(id_pairs(forest), forest.names)


def hierarchy(nodes: DataFrame, edges: DataFrame, separator: str = " > ") -> DataFrame:
    """One row a node: its root, depth, path from the root, number of ancestors and descendants, and whether it lies on a cycle.

    Path, root and depth follow the spanning forest (of several uppers the least); the counts follow all links: those of the
    forest are the depth and the size, and only the pairs beyond it are counted.
    """
    forest = numbered(nodes, edges)
    beyond, names = pairs_beyond(forest), forest.names
    label = names.select(F.col("id").alias("above"), F.col("node").alias("name"))
    steps = forest_pairs(forest.nodes).join(forest.nodes.select(F.col("id").alias("above"), "depth"), "above").join(label, "above")
    trail = steps.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("depth", "name"))).alias("trail")).select("id", F.transform("trail", lambda s: s["name"]).alias("names"))
    rows = forest.nodes.join(names, "id").join(label.select(F.col("above").alias("root"), F.col("name").alias("root_name")), "root").join(trail, "id", "left")
    ups, downs, cycle = F.col("depth"), F.col("size") - 1, F.lit(False)
    if beyond is not None:
        more = beyond.groupBy("id").agg(F.count("*").alias("ups"), F.max(F.col("id") == F.col("above")).alias("cycle"))
        rows = rows.join(more, "id", "left").join(beyond.groupBy(F.col("above").alias("id")).agg(F.count("*").alias("downs")), "id", "left")
        ups, downs, cycle = ups + F.coalesce("ups", F.lit(0)), downs + F.coalesce("downs", F.lit(0)), F.coalesce("cycle", F.lit(False))
    path = F.array_join(F.concat(F.coalesce("names", F.array().cast("array<string>")), F.array("node")), separator)
    return rows.select("tree", "node", F.col("root_name").alias("root"), "depth", "pre", "size", path.alias("path"), ups.alias("ancestors"), downs.alias("descendants"), cycle.alias("on_cycle"))


def symbol_links(symbols: DataFrame, bases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (tree, node) and edges (tree, node, up) of the two hierarchies over symbols and bases.

    tree 'parent': symbols by ``file::qualname`` under ``file::parent``. tree 'base': classes under
    their bases, a class of the same file by qualname first, else any class by its dotted name.
    """
    name = F.concat(F.col("file"), F.lit("::"), F.col("qualname"))
    symbol = symbols.select("file", "qualname", "kind", "parent", name.alias("node")).dropna(subset=["node"])
    classes = symbol.filter("kind = 'class'").select("file", "qualname", "node").distinct()
    nodes = symbol.select(F.lit("parent").alias("tree"), "node").unionByName(classes.select(F.lit("base").alias("tree"), "node"))
    parents = symbol.filter("parent is not null and parent <> ''").select(F.lit("parent").alias("tree"), "node", F.concat("file", F.lit("::"), "parent").alias("up"))
    link = bases.select("file", "qualname", "base").dropna().distinct().withColumn("node", name)
    same = classes.select("file", F.col("qualname").alias("base"), F.col("node").alias("up"))
    stem = F.regexp_replace(F.regexp_replace("file", r"\.[^./]*$", ""), "/", ".")
    anywhere = classes.select(F.concat(stem, F.lit("."), "qualname").alias("base"), F.col("node").alias("up"))
    near = link.join(same, ["file", "base"])
    far = link.join(same, ["file", "base"], "left_anti").join(anywhere, "base")
    edges = parents.unionByName(near.unionByName(far.select(near.columns)).select(F.lit("base").alias("tree"), "node", "up"))
    return nodes, edges
