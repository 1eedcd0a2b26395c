"""Trees as tables: edges(tree, node, parent, branch_length, name), and what is done to them in about log(depth) joins.

A root has no parent. ``tree`` tells trees apart, so one plan serves any number of them. What a node needs from all its ancestors, or from all below it, is
gathered by doubling: after k rounds a node knows its 2^k-th ancestor and the sums up to there, so no step walks a tree, and a
tree may be as deep as it has nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

KEYS = ["tree", "node"]
#: Tokens of Newick: quoted names, marks, and what stands between them; comments in brackets are taken out before.
TOKEN, COMMENT = r"'(?:[^']|'')*'|[(),:;]|[^\s(),:;'\[]+", r"\[[^\]]*\]"


def _climb(nodes: DataFrame, up: dict[str, str], down: dict[str, tuple[str, str]]) -> DataFrame:
    """``nodes(tree, node, parent, …)`` with the columns of ``up`` summed over a node and all its ancestors but the root (``sum``), or their greatest value taken (``max``),
    and those of ``down`` (new name: column, sum / min / max) over the node and all below it."""
    now = nodes.withColumn("_up", F.col("parent"))
    for name, (column, _) in down.items():
        now = now.withColumn(name, F.col(column))
    now = stored(now, "nodes")
    while not now.where("_up is not null").isEmpty():
        above = now.select("tree", F.col("node").alias("_up"), F.col("_up").alias("_next"), *[F.col(c).alias(f"_{c}") for c in up])
        moved = now.join(above, ["tree", "_up"], "left")
        for c, kind in up.items():
            moved = moved.withColumn(c, F.coalesce(F.col(c) + F.col(f"_{c}"), c) if kind == "sum" else F.greatest(c, f"_{c}"))
        moved = moved.drop("_up", *[f"_{c}" for c in up]).withColumnRenamed("_next", "_up")
        if down:
            from_below = now.where("_up is not null").groupBy("tree", F.col("_up").alias("node")).agg(*[getattr(F, kind)(name).alias(f"_{name}") for name, (_, kind) in down.items()])
            moved = moved.join(from_below, KEYS, "left")
            for name, (_, kind) in down.items():
                both = F.coalesce(F.col(name) + F.col(f"_{name}"), name) if kind == "sum" else (F.least if kind == "min" else F.greatest)(name, f"_{name}")
                moved = moved.withColumn(name, both).drop(f"_{name}")
        now = stored(moved, "nodes")
    return now.drop("_up")


def _with_leaf(edges: DataFrame) -> DataFrame:
    """``edges`` and whether a node has no children."""
    inner = edges.where("parent is not null").select("tree", F.col("parent").alias("node"), F.lit(False).alias("leaf")).distinct()
    return edges.join(inner, KEYS, "left").withColumn("leaf", F.coalesce("leaf", F.lit(True)))


def root_distances(edges: DataFrame) -> DataFrame:
    """``edges`` with ``leaf`` and ``depth``, the sum of branch lengths from the root."""
    return _climb(_with_leaf(edges).withColumn("depth", F.when(F.col("parent").isNull(), 0.0).otherwise(F.coalesce("branch_length", F.lit(0.0)))), {"depth": "sum"}, {})


# --- Newick ------------------------------------------------------------------------------------


def newick_nodes(lines: DataFrame) -> DataFrame:
    """edges of the trees in ``lines(tree, line)``, a Newick text each; nodes are numbered as their texts end.

    A node ends at a comma, a closing parenthesis or the semicolon; the number of parentheses open there is its depth, a running sum; its
    parent is what ends next at a depth one less. What stands before the end is the node's name and, after a colon, its length; a missing
    length is null, a missing name null. A text whose parentheses don't match, or without its semicolon at the end, raises an error.
    """
    tokens = lines.select("tree", F.posexplode(F.regexp_extract_all(F.regexp_replace("line", COMMENT, ""), F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    by_pos = Window.partitionBy("tree").orderBy("pos")
    opened = F.sum(F.when(F.col("token") == "(", 1).when(F.col("token") == ")", -1).otherwise(0))
    marked = tokens.withColumn("open", opened.over(by_pos.rowsBetween(Window.unboundedPreceding, -1)))
    marked = marked.withColumn("depth", F.coalesce("open", F.lit(0))).withColumn("ends", F.col("token").isin(",", ")", ";")).withColumn("mark", F.col("token").isin("(", ")", ",", ":", ";"))
    back = lambda c, k: F.lag(c, k).over(by_pos)
    text = F.when(~back("mark", 1), back("token", 1))
    has_length = text.isNotNull() & (back("token", 2) == ":")
    at_name = F.when(has_length, F.when(~back("mark", 3), back("token", 3))).otherwise(text)
    last = F.lead("pos").over(by_pos).isNull()
    sound = F.when(F.col("token") == ";", (F.col("depth") == 0) & last).otherwise(~last & (F.col("depth") > 0))
    ended = marked.select("tree", "pos", "depth", "ends", F.coalesce(sound, F.lit(True)).alias("sound"), last.alias("last"), "token", at_name.alias("raw"), F.when(has_length, text.cast("double")).alias("branch_length"))
    told = F.concat(F.lit("malformed tree "), F.col("tree").cast("string"))
    checked = F.when(F.col("ends") & F.col("sound"), F.col("pos")).otherwise(F.raise_error(told))
    ended = ended.where("ends or last").withColumn("pos", checked)
    bare = F.when(F.col("raw").startswith("'"), F.replace(F.expr("substring(raw, 2, length(raw) - 2)"), F.lit("''"), F.lit("'"))).otherwise(F.col("raw"))
    # Every end stands among those of its own depth as a parent, and among those of a depth less as a child.
    roles = ended.select("*", F.explode(F.array(F.struct(F.col("depth").alias("among"), F.col("pos").alias("as_parent")), F.struct((F.col("depth") - 1).alias("among"), F.lit(None).cast("int").alias("as_parent")))).alias("role"))
    roles = roles.select("*", "role.*").drop("role")
    # Read from the end, so that the frame grows: one that shrinks is gone through again for every row.
    ahead = Window.partitionBy("tree", "among").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    found = roles.withColumn("parent", F.last("as_parent", True).over(ahead)).where("as_parent is null")
    return found.select("tree", F.col("pos").cast("long").alias("node"), F.col("parent").cast("long").alias("parent"), "branch_length", bare.alias("name"))


def _quoted(name: Column) -> Column:
    return F.when(name.rlike(r"[\s()\[\]':;,]"), F.concat(F.lit("'"), F.replace(name, F.lit("'"), F.lit("''")), F.lit("'"))).otherwise(name)


def newick_lines(edges: DataFrame) -> DataFrame:
    """(tree, line): Newick with five decimals, children by their least leaf name, inner nodes without names.

    A node takes a place in its tree's text for each parenthesis, or one as a leaf. Least leaves and numbers of places below are gathered upwards, then
    places are sums of offsets along ancestors, and the text is its tokens in order. Only that, a row for each tree, needs a tree whole.
    """
    nodes = _with_leaf(edges).withColumn("own_name", F.when(F.col("leaf"), F.coalesce("name", F.lit("")))).withColumn("own", F.when(F.col("leaf"), 1).otherwise(2).cast("long"))
    sized = _climb(nodes, {}, {"least": ("own_name", "min"), "places": ("own", "sum")})
    siblings = Window.partitionBy("tree", "parent").orderBy("least", "node")
    before = F.coalesce(F.sum("places").over(siblings.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = F.when(F.col("parent").isNull(), F.lit(0)).otherwise(before + 1).cast("long")
    placed = _climb(sized.withColumn("place", offset).withColumn("comma", F.when(F.col("parent").isNotNull() & (before > 0), ",").otherwise("")), {"place": "sum"}, {})
    length = F.when(F.col("parent").isNotNull(), F.format_string(":%.5f", F.coalesce("branch_length", F.lit(0.0)))).otherwise("")
    leaf = F.array(F.struct("place", F.concat("comma", _quoted(F.col("own_name")), length).alias("t")))
    inner = F.array(F.struct("place", F.concat("comma", F.lit("(")).alias("t")), F.struct((F.col("place") + F.col("places") - 1).alias("place"), F.concat(F.lit(")"), length).alias("t")))
    tokens = placed.select("tree", F.explode(F.when(F.col("leaf"), leaf).otherwise(inner)).alias("k"))
    whole = tokens.groupBy("tree").agg(F.array_sort(F.collect_list("k")).alias("k"))
    return whole.select("tree", F.concat(F.array_join(F.transform("k", lambda x: x["t"]), ""), F.lit(";")).alias("line"))


# --- roots -------------------------------------------------------------------------------------


def hang(edges: DataFrame, at: DataFrame) -> DataFrame:
    """Trees hung up on an edge: ``at(tree, hook, from_hook)`` names the node below the edge of each tree and how far from it the root shall be. Trees that ``at`` lacks
    stay as they are.

    The edges from the hook to the old root are flipped. The old root goes if but one edge is left to it and it has no name.
    """
    hooked = edges.join(at, "tree").withColumn("below", (F.col("node") == F.col("hook")).cast("int"))
    pathed = _climb(hooked, {}, {"on_path": ("below", "max")})
    path = pathed.where("on_path = 1 and parent is not null")
    top = pathed.where("parent is null").select("tree", F.col("node").alias("old_root"), F.col("name").alias("root_name"), F.col("hook").alias("was"))
    # The new root takes the number after all others.
    new_root = pathed.groupBy("tree").agg((F.max("node") + 1).alias("new_root"))
    flipped = path.join(new_root, "tree").select(
        "tree", F.col("parent").alias("node"), F.when(F.col("node") == F.col("hook"), F.col("new_root")).otherwise(F.col("node")).alias("parent"),
        (F.coalesce("branch_length", F.lit(0.0)) - F.when(F.col("node") == F.col("hook"), F.col("from_hook")).otherwise(0.0)).alias("branch_length"),
    )
    flipped = flipped.join(edges.select("tree", "node", "name"), KEYS)
    hook = path.where("node = hook").join(new_root, "tree").select("tree", "node", F.col("new_root").alias("parent"), F.col("from_hook").alias("branch_length"), "name")
    root = path.where("node = hook").join(new_root, "tree").select("tree", F.col("new_root").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(None).cast("double").alias("branch_length"), F.lit(None).cast("string").alias("name"))
    same = pathed.where("on_path = 0").select("tree", "node", "parent", "branch_length", "name")
    hung = stored(same.unionByName(flipped).unionByName(hook).unionByName(root), "hung")
    # An old root on the way between two nodes: its child goes to its parent, by the sum of both lengths.
    left = hung.join(top.where("root_name is null and old_root <> was"), "tree")
    single = left.where("parent = old_root").groupBy("tree", "old_root").agg(F.count("*").alias("n")).where("n = 1").drop("n")
    gone = left.where("node = old_root").join(single, ["tree", "old_root"]).select("tree", "old_root", F.col("parent").alias("over"), F.col("branch_length").alias("more"))
    mended = hung.join(gone, "tree", "left").where("old_root is null or node <> old_root")
    moved = F.col("parent").eqNullSafe(F.col("old_root")) & F.col("old_root").isNotNull()
    mended = mended.select("tree", "node", F.when(moved, F.col("over")).otherwise(F.col("parent")).alias("parent"), F.when(moved, F.col("branch_length") + F.col("more")).otherwise(F.col("branch_length")).alias("branch_length"), "name")
    # A tree whose hook is its root stays.
    whole = path.where("node = hook").select("tree").distinct()
    return mended.join(whole, "tree", "left_semi").unionByName(edges.select("tree", "node", "parent", "branch_length", "name").join(whole, "tree", "left_anti"))


def root_at_outgroup(edges: DataFrame, outgroups: DataFrame) -> DataFrame:
    """Trees rooted at the leaf that ``outgroups(tree, name)`` names, which hangs from the root at length 0; a tree without that leaf stays as it is."""
    leaves = _with_leaf(edges).where("leaf").join(outgroups, ["tree", "name"])
    return hang(edges, leaves.groupBy("tree").agg(F.min("node").alias("hook")).withColumn("from_hook", F.lit(0.0)))


def root_at_midpoint(edges: DataFrame) -> DataFrame:
    """Trees rooted in the middle of their longest path between leaves; branch lengths may be negative.

    Every node learns the deepest leaf below it; a node's longest path is that of its two deepest children. Of equally long paths that
    with the least top, by number, is taken. Trees of fewer than two leaves stay as they are.
    """
    deep = root_distances(edges)
    below = _climb(deep.withColumn("end", F.when(F.col("leaf"), F.struct("depth", (-F.col("node")).alias("n")))), {}, {"far": ("end", "max")})
    ways = below.where("parent is not null").withColumn("way", F.row_number().over(Window.partitionBy("tree", "parent").orderBy(F.desc("far"), "node"))).where("way <= 2")
    tops = ways.groupBy("tree", F.col("parent").alias("top")).agg(F.max(F.when(F.col("way") == 1, F.col("far"))).alias("a"), F.max(F.when(F.col("way") == 2, F.col("far"))).alias("b")).where("b is not null")
    tops = tops.join(deep.select("tree", F.col("node").alias("top"), F.col("depth").alias("at")), ["tree", "top"])
    total = F.round(F.col("a")["depth"] + F.col("b")["depth"] - 2 * F.col("at"), 12)
    best = tops.groupBy("tree").agg(F.max(F.struct(total.alias("total"), (-F.col("top")).alias("t"), "a", "at")).alias("x"))
    best = stored(best.select("tree", (-F.col("x.t")).alias("top"), (F.col("x.total") / 2).alias("half"), (-F.col("x.a.n")).alias("leaf_node"), F.col("x.a.depth").alias("leaf_depth"), F.col("x.at").alias("top_depth")), "longest")
    # The middle lies on the way down to the deeper of both leaves: on the first edge, seen from that leaf, that reaches it.
    flagged = below.join(best, "tree").withColumn("mine", (F.col("node") == F.col("leaf_node")).cast("int")).withColumn("hops", F.lit(1))
    path = _climb(flagged.drop("far"), {"hops": "sum"}, {"on_path": ("mine", "max")}).where("on_path = 1 and parent is not null")
    upper = deep.select("tree", F.col("node").alias("parent"), F.col("depth").alias("parent_depth"))
    reached = path.join(upper, ["tree", "parent"]).where(F.col("leaf_depth") - F.col("parent_depth") >= F.col("half") - 1e-12)
    hook = reached.groupBy("tree").agg(F.max(F.struct("hops", "node", "depth", "half", "leaf_depth")).alias("h"))
    return hang(edges, hook.select("tree", F.col("h.node").alias("hook"), (F.col("h.half") - (F.col("h.leaf_depth") - F.col("h.depth"))).alias("from_hook")))


def leaves_below(edges: DataFrame) -> DataFrame:
    """(tree, leaf, node, branch_length): for every node, itself included, the names of the leaves below it; as many rows as paths from leaves have nodes."""
    nodes = stored(_with_leaf(edges).withColumn("branch_length", F.coalesce("branch_length", F.lit(0.0))), "nodes")
    now = nodes.where("leaf").select("tree", F.col("name").alias("leaf"), "node", "parent", "branch_length")
    upper = nodes.select("tree", F.col("node").alias("parent"), F.col("parent").alias("next"), F.col("branch_length").alias("over"))
    out = []
    while True:
        now = stored(now, "paths")
        if now.isEmpty():
            break
        out.append(now.select("tree", "leaf", "node", "branch_length"))
        now = now.join(upper, ["tree", "parent"]).select("tree", "leaf", F.col("parent").alias("node"), F.col("next").alias("parent"), F.col("over").alias("branch_length"))
    found = out[0] if out else now.select("tree", "leaf", "node", "branch_length")
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def path_lengths(edges: DataFrame) -> DataFrame:
    """(tree, a, b, d) for the leaves a < b of a tree: both sums of branch lengths from the root, less what their paths share."""
    below = stored(leaves_below(edges), "below")
    sums = below.groupBy("tree", "leaf").agg(F.sum("branch_length").alias("s"))
    shared = below.select("tree", "node", F.col("leaf").alias("a"), "branch_length").join(below.select("tree", "node", F.col("leaf").alias("b")), KEYS).where("a < b").groupBy("tree", "a", "b").agg(F.sum("branch_length").alias("both"))
    return shared.join(sums.toDF("tree", "a", "sa"), ["tree", "a"]).join(sums.toDF("tree", "b", "sb"), ["tree", "b"]).select("tree", "a", "b", (F.col("sa") + F.col("sb") - 2 * F.col("both")).alias("d"))


# --- average linkage ---------------------------------------------------------------------------

#: Distances are whole multiples of 1e-15, so sums are exact and ties do not hang on the order of rows.
FIXED = "decimal(24,15)"


def linkage(cells: DataFrame) -> DataFrame:
    """(step, kept, gone, height) of average linkage without weights by size (WPGMA) over ``cells(i, j, d)``, all i <> j in both directions.

    In a step all pairs that are each other's nearest are joined, not the nearest pair of all alone: means never come closer than what they
    are means of, so such a pair stays nearest until it is joined, and the tree is that of joining pairs one by one. Of equal distances the last pair in order
    (greater number, then smaller one) is nearer; the joined cluster goes by the smaller number. Steps are about log n, n in a chain.
    """
    cells, out, step = stored(cells.select("i", "j", F.col("d").cast(FIXED).alias("d")), "cells"), None, 0
    while not cells.isEmpty():
        near = cells.groupBy("i").agg(F.min(F.struct("d", (-F.greatest("i", "j")).alias("a"), (-F.least("i", "j")).alias("b"), "j")).alias("n")).select("i", "n.d", "n.j")
        pairs = near.alias("x").join(near.alias("y"), F.expr("x.i = y.j and x.j = y.i and x.i > x.j")).select(F.lit(step).alias("step"), F.col("x.j").alias("kept"), F.col("x.i").alias("gone"), (F.col("x.d") / 2).cast("double").alias("height"))
        pairs = stored(pairs, "pairs")
        out = pairs if out is None else out.unionByName(pairs)
        turned = lambda c: pairs.select(F.col("gone").alias(c), F.col("kept").alias(f"_{c}"))
        named = cells.join(turned("i"), "i", "left").join(turned("j"), "j", "left").select(F.coalesce("_i", "i").alias("i"), F.coalesce("_j", "j").alias("j"), "d")
        # One, two or four cells of equal weight.
        cells = stored(named.where("i <> j").groupBy("i", "j").agg((F.sum("d") / F.count("*")).cast(FIXED).alias("d")), "cells")
        step += 1
    return out if out is not None else cells.sparkSession.createDataFrame([], "step int, kept int, gone int, height double")


def linked_edges(steps: DataFrame, names: DataFrame) -> DataFrame:
    """edges of one tree from ``linkage`` and ``names(i, name)``: leaves by their numbers, joined clusters by a number for each step and cluster."""
    ends = stored(steps.withColumn("node", (F.col("step") + 1).cast("long") * 1_000_000_000 + F.col("kept")), "joins")
    leaves = names.select(F.col("i").cast("long").alias("node"), F.col("i").cast("long").alias("cluster"), F.lit(-1).alias("since"), F.lit(0.0).alias("height"), "name")
    joined = ends.select("node", F.col("kept").cast("long").alias("cluster"), F.col("step").alias("since"), "height", F.lit(None).cast("string").alias("name"))
    made = leaves.unionByName(joined)
    # A cluster's node ends when the cluster is next joined, as either side.
    uses = ends.select(F.explode(F.array(F.col("kept").cast("long"), F.col("gone").cast("long"))).alias("cluster"), "step", F.col("node").alias("parent"), F.col("height").alias("over"))
    next_ = made.join(uses, "cluster", "left").where("step is null or step > since").groupBy("node", "name", "height").agg(F.min(F.struct("step", "parent", "over")).alias("n"))
    whole = made.select("node", "name", "height").join(next_.select("node", F.col("n.parent").alias("parent"), F.col("n.over").alias("over")), "node", "left")
    return whole.select(F.lit(0).alias("tree"), "node", "parent", (F.col("over") - F.col("height")).alias("branch_length"), "name")
