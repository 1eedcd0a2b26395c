"""Trees from distance matrices: neighbour joining, average linkage, rooting, order of children, Newick.

The matrix stays a DataFrame of cells. Neighbour joining searches sorted rows as far as a bound allows (see bounded_joining); average linkage joins all
pairs that are each other's nearest in a step (see tree_table). Only the pairs that are joined, and for neighbour joining a few numbers for each node, come to the driver, where the
tree grows, whose size is that of the list of genomes. Distances are fixed-point numbers, so sums are exact and ties go by order, not by chance. No step recurses, so a tree may be of any depth.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .bounded_joining import join_neighbours
from .tree_table import FIXED, linkage

METHODS = ("nj", "upgma")


@dataclass
class Clade:
    name: str | None = None
    length: float = 0.0
    children: list[Clade] = field(default_factory=list)

    def preorder(self) -> list[Clade]:
        out, stack = [], [self]
        while stack:
            out.append(stack.pop())
            stack += reversed(out[-1].children)
        return out

    def leaves(self) -> list[str]:
        return [c.name for c in self.preorder() if not c.children]


def cells_of(lower: DataFrame) -> tuple[DataFrame, dict[int, str]]:
    """(i, j, d) of a lower triangle (i, j, name_i, name_j, d) in both directions without the diagonal, stored; and the genomes' names."""
    found = stored(lower.select("i", "j", "name_i", "name_j", F.col("d").cast("double").alias("d")), "triangle")
    names = {r["i"]: r["name_i"] for r in found.where("i = j").select("i", "name_i").collect()}  # one for each genome, as in the tree
    n, bad = found.where("i > j").agg(F.count("*"), F.count_if(F.col("d").isNull() | F.isnan("d") | (F.abs("d") == float("inf")))).first()
    if not names or n != len(names) * (len(names) - 1) // 2:
        raise ValueError("a matrix needs a name for each row and every distance below the diagonal")
    if len(set(names.values())) < len(names):
        raise ValueError("names are not distinct")
    if bad:
        raise ValueError("missing distances; saturated pairs have none")
    below = found.where("i > j").select("i", "j", F.col("d").cast(FIXED).alias("d"))
    return stored(below.union(below.select("j", "i", "d")), "cells"), names


def upgma(cells: DataFrame, names: dict[int, str]) -> Clade:
    """Average linkage without weights by size (WPGMA): join the two nearest clusters at half their distance, again and again; the joined one's
    distances are the mean of the two's, and of equal pairs the last in order is joined."""
    nodes, heights = {k: Clade(n) for k, n in names.items()}, dict.fromkeys(names, 0.0)
    for r in sorted(linkage(cells).collect(), key=lambda r: (r["step"], r["kept"])):
        for k in (r["kept"], r["gone"]):
            nodes[k].length = r["height"] - heights[k]
        nodes[r["kept"]], heights[r["kept"]] = Clade(children=[nodes[r["kept"]], nodes.pop(r["gone"])]), r["height"]
    return nodes.popitem()[1]


def neighbour_joining(cells: DataFrame, names: dict[int, str]) -> Clade:
    """Saitou and Nei's neighbour joining; of equal pairs the first in order is joined. Rows are searched only as far as a bound allows: see bounded_joining."""
    order = sorted(names)
    nodes = [Clade(names[k]) for k in order]
    if len(nodes) < 2:
        return nodes[0]
    if order != list(range(len(order))):
        place = F.create_map(*[F.lit(x) for k, i in enumerate(order) for x in (i, k)])
        cells = cells.select(place[F.col("i")].alias("i"), place[F.col("j")].alias("j"), "d")
    joins, left, (u, v), _ = join_neighbours(cells, len(nodes))
    for a, b, length_a, length_b in joins:
        nodes[a].length, nodes[b].length = length_a, length_b
        nodes.append(Clade(children=[nodes[a], nodes[b]]))
    inner, outer = (nodes[u], nodes[v]) if nodes[u].children else (nodes[v], nodes[u])
    outer.length = left
    return Clade(children=[*inner.children, outer]) if inner.children else Clade(children=[nodes[u], nodes[v]])


def _neighbours(root: Clade) -> tuple[list[Clade], list[list[tuple[int, float]]]]:
    """The nodes in preorder, and each one's neighbours with the length between; a parent comes first."""
    nodes = root.preorder()
    number = {id(c): k for k, c in enumerate(nodes)}
    links: list[list[tuple[int, float]]] = [[] for _ in nodes]
    for k, node in enumerate(nodes):
        for c in node.children:
            links[number[id(c)]].append((k, c.length))
    for k, node in enumerate(nodes):
        links[k] += [(number[id(c)], c.length) for c in node.children]
    return nodes, links


def _rooted(nodes: list[Clade], links: list[list[tuple[int, float]]], a: int, b: int, from_a: float) -> Clade:
    """The tree hung up on the edge between nodes a and b, ``from_a`` away from a."""
    whole = next(w for x, w in links[a] if x == b)
    order, stack = [], [(b, a, whole - from_a), (a, b, from_a)]
    while stack:
        k, parent, length = stack.pop()
        order.append((k, parent, length))
        stack += [(x, k, w) for x, w in links[k] if x != parent]
    made: dict[int, Clade] = {}
    for k, parent, length in reversed(order):
        below = [made[x] for x, _ in links[k] if x != parent]
        if len(below) == 1 and not nodes[k].name:  # a root of old, now on the way
            made[k] = Clade(below[0].name, below[0].length + length, below[0].children)
        else:
            made[k] = Clade(nodes[k].name if not below else None, length, below)
    return Clade(children=[made[a], made[b]])


def root_at_midpoint(tree: Clade) -> Clade:
    """Hang the tree up in the middle of its longest path between leaves; of equally long ones the first in preorder."""
    nodes, links = _neighbours(tree)
    if sum(not n.children for n in nodes) < 2:
        return tree
    number = {id(c): k for k, c in enumerate(nodes)}
    down: list[tuple[float, int]] = [(0.0, -1)] * len(nodes)  # the longest way down to a leaf, and the child it goes by
    best: tuple[float, int, int, int] | None = None
    for k in range(len(nodes) - 1, -1, -1):
        ways = sorted((-(down[c][0] + nodes[c].length), c) for c in map(number.get, map(id, nodes[k].children)))
        if ways:
            down[k] = (-ways[0][0], ways[0][1])
        if len(ways) > 1 and (best is None or -ways[0][0] - ways[1][0] >= best[0]):
            best = (-ways[0][0] - ways[1][0], k, ways[0][1], ways[1][1])
    total, top, left, right = best

    def way(k: int) -> list[int]:
        out = [k]
        while down[out[-1]][1] >= 0:
            out.append(down[out[-1]][1])
        return out

    path, at = [*reversed(way(left)), top, *way(right)], 0.0
    for a, b in zip(path, path[1:]):
        step = next(w for x, w in links[a] if x == b)
        if at + step >= total / 2:
            return _rooted(nodes, links, a, b, total / 2 - at)
        at += step
    return tree


def root_at_outgroup(tree: Clade, name: str) -> Clade:
    """Hang the tree up on the edge to the leaf ``name``, which becomes the root's first child at length 0 from it."""
    nodes, links = _neighbours(tree)
    at = [k for k, n in enumerate(nodes) if n.name == name and not n.children]
    if not at:
        raise ValueError(f"no leaf {name!r}")
    return _rooted(nodes, links, at[0], links[at[0]][0][0], 0.0) if len(nodes) > 1 else tree


def ordered(tree: Clade) -> Clade:
    """Children by their least leaf name; inner nodes without names."""
    made: dict[int, tuple[str, Clade]] = {}
    for node in reversed(tree.preorder()):
        below = sorted((made[id(c)] for c in node.children), key=lambda x: x[0])
        made[id(node)] = (below[0][0] if below else node.name, Clade(None if below else node.name, node.length, [c for _, c in below]))
    return made[id(tree)][1]


def to_newick(tree: Clade) -> str:
    """Newick with five decimals; names with special characters are quoted."""
    out: list[str] = []
    stack: list[tuple[Clade, int]] = [(tree, 0)]
    while stack:
        node, done = stack.pop()
        if done < len(node.children):
            out.append("," if done else "(")
            stack += [(node, done + 1), (node.children[done], 0)]
            continue
        name = node.name or ""
        if re.search(r"[\s()\[\]':;,]", name):
            name = "'" + name.replace("'", "''") + "'"
        out.append((")" if node.children else "") + name + ("" if node is tree else f":{node.length:.5f}"))
    return "".join(out) + ";"


def from_newick(text: str) -> Clade:
    """Read one Newick tree; comments in brackets are skipped, missing lengths are 0."""
    tokens = re.findall(r"'(?:[^']|'')*'|[(),:;]|[^\s(),:;'\[]+", re.sub(r"\[[^\]]*\]", "", text))
    tree, open_, at, length = Clade(), [], 0, False
    node = tree
    while at < len(tokens) and tokens[at] != ";":
        t = tokens[at]
        if t in "(,":
            if t == "," and not open_:
                raise ValueError("a comma outside parentheses")
            if t == "(":
                open_.append(node)
            node = Clade()
            open_[-1].children.append(node)
        elif t == ")":
            if not open_:
                raise ValueError("unopened parenthesis")
            node = open_.pop()
        elif t == ":":
            length = True
        elif length:
            node.length, length = float(t), False
        else:
            node.name = t[1:-1].replace("''", "'") if t[0] == "'" else t
        at += 1
    if open_:
        raise ValueError("unclosed parenthesis")
    if at >= len(tokens):
        raise ValueError("a tree ends with a semicolon")
    return tree


def tree(lower: DataFrame, method: str = "nj", outgroup: str | None = None) -> Clade:
    """The tree of a lower triangle (i, j, name_i, name_j, d): NJ, rooted at the midpoint or an outgroup, or UPGMA; children in order."""
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    cells, names = cells_of(lower)
    if method == "upgma":
        return ordered(upgma(cells, names))
    joined = neighbour_joining(cells, names)
    return ordered(root_at_outgroup(joined, outgroup) if outgroup else root_at_midpoint(joined))


def edges(spark: SparkSession, root: Clade) -> DataFrame:
    """(node, parent, branch_length, name) of a tree, nodes numbered from the root in preorder."""
    nodes, links = _neighbours(root)
    rows = [(k, links[k][0][0] if k else None, float(n.length) if k else None, n.name) for k, n in enumerate(nodes)]
    return spark.createDataFrame(rows, "node int, parent int, branch_length double, name string")


def q_matrix(square: DataFrame, metric: str) -> DataFrame:
    """(i, j, q) for i < j: the criterion of one step of neighbour joining, over a matrix in long form."""
    sums = square.groupBy("i").agg(F.sum(metric).alias("r"), F.count("*").alias("n"))
    a, b = sums.select("i", "n", F.col("r").alias("ra")), sums.select(F.col("i").alias("j"), F.col("r").alias("rb"))
    return square.where("i < j").join(a, "i").join(b, "j").select("i", "j", ((F.col("n") - 2) * F.col(metric) - F.col("ra") - F.col("rb")).alias("q"))
