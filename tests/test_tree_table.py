"""Trees as tables against trees as objects."""

import random
import re

import numpy as np
import pytest

from strandmill.operators import tree as t
from strandmill.operators import tree_table as tt

from .test_tree import D, NAMES, lower, path_lengths, plain_upgma


def rows_of(root, tree=0):
    nodes, links = t._neighbours(root)
    return [(tree, k, links[k][0][0] if k else None, float(n.length) if k else None, n.name) for k, n in enumerate(nodes)]


KIND = "tree int, node long, parent long, branch_length double, name string"


def clades_of(df):
    """A Clade for each tree of a table."""
    out = {}
    for r in df.collect():
        out.setdefault(r["tree"], []).append(r)
    made = {}
    for tree, rows in out.items():
        nodes = {r["node"]: t.Clade(r["name"], r["branch_length"] or 0.0) for r in rows}
        assert len(nodes) == len(rows)
        roots = [r for r in rows if r["parent"] is None]
        assert len(roots) == 1
        for r in sorted(rows, key=lambda r: r["node"]):
            if r["parent"] is not None:
                nodes[r["parent"]].children.append(nodes[r["node"]])
        made[tree] = nodes[roots[0]["node"]]
        assert len(made[tree].preorder()) == len(rows)
    return made


def grown(seed, n, negative=False):
    """A random tree of n leaves with names and lengths."""
    rng = random.Random(seed)
    parts = [t.Clade(f"l{k:03d}" if k % 5 else f"l '{k}", rng.randrange(1, 20) / 4) for k in range(n)]
    while len(parts) > 1:
        rng.shuffle(parts)
        k = min(len(parts), rng.choice([2, 2, 2, 3]))
        parts = [t.Clade(None, rng.randrange(-3 if negative else 0, 20) / 4, parts[:k]), *parts[k:]]
    return parts[0]


@pytest.fixture(scope="module")
def trees():
    chain = t.Clade("x", 1.0)
    for k in range(24):
        chain = t.Clade(None, 0.5, [chain, t.Clade(f"c{k:02d}", 1.0 + k % 3)])
    return {1: grown(1, 2), 2: grown(2, 9), 3: grown(3, 40), 4: chain, 5: t.Clade("alone"), 6: grown(6, 25, True)}


@pytest.fixture(scope="module")
def table(spark, trees):
    return spark.createDataFrame([r for k, x in trees.items() for r in rows_of(x, k)], KIND)


def test_lines_are_those_of_objects(spark, table, trees):
    got = {r["tree"]: r["line"] for r in tt.newick_lines(table).collect()}
    assert got == {k: t.to_newick(t.ordered(x)) for k, x in trees.items()}


def test_scanned_nodes_are_those_of_objects(spark, table, trees):
    texts = [(k, t.to_newick(x)) for k, x in trees.items()] + [(10, "(a,b)[note];"), (11, "('it''s':1,(b:2.5e1,'c d')inner:0.5)root;"), (12, "x:3;"), (13, ";"), (14, "((,a),);")]
    got = clades_of(tt.newick_nodes(spark.createDataFrame(texts, "tree int, line string")))
    assert {k: t.to_newick(x) for k, x in got.items()} == {k: t.to_newick(t.from_newick(x)) for k, x in texts}
    named = {k: sorted((n.name, n.length) for n in x.preorder() if n.name) for k, x in got.items()}
    assert named[11] == [("b", 25.0), ("c d", 0.0), ("inner", 0.5), ("it's", 1.0), ("root", 0.0)] and named[12] == [("x", 3.0)]
    assert tt.newick_nodes(spark.createDataFrame([], "tree int, line string")).count() == 0


@pytest.mark.parametrize("text", ["(a,b", "(a,b)", "(a,b;", "a,b;", "(a,b));", "(a;b);", "(a,b);c"])
def test_malformed_trees_raise(spark, text):
    with pytest.raises(Exception, match="malformed tree"):
        tt.newick_nodes(spark.createDataFrame([(1, text)], "tree int, line string")).collect()


def test_midpoints(table, trees):
    got = clades_of(tt.root_at_midpoint(table))
    assert got.keys() == trees.keys()
    for k, x in trees.items():
        want = path_lengths(x)
        assert path_lengths(got[k]) == pytest.approx(want)
        if k == 5:
            continue
        longest = max(want.values())
        down = sorted((max(d for _, d in _depths(c, c.length)) for c in got[k].children), reverse=True)
        assert len(got[k].children) == 2 and down[0] == pytest.approx(longest / 2)
        assert all(n.name or len(n.children) > 1 for n in got[k].preorder())


def _depths(node, at):
    stack, out = [(node, at)], []
    while stack:
        n, d = stack.pop()
        if not n.children:
            out.append((n.name, d))
        stack += [(c, d + c.length) for c in n.children]
    return out


def test_outgroups(spark, table, trees):
    names = {k: sorted(x.leaves())[len(x.leaves()) // 2] for k, x in trees.items()} | {2: "no such leaf"}
    got = clades_of(tt.root_at_outgroup(table, spark.createDataFrame(list(names.items()), "tree int, name string")))
    for k, x in trees.items():
        assert path_lengths(got[k]) == pytest.approx(path_lengths(x))
        if k not in (2, 5):
            assert any(c.name == names[k] and c.length == 0 for c in got[k].children) and len(got[k].children) == 2
    assert t.to_newick(t.ordered(got[2])) == t.to_newick(t.ordered(trees[2]))


def cells(spark, d):
    n = len(d)
    return spark.createDataFrame([(i, j, float(d[i][j])) for i in range(n) for j in range(n) if i != j], "i int, j int, d double")


def linked(spark, d, names):
    steps = tt.linkage(cells(spark, d))
    table = spark.createDataFrame(list(enumerate(names)), "i int, name string")
    return steps, tt.newick_lines(tt.linked_edges(steps, table)).first()["line"]


@pytest.mark.parametrize("seed, n", [(1, 12), (2, 33), (3, 60)])
def test_reciprocal_pairs_give_the_tree_of_single_joins(spark, seed, n):
    rng = np.random.default_rng(seed)
    d = np.tril(rng.random((n, n)) + 0.5, -1)
    if seed == 1:
        d = np.round(d * 4) / 4  # ties
    d, names = d + d.T, [f"g{k:02d}" for k in range(n)]
    steps, line = linked(spark, d, names)
    want = t.to_newick(t.ordered(plain_upgma(d, names)))
    number = re.compile(r":([0-9.]+)")
    assert number.sub("", line) == number.sub("", want) and [float(x) for x in number.findall(line)] == pytest.approx([float(x) for x in number.findall(want)], abs=2e-5)
    assert steps.count() == n - 1 and steps.select("step").distinct().count() < n - 1


def test_rows_in_any_order_give_one_tree(spark):
    d = np.ones((9, 9)) - np.eye(9)
    shuffled = cells(spark, d).repartition(7, "j")
    assert sorted(map(tuple, tt.linkage(cells(spark, d)).collect())) == sorted(map(tuple, tt.linkage(shuffled).collect()))
    assert tt.linkage(cells(spark, np.zeros((1, 1)))).count() == 0
    assert linked(spark, D, NAMES)[1] == t.to_newick(t.ordered(t.upgma(*t.cells_of(lower(spark, D, NAMES)))))


def test_a_scan_reads_no_frame_again_for_every_row(spark):
    """A frame that ends with its partition is gone through for each row, so a tree of 30,000 leaves under a node took time by the square of them."""
    line = "(" + ",".join(f"a{k}:1" for k in range(30_000)) + ")r;"
    nodes = tt.newick_nodes(spark.createDataFrame([(1, line)], "tree int, line string"))
    assert "unboundedfollowing" not in nodes._jdf.queryExecution().toString().lower()
    root = nodes.where("parent is null").first()
    assert root["name"] == "r" and nodes.where(f"parent = {root['node']}").count() == 30_000
