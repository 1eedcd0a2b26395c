import numpy as np
import pytest

from strandmill.operators import bounded_joining
from strandmill.operators import tree as t

#: A textbook example (additive): leaf distances of ((a:2,b:3):3,c:4,(d:2,e:1):2).
NAMES = list("abcde")
D = np.array([[0, 5, 9, 9, 8], [5, 0, 10, 10, 9], [9, 10, 0, 8, 7], [9, 10, 8, 0, 3], [8, 9, 7, 3, 0]], float)


def lower(spark, d, names):
    rows = [(i, j, names[i], names[j], float(d[i][j])) for i in range(len(names)) for j in range(i + 1)]
    return spark.createDataFrame(rows, "i int, j int, name_i string, name_j string, d double")


def nj(spark, d, names):
    return t.neighbour_joining(*t.cells_of(lower(spark, d, names)))


def upgma(spark, d, names):
    return t.upgma(*t.cells_of(lower(spark, d, names)))


def plain_nj(d, names):
    """Neighbour joining on an array."""
    d, nodes = np.array(d, float), [t.Clade(n) for n in names]
    while len(nodes) > 2:
        n, r = len(nodes), d.sum(1) / (len(nodes) - 2)
        _, i, j = min((d[i, j] - r[i] - r[j], i, j) for i in range(1, n) for j in range(i))
        nodes[i].length = (d[i, j] + r[i] - r[j]) / 2
        nodes[j].length = d[i, j] - nodes[i].length
        joined = (d[i] + d[j] - d[i, j]) / 2
        nodes[j] = t.Clade(children=[nodes[i], nodes[j]])
        d[j] = d[:, j] = joined
        d[j, j] = 0
        d = np.delete(np.delete(d, i, 0), i, 1)
        del nodes[i]
    nodes[1].length = d[0, 1]
    return t.Clade(children=nodes)


def plain_upgma(d, names):
    """Average linkage on an array."""
    d, nodes, heights = np.array(d, float), [t.Clade(n) for n in names], [0.0] * len(names)
    while len(nodes) > 1:
        _, i, j = min((d[i, j], -i, -j) for i in range(1, len(nodes)) for j in range(i))
        i, j = -i, -j
        for k in (i, j):
            nodes[k].length = d[i, j] / 2 - heights[k]
        nodes[j], heights[j] = t.Clade(children=[nodes[j], nodes[i]]), d[i, j] / 2
        d[j] = d[:, j] = (d[i] + d[j]) / 2
        d[j, j] = 0
        d = np.delete(np.delete(d, i, 0), i, 1)
        del nodes[i], heights[i]
    return nodes[0]


def path_lengths(root):
    nodes, links = t._neighbours(root)
    out = {}
    for k, n in enumerate(nodes):
        if n.children or n.name is None:
            continue
        stack = [(k, -1, 0.0)]
        while stack:
            x, parent, d = stack.pop()
            if not nodes[x].children:
                out[n.name, nodes[x].name] = d
            stack += [(y, x, d + w) for y, w in links[x] if y != parent]
    return out


@pytest.mark.parametrize("change", [lambda x: x, t.root_at_midpoint, lambda x: t.root_at_outgroup(x, "c"), t.ordered])
def test_nj_recovers_an_additive_matrix(spark, change):
    got = path_lengths(change(nj(spark, D, NAMES)))
    for i, a in enumerate(NAMES):
        for j, b in enumerate(NAMES):
            assert got[a, b] == pytest.approx(D[i, j])


@pytest.mark.parametrize("seed", [1, 2])
def test_trees_are_those_of_arrays(spark, seed):
    rng = np.random.default_rng(seed)
    d = np.tril(rng.random((9, 9)) + 0.5, -1)
    d, names = d + d.T, [f"g{k}" for k in range(9)]
    assert t.to_newick(t.ordered(upgma(spark, d, names))) == t.to_newick(t.ordered(plain_upgma(d, names)))
    got, want = (path_lengths(x) for x in (nj(spark, d, names), plain_nj(d, names)))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_a_tree_of_any_depth():
    root, deep = t.Clade("x", 1.0), 5000
    for k in range(deep):
        root = t.Clade(None, 1.0, [root, t.Clade(f"l{k}", 1.0)])
    text = t.to_newick(root)
    assert t.to_newick(t.from_newick(text)) == text
    middle = t.root_at_midpoint(root)
    assert len(t.ordered(middle).leaves()) == deep + 1 and len(t.root_at_outgroup(root, "l7").leaves()) == deep + 1


def test_midpoint_is_in_the_middle(spark):
    root = t.root_at_midpoint(nj(spark, D, NAMES))
    depth = lambda c: max([depth(x) + x.length for x in c.children], default=0.0)
    a, b = (depth(c) + c.length for c in root.children)
    assert a == pytest.approx(b) == pytest.approx(5)


def test_upgma_by_hand(spark):
    d = np.array([[0, 2, 6], [2, 0, 8], [6, 8, 0]], float)
    assert t.to_newick(t.ordered(upgma(spark, d, ["a", "b", "c"]))) == "((a:1.00000,b:1.00000):2.50000,c:3.50000);"


def test_small_trees_and_checks(spark):
    assert t.to_newick(nj(spark, np.zeros((1, 1)), ["a"])) == "a;"
    assert t.root_at_midpoint(nj(spark, np.array([[0, 4.0], [4, 0]]), ["a", "b"])).children[0].length == 2
    for bad in (lower(spark, np.zeros((2, 2)), ["a", "a"]), lower(spark, np.array([[0, np.nan], [np.nan, 0]]), ["a", "b"]), lower(spark, D, NAMES).where("i <> 3 or j <> 1")):
        with pytest.raises(ValueError):
            t.tree(bad)
    with pytest.raises(ValueError):
        t.tree(lower(spark, D, NAMES), "nj", "z")


def test_newick_round_trip():
    text = "(('it''s':1.00000,b c:0.50000):2.00000,c:3.00000);".replace("b c", "'b c'")
    assert t.to_newick(t.from_newick(text)) == text
    assert t.from_newick("(a,b)[note];").leaves() == ["a", "b"]
    for bad in ("(a,b", "(a,b)", "(a,b;"):
        with pytest.raises(ValueError):
            t.from_newick(bad)


def test_edges(spark):
    rows = t.edges(spark, t.ordered(upgma(spark, D, NAMES))).collect()
    assert len(rows) == 9 and sum(r["name"] is not None for r in rows) == 5 and [r["parent"] for r in rows].count(None) == 1


@pytest.mark.parametrize("seed, n, spread", [(1, 16, 1.0), (2, 12, 0.0), (3, 22, 8.0)])
def test_bounded_search_finds_the_same_joins_in_fewer_cells(spark, monkeypatch, seed, n, spread):
    """Joins are those of a search of all cells in exact numbers, ties included; far fewer cells are read where distances differ."""
    monkeypatch.setattr(bounded_joining, "FIRST", 4)
    rng = np.random.default_rng(seed)
    place = rng.random((n, 3)) * spread
    d = np.round(np.abs(place[:, None] - place[None]).sum(2) + (rng.random((n, n)) * 0.1 if spread else 1.0), 6)
    d = np.tril(d, -1)
    d += d.T
    cells = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(n) for j in range(n) if i != j], "i int, j int, d double")
    joins, left, last, searched = bounded_joining.join_neighbours(cells, n)
    own = {k: {j: round(d[k, j] * bounded_joining.UNIT) for j in range(n) if j != k} for k in range(n)}
    number, want, all_cells = list(range(n)), [], 0
    while len(own) > 2:
        m, r = len(own) - 2, {k: sum(x.values()) for k, x in own.items()}
        all_cells += len(own) * (len(own) - 1)
        _, _, _, a, b = min((m * x - r[k] - r[j], max(number[k], number[j]), min(number[k], number[j]), *((k, j) if number[k] > number[j] else (j, k))) for k, row in own.items() for j, x in row.items() if k < j)
        want.append((a, b))
        new = len(number)
        number.append(min(number[a], number[b]))
        row = {k: (own[a][k] + own[b][k] - own[a][b] + 1) // 2 for k in own if k not in (a, b)}
        for k in (a, b):
            del own[k]
        for k, x in own.items():
            x.pop(a), x.pop(b)
            x[new] = row[k]
        own[new] = row
    assert [j[:2] for j in joins] == want and sorted(last) == sorted(own)
    assert left == pytest.approx(next(iter(own[last[0]].values())) / bounded_joining.UNIT)
    if spread:
        assert searched < all_cells / 2
