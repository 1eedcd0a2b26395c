import math
import random
import re

import pytest

from strandmill.operators import distance
from strandmill.operators.signature import SET, VECTOR, signature, sizes

CORES = "genome_idx int, label long, len int"


def sig_of(spark, genomes):
    rows = [(g, label, n) for g, found in genomes.items() for label, n in found]
    return signature(spark.createDataFrame(rows, CORES))


def test_band_counts_all_copies_and_includes_both_ends(spark):
    cores = spark.createDataFrame([(0, 1, 3)] * 2 + [(0, 2, 3)] * 3 + [(0, 3, 3)] * 4, CORES)
    assert {r["label"] for r in signature(cores, band=(2, 3)).collect()} == {1, 2}
    bands = spark.createDataFrame([(0, 4, None)], "genome_idx int, min_cc long, max_cc long")
    assert {r["label"] for r in signature(cores, bands=bands).collect()} == {3}
    with pytest.raises(ValueError):
        signature(cores, band=(5, 2))


def test_the_largest_core_counts(spark):
    """A genome with one distinct core has a signature of one."""
    row = sizes(sig_of(spark, {0: [(9, 4)] * 3}), SET).first()
    assert (row["n"], row["total_len"]) == (1, 4)
    row = sizes(sig_of(spark, {0: [(9, 4)] * 3}), VECTOR).first()
    assert (row["n"], row["total_len"]) == (3, 12)


@pytest.mark.parametrize("mode", [SET, VECTOR])
def test_identical_disjoint_and_empty(spark, mode):
    sig = sig_of(spark, {0: [(1, 3), (2, 4)], 1: [(1, 3), (2, 4)], 2: [(7, 3)]})
    genomes = spark.createDataFrame([(k,) for k in range(5)], "genome_idx int")
    got = {(r["i"], r["j"]): r for r in distance.distances(sig, mode=mode, genomes=genomes).collect()}
    assert len(got) == 10
    same, apart, none = got[0, 1], got[0, 2], got[3, 4]
    assert (same["dice"], same["jaccard"], same["jc"]) == (0, 0, 0) and math.copysign(1, same["jc"]) == 1
    assert (apart["inter"], apart["dice"], apart["jaccard"], apart["jc"]) == (0, 1, 1, None)
    assert (none["dice"], none["jaccard"], none["jc"]) == (None, None, None)


def test_vector_mode_adds_up(spark):
    sig = sig_of(spark, {0: [(1, 3)] * 5 + [(2, 3)], 1: [(1, 3)] * 2 + [(3, 3)] * 2})
    row = distance.distances(sig, mode=VECTOR).first()
    assert (row["inter"], row["uni"]) == (2, 8) and row["inter"] + row["uni"] == 6 + 4
    j, h = 2 / 8, 1 - (2 / 8) ** (1 / 3)
    assert row["jaccard"] == pytest.approx(1 - j) and row["dice"] == pytest.approx(1 - 4 / 10)
    assert row["jc"] == pytest.approx(-0.75 * math.log(1 - h * 4 / 3))


def test_square_and_nearest(spark):
    sig = sig_of(spark, {0: [(1, 3), (2, 3)], 1: [(1, 3)], 2: [(2, 3), (5, 3)]})
    dist = distance.distances(sig)
    square = {(r["i"], r["j"]): r["dice"] for r in distance.square(dist, sig.select("genome_idx").distinct()).collect()}
    assert len(square) == 9 and all(square[k, k] == 0 for k in range(3)) and all(square[a, b] == square[b, a] for a, b in square)
    assert {(r["i"], r["j"]) for r in distance.nearest(dist, 1).collect()} == {(0, 1), (1, 0), (2, 0)}


def test_modes_are_checked(spark):
    with pytest.raises(ValueError):
        distance.distances(sig_of(spark, {0: [(1, 3)]}), mode="bag")


def test_many_genomes_are_paired_in_blocks(spark, monkeypatch):
    """A core that more genomes have than a block holds, and a matrix of several blocks, lose no pair."""
    rows = [(g, c, 1 + (g * c) % 3) for g in range(40) for c in range(12) if c < 2 or (g * 7 + c) % 5 < 2]
    sig = spark.createDataFrame(rows, "genome_idx int, item int, cnt long")
    want = {m: sorted(map(tuple, distance.distances(sig, ("item",), mode=m, length=None).collect())) for m in ("set", "vec")}
    assert len(want["set"]) == 40 * 39 // 2
    monkeypatch.setattr(distance, "BLOCK", 7)
    for mode, rows in want.items():
        assert sorted(map(tuple, distance.distances(sig, ("item",), mode=mode, length=None).collect())) == rows


def some_items(spark):
    """Thirty genomes over items of which one is everywhere, and two genomes with items of their own."""
    rng = random.Random(8)
    rows = {(g, x) for g in range(30) for x in [1000, *(rng.randrange(60) for _ in range(8 if g else 1))]} | {(40, 2000), (41, 3000)}
    return spark.createDataFrame([(g, x, rng.randrange(1, 5)) for g, x in sorted(rows)] + [(0, None, 1), (1, None, 1)], "genome_idx int, item int, cnt int")


@pytest.mark.parametrize("k, by", [(1, "jaccard"), (3, "dice"), (31, "jaccard")])
def test_nearest_needs_only_pairs_that_share(spark, monkeypatch, k, by):
    sig = some_items(spark)
    want = sorted(map(tuple, distance.nearest(distance.distances(sig, ("item",), length=None), k, by).collect()))
    assert sorted(map(tuple, distance.nearest_of(sig, k, ("item",), by=by).collect())) == want
    monkeypatch.setattr(distance, "BLOCK", 7)
    monkeypatch.setattr(distance, "all_pairs", None)  # the matrix is not made
    assert sorted(map(tuple, distance.nearest_of(sig, k, ("item",), by=by).collect())) == want


@pytest.mark.parametrize("mode", ["set", "vec"])
def test_rows_of_a_matrix_are_not_shuffled(spark, monkeypatch, mode):
    """Every exchange of the plan lies under the pairs' union; pairs that left their task filled the disk."""
    sig = some_items(spark)
    want = sorted(map(str, distance.distances(sig, ("item",), mode=mode, length=None).collect()))
    monkeypatch.setattr(distance, "BLOCK", 7)
    dist = distance.distances(sig, ("item",), mode=mode, length=None)
    plan = dist._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].splitlines()
    names = [re.sub(r"^[\s:+*\-()0-9]*", "", x).split(" ")[0] for x in plan if x.strip()]
    at = names.index("BroadcastNestedLoopJoin")
    assert "Union" in names[:at] and not {"Exchange", "Sort"} & set(names[:at])
    assert sorted(map(str, dist.collect())) == want
