"""Hard negatives against brute force over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.llm import hard_negatives as hn
from strandmill.llm.queries import QUERIES


def brute_force(rows, every=50, positives=5, negatives=3):
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from plain integers."""
    sound = [(i, [int(np.floor(256 * float(x))) for x in v], c) for i, v, c in rows if i is not None and v is not None and c is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, v, c) in enumerate(sound):
        if i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j, k, d == c) for k, (j, w, d) in enumerate(sound) if k != a and len(w) == len(v)]
        scored.sort(key=lambda t: t[:3])
        for s, j, _, _ in [t for t in scored if t[3]][:positives]:
            inside = [t for t in scored if not t[3] and 50 * -s <= 100 * -t[0] <= 95 * -s][:negatives]
            out += [(i, j, r + 1, t[1], -s, -t[0]) for r, t in enumerate(inside)]
    return sorted(out)


def made(n, dims, labels, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dims))
    rows = []
    for k in range(n):
        c = int(rng.integers(labels))
        v = centres[c] * rng.choice([0.0, 0.6]) + rng.normal(size=dims) * spread
        rows.append((k, (v / max(1e-9, np.linalg.norm(v))).tolist(), c))
    return rows


KIND = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("n, dims, labels", [(900, 16, 4), (400, 5, 40), (300, 2, 2), (300, 64, 3)])
def test_all_rows_against_brute_force(spark, n, dims, labels):
    rows = made(n, dims, labels, n)
    got = sorted(map(tuple, hn.mine(spark.createDataFrame(rows, KIND).repartition(5), every=10).collect()))
    assert got == brute_force(rows, 10) and len(got) > 10


def test_many_small_chunks_and_blocks(spark, monkeypatch):
    rows = made(600, 8, 3, 5)
    monkeypatch.setattr(hn, "CHUNK", 7)
    monkeypatch.setattr(hn, "ANCHORS", 13)
    got = sorted(map(tuple, hn.mine(spark.createDataFrame(rows, KIND).repartition(3), every=10).collect()))
    assert got == brute_force(rows, 10)


def test_copies_ties_and_repeated_ids(spark):
    base = made(60, 6, 2, 9)
    rows = base + [(1000 + k, base[0][1], k % 2) for k in range(200)] + [(0, base[0][1], 0), (0, base[0][1], 1), (50, base[3][1], 1), (50, base[3][1], 1)]
    got = sorted(map(tuple, hn.mine(spark.createDataFrame(rows, KIND).repartition(4)).collect()))
    want = brute_force(rows)
    assert [(a, b, c, e, f) for a, b, c, _, e, f in got] == [(a, b, c, e, f) for a, b, c, _, e, f in want] and got == want


def test_rows_that_take_no_part_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(4, None, 1), (5, [None, 1.0], 1), (100, [nan, 1.0], 1), (6, [inf, 1.0], 1), (None, [9.0, 9.0], 1), (150, [1.0, 0.5], None), (200, [1.0], 1), (201, [1.0], 1), (202, [0.75], 2), (250, [], 1), (251, [], 1), (252, [], 2), (300, [-1.0, -0.5], 1)]
    rows = made(80, 2, 2, 4) + odd
    df = spark.createDataFrame(rows, KIND).withColumns({c: F.lit("x") for c in ("row", "n", "q", "codes", "residual", "rank", "score", "block", "slot")})
    got = sorted(map(tuple, hn.mine(df).collect()))
    assert got == brute_force(rows)
    assert (200, 201, 1, 202, 65536, 49152) in got and (250, 251, 1, 252, 0, 0) in got
    assert hn.mine(df.limit(0)).count() == 0 and hn.mine(df.where("vec_id = 7")).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(0, [2.0**40, 1.0], 1), (1, [2.0**30, 3.0], 1), (2, [2.0**29 + 1, 3.0], 2), (3, [1e30, 0.0], 3), (4, [3.0, 2.0**20], 1), (5, [2.0, 2.0**19], 2)]
    got = sorted(map(tuple, hn.mine(spark.createDataFrame(rows, KIND)).collect()))
    want = [t for t in brute_force(rows) if t[4] < 2**63]
    assert [t for t in got if t[4] < hn.MOST] == want and want
    assert hn.exact(np.array([[2.0**60, 1.0], [-(2.0**62), 0.0]]), np.array([[2.0**10, 5.0], [2.0**9, 1.0]])).tolist() == [hn.MOST, -hn.MOST]


def test_bounds_hold_the_exact_score_and_skip_most():
    rng = np.random.default_rng(2)
    x = np.floor(256 * np.array([v for _, v, _ in made(4000, 64, 10, 3, 0.4)]))
    books = hn.fit(x[:2048])
    codes, residual = hn.encode(x, books)
    assert np.allclose(residual, [np.linalg.norm(v - np.concatenate([b[c] for b, c in zip(books, k)])) for v, k in zip(x, codes)])
    q = x[rng.integers(0, 4000, 30)]
    a = hn.Anchors(np.arange(10_000, 10_030), np.arange(30), np.zeros(30, int), q, books)
    lower, upper = a.bounds(slice(None), np.arange(4000), x, codes, residual)
    scores = x @ q.T
    assert (lower <= scores).all() and (scores <= upper).all()
    best = hn.Best(30, 5)
    labels = np.zeros(4000, int)
    tried = sum(hn.add_positives(a, best, *(t[s : s + 500] for t in (np.arange(4000), np.arange(4000), labels, x, codes, residual))) for s in range(0, 4000, 500))
    assert tried < 0.2 * 30 * 4000
    assert sorted(best.held[1].tolist()) == sorted(np.sort(scores, axis=0)[-5:].astype(int).ravel().tolist())


def test_windows_are_exact_in_integers():
    low, high = hn.windows(np.array([[100, 101, -7], [0, 3, hn.MOST]]))
    for s, a, b in zip((100, 101, -7, 0, 3, hn.MOST), low.ravel(), high.ravel()):
        inside = [n for n in {int(a) - 1, int(a), int(b), int(b) + 1} if 50 * s <= 100 * n <= 95 * s]
        assert all(a <= n <= b for n in inside) and (a > b or (50 * s <= 100 * int(a) and 100 * int(b) <= 95 * s))


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r[0], r[1], (r[2] + 1) % 10 if r[0] % 7 == 0 else r[2]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(map(tuple, QUERIES["op11_hard_negatives"](spark, sf_dir).collect())) == brute_force(rows)
