import numpy as np
import pytest

from strandmill.llm import topk


def brute_force(c, ids, q, own, k):
    """(id, score) of the k best by whole numbers, clamped to a long."""
    whole = [max(-topk_most, min(topk_most, sum(int(u) * int(v) for u, v in zip(q, row)))) for row in c.tolist()]
    order = sorted((n for n in range(len(c)) if n != own), key=lambda n: (-whole[n], ids[n]))[:k]
    return [(int(ids[n]), whole[n]) for n in order]


topk_most = 2**63 - 1


def searched(q, own, c, ids, k, chunk):
    """What a task finds of candidates that come in chunks, and how many sums reached the last block; query i is candidate ``own[i]``, or none."""
    rows = np.array([o if o >= 0 else 10_000 + i for i, o in enumerate(own)])
    block = topk.Queries(rows, np.zeros(len(rows), int), q, k)
    reached = sum(block.meet(np.arange(len(c))[s : s + chunk], ids[s : s + chunk], c[s : s + chunk]) for s in range(0, len(c), chunk))
    who, scores, found, _ = block.best.held
    return [[(int(a), int(b)) for a, b in zip(found[who == i], scores[who == i])] for i in range(len(q))], reached


@pytest.mark.parametrize("chunk", [400, 90])
@pytest.mark.parametrize("spread", [1, 30, 3000, 2**30, 2**45])
@pytest.mark.parametrize("dims", [0, 1, 7, 8, 33])
def test_a_task_is_exact(spread, dims, chunk):
    rng = np.random.default_rng(spread % 1000 + dims)
    c = rng.integers(-spread, spread + 1, (400, dims)).astype(float)
    c[100:150] = c[50:100]  # ties
    ids = rng.permutation(400)
    own = np.array([*rng.permutation(400)[:25], *[-1] * 5])
    q = np.stack([c[o] if o >= 0 else rng.integers(-spread, spread + 1, dims).astype(float) for o in own]) if dims else np.zeros((30, 0))
    got, _ = searched(q, own, c, ids, 5, chunk)
    assert got == [brute_force(c, ids, q[i], own[i], 5) for i in range(30)]


def test_large_components_stay_exact():
    c = np.array([[2.0**40, 1], [2.0**20, 1], [1, 1]])
    got, _ = searched(np.array([[2.0**20, 3]]), [-1], c, np.array([5, 4, 3]), 2, 3)
    assert got == [[(5, 2**60 + 3), (4, 2**40 + 3)]]
    got, _ = searched(np.array([[2.0**40]]), [-1], np.array([[2.0**40], [-(2.0**41)], [2.0**50]]), np.array([1, 2, 0]), 3, 3)
    assert got == [[(0, 2**63 - 1), (1, 2**63 - 1), (2, 1 - 2**63)]]


@pytest.mark.parametrize("top", [1e80, 1e200])
def test_scores_that_no_double_or_long_holds(top):
    rng = np.random.default_rng(7)
    c = rng.choice([0.0, 1.0, -1.0, top, -top, 2.0**31, 2.0**32], (300, 9))
    ids = rng.permutation(300)
    got, _ = searched(c[:20], np.arange(20), c, ids, 4, 70)
    assert got == [brute_force(c, ids, c[i], i, 4) for i in range(20)]


def test_bounds_leave_candidates_out():
    """Where lengths and directions differ, few sums are carried to the last block, and fewer as the task's own floor rises."""
    rng = np.random.default_rng(3)
    c = np.floor(rng.standard_normal((4000, 64)) * np.exp(-np.arange(64) / 6) * 256)
    got, reached = searched(c[:40], np.arange(40), c, np.arange(4000), 5, 500)
    assert got == [brute_force(c, np.arange(4000), c[i], i, 5) for i in range(40)]
    assert reached < 40 * 4000 / 20


def test_components_beyond_a_long(spark):
    rows = [(0, [1.0, 2.0]), (1, [1e30, 0.0]), (2, [1e17, 1.0]), (3, [-1e300, 5.0])]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()]
    assert [r[2] for r in got] == [1, 2, 3] and got[0][3] == 2**63 - 1 and got[2][3] == 1 - 2**63


def test_many_blocks_agree_with_one(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(k, rng.standard_normal(12 if k % 3 else 5).tolist()) for k in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    one = sorted(map(tuple, topk.top_k(df, every=10).collect()))
    for name, value in (("QUERY_BYTES", 1500), ("CHUNK", 70), ("TILE", 3)):
        monkeypatch.setattr(topk, name, value)
    assert sorted(map(tuple, topk.top_k(df, every=10).collect())) == one and len(one) == 60 * 5


def test_only_the_best_are_shuffled(spark):
    """Candidates stay where they lie once they are dealt: no exchange between their scan and the search."""
    rows = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(100)], "vec_id long, embedding array<double>").repartition(spark.sparkContext.defaultParallelism)
    plan = topk.top_k(rows)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow") :]
    assert "Exchange" not in below and "Join" not in plan
