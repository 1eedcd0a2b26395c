import random
import re

import numpy as np
import pyarrow as pa
import pytest

from strandmill.llm import common, minhash, shingles
from strandmill.llm.components import connected_components
from strandmill.llm.queries import QUERIES
from strandmill.session import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_force(rows):
    """{doc_id: (size, component)} from all pairs."""
    sets, parent = {k: shingle_set(t) for k, t in rows}, {k: k for k, _ in rows}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: (len(sets[k]), find(k)) for k in ids}


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return words


def corpus(seed):
    """Near copies at every distance around the threshold, chains, copies, shared passages, short texts."""
    rng = random.Random(seed)
    texts = []
    for size in (30, 60, 120, 300):
        base = [f"b{rng.randrange(10**6)}" for _ in range(size)]
        texts += [edited(rng, base, k) for k in range(0, size // 20 + 4) for _ in range(4)]
        chain = base
        for _ in range(10):
            chain = edited(rng, chain, max(1, size // 40))
            texts.append(chain)
        passage = base[: size // 2]
        texts += [passage + [f"p{rng.randrange(10**6)}" for _ in range(size // 3)] for _ in range(10)]
    texts += [["one"], ["One"], ["one", "two"], [], ["a", "b", "c", "d", "e"], ["A", "b", "c", "d", "e", "f"]]
    rng.shuffle(texts)
    return [(k * 3 + 1, "\t".join(t) if k % 7 else "  " + "\n".join(t).upper().lower() + " ") for k, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_those_of_all_pairs(spark, seed):
    rows = corpus(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_force(rows)


def test_blocks_of_a_large_key(spark, monkeypatch):
    """Keys cut into several blocks lose no pair."""
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "SET_BLOCK", 400)
    rows = corpus(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_force(rows)


def test_a_large_component_and_others_share_keys(spark, monkeypatch):
    """A key of one large component and few classes beside it: blocks of the component meet the others only."""
    monkeypatch.setattr(minhash, "BLOCK", 6)
    monkeypatch.setattr(minhash, "SET_BLOCK", 3000)
    monkeypatch.setattr(minhash, "PIVOT", 5)
    rng = random.Random(6)
    base = [f"b{k}" for k in range(120)]
    texts = [edited(rng, base, k % 4) for k in range(60)] + [edited(rng, base, 5 + k % 4) for k in range(25)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_force(rows) and len({c for _, c in got.values()}) > 3


def test_joins_beyond_what_is_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HUB", 3)
    rows = corpus(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_force(rows)


@pytest.mark.parametrize("keys", [0, 10**9])
def test_ids_of_texts_are_not_broadcast_as_a_join(spark, monkeypatch, keys):
    """Ids that fit go to the tasks as an array, without a hashed table on the driver; keys beyond KEYS meet their rows by key."""
    joined = []
    real = common.lookup_join
    for module in (common, minhash):
        monkeypatch.setattr(module, "lookup_join", lambda big, small, key, *more, **named: joined.append(key) or real(big, small, key, *more, **named))
    monkeypatch.setattr(minhash, "KEYS", keys)
    rows = corpus(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_force(rows) and "key" in joined and "doc_id" not in joined


@pytest.mark.parametrize("most", [0, 200_000])
def test_rows_of_ids(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    texts = spark.createDataFrame([(1, "a"), (2, None), (0, "zero"), (None, "c"), (5, "é"), (5, "again"), (-7, "d")], "doc_id long, text string")
    for ids, want in (([5, -7, 9], {(5, "é"), (5, "again"), (-7, "d")}), ([2], {(2, None)}), ([], set()), ([0], {(0, "zero")})):
        got = common.of_ids(texts, common.spool(spark.createDataFrame([(x,) for x in ids], "doc_id long"), "ids")).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_query_against_all_pairs(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in QUERIES["op8_minhash"](spark, sf_dir).collect()}
    assert got == {k: (n, c, k == c) for k, (n, c) in brute_force(rows).items()}


def test_pigeonhole():
    """Any two signatures within DISTANCE share a key."""
    keys, rng = minhash.chunk_keys(), np.random.default_rng(4)
    assert sorted({s for k in keys for s in k}) == list(range(shingles.SYMBOLS))
    for _ in range(2000):
        wrong = set(rng.choice(shingles.SYMBOLS, minhash.DISTANCE, replace=False).tolist())
        assert any(not wrong & set(k) for k in keys)
    with pytest.raises(ValueError):
        minhash.chunk_keys(chunks=11)


def test_sets_are_those_of_words():
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abc déf GHI jkl ñ".split()) for _ in range(rng.randrange(0, 40))) for _ in range(200)] + [None, "", "x" * 10, "\u00a0a b\x0bc"]
    got = [(r, end, np.diff(o)) for r, end, _, o in shingles.shingle_sets(pa.array(texts))]
    assert np.concatenate([x for _, _, x in got]).tolist() == [len(shingle_set(t)) for t in texts]


def test_long_rows_are_cut_at_white_space(monkeypatch):
    from strandmill.llm import words

    text = " ".join(f"w{k % 977}" + "é" * (k % 5) for k in range(3000)) + " " + "z" * 900
    whole = [(h, o) for _, _, h, o in shingles.shingle_sets(pa.array([text]))]
    monkeypatch.setattr(words, "BLOCK", 128)
    cut = [(h, o) for _, _, h, o in shingles.shingle_sets(pa.array([text]))]
    assert (whole[0][0] == cut[0][0]).all()


@pytest.mark.parametrize("hub", [20_000, 5])
def test_components_of_random_graphs(spark, monkeypatch, hub):
    monkeypatch.setattr(common, "HUB", hub)
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1100)] + [(5, 5), (None, 3)] + [(2000, k) for k in range(2001, 2300)]
    parent = {}

    def find(k):
        parent.setdefault(k, k)
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: find(k) for k in parent}
