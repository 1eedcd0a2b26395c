import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strandmill.llm import packing
from strandmill.llm.queries import QUERIES, tokenizer_files


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(tokenizer_files()["tokenizer_path"])


@pytest.fixture(scope="module")
def words():
    return packing.WordTokenizer(*tokenizer_files().values())


def of(words, text):
    return np.frombuffer(words(text), words.dtype).tolist()


PIECES = [*"ab Z9'.,!é\n\t\r\u00a0\u3000\x1c\x85ñßǅʹ中😀\u0301<|>", " ", " ", "<|endoftext|>", "word", "  "]


@settings(max_examples=500, deadline=None)
@given(text=st.lists(st.sampled_from(PIECES), max_size=25).map("".join))
def test_ids_are_those_of_the_tokenizer(plain, words, text):
    assert of(words, text) == plain.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=60))
def test_ids_of_any_text(plain, words, text):
    text = text.encode("utf-8", "replace").decode()
    assert of(words, text) == plain.encode(text, add_special_tokens=False).ids


@settings(max_examples=80, deadline=None)
@given(texts=st.lists(st.none() | st.lists(st.sampled_from(PIECES), max_size=30).map("".join), max_size=12), piece=st.sampled_from([5, 40, 1000]))
def test_blocks_of_documents(plain, words, texts, piece):
    """Documents of a block, and long ones cut into pieces, have the ids that each has alone."""
    had, packing.PIECE = packing.PIECE, piece
    try:
        got = []
        for row, end, ids, sizes in words.documents(pa.array(texts, pa.string())):
            assert end - row == len(sizes) and len(ids) == sum(sizes)
            got += [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
        assert got == [plain.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    finally:
        packing.PIECE = had


def test_the_cache_starts_anew(plain, monkeypatch):
    monkeypatch.setattr(packing, "MOST_CACHED", 10)
    words, rng = packing.WordTokenizer(*tokenizer_files().values()), random.Random(1)
    for _ in range(20):
        text = " ".join(f"w{rng.randrange(50)}" for _ in range(30))
        assert of(words, text) == plain.encode(text, add_special_tokens=False).ids
    assert len(words.parts) <= 60


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3000), min_size=1, max_size=6), st.integers(50, 700), st.booleans())
def test_rounds_serve_each_token_once(totals, window, even):
    rounds = packing.Rounds(totals, [1.0] * len(totals) if even else None, window)
    taken = set()
    for source, total in enumerate(totals):
        first = 0
        while first < total:
            n = min(97, total - first)
            pieces = list(rounds.pieces(source, first, n, 64))
            assert sum(p[1] for p in pieces) == n
            for _, size, sequence, offset, _ in pieces:
                assert offset + size <= 64
                span = set(range(sequence * 64 + offset, sequence * 64 + offset + size))
                assert not span & taken
                taken |= span
            first += n
    assert taken == set(range(sum(totals)))


def test_windows_keep_the_shares():
    totals = [500_000, 30_000, 3_000, 70]
    rounds = packing.Rounds(totals, window=10_000)
    for w in range(rounds.windows + 1):
        served = rounds.served(w)[0]
        assert all(abs(s - t * min(1, w * 10_000 / sum(totals))) <= 1 for s, t in zip(served, totals))  # a deficit is under one token


def test_given_shares_hold_until_a_queue_is_dry():
    rounds = packing.Rounds([1000, 5000, 0], [1.0, 1.0, 0.0], 200)
    assert rounds.served(5)[0].tolist() == [500, 500, 0] and rounds.served(15)[0].tolist() == [1000, 2000, 0]
    with pytest.raises(ValueError):
        packing.Rounds([10, 5], [1.0, 0.0])


def test_stretches_are_followed():
    """Window by window, what is served is what the input has in that stretch of its order."""
    stretches = np.array([[900, 100], [0, 1000], [500, 500]])
    rounds = packing.Rounds([1400, 1600], None, 100, stretches)
    served = np.array([rounds.served(w)[0] for w in range(31)])
    assert served[10].tolist() == [900, 100] and served[20].tolist() == [900, 1100] and served[30].tolist() == [1400, 1600]
    assert (abs(np.diff(served, axis=0)[:10] - [90, 10]) <= 1).all()
    taken = set()
    for source, total in enumerate([1400, 1600]):
        for start, size, sequence, offset, _ in rounds.pieces(source, 0, total, 64):
            taken |= set(range(sequence * 64 + offset, sequence * 64 + offset + size))
    assert taken == set(range(3000))


def documents(spark, rows, parts=5):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)


def assert_packed(got, rows, plain):
    """Every id lies in exactly one piece, and sequences are full but for the last."""
    by_doc, spans = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc_id, text, _ in rows:
        ids, at = np.array(plain.encode(text or "", add_special_tokens=False).ids + [1], "<u4"), 0
        for r in sorted(by_doc[doc_id], key=lambda r: r["start"]):
            part = ids[at : at + r["length"]].tobytes()
            assert (r["start"], r["doc_tokens"], r["ids_crc32"], bytes(r["ids"])) == (at, len(ids), zlib.crc32(part), part)
            at += r["length"]
        assert at == len(ids)
    assert sorted(spans) == list(range(len(spans)))
    for s, found in spans.items():
        at = 0
        for offset, size in sorted(found):
            assert offset == at
            at += size
        assert at == 2048 or s == len(spans) - 1


def corpus(seed, sources):
    rng = random.Random(seed)
    return [(k, " ".join(f"tok{rng.randrange(999)}" for _ in range(rng.choice([0, 3, 50, 4000]))) + rng.choice(["", " <|endoftext|> x", "\n"]), rng.choice(sources)) for k in range(120)]


@pytest.mark.parametrize("how", [{}, {"window": 4096}, {"weights": (3.0, 1.0, 2.0)}, {"shares": {"a": 1.0, "b": 5.0, None: 2.0}}, {"follow": True}])
def test_pieces_hold_the_documents(spark, plain, how):
    rows = corpus(2, ["a", "a", "a", "b", None])
    assert_packed(packing.pack(documents(spark, rows), **tokenizer_files(), **how).collect(), rows, plain)


def test_windows_have_the_given_proportions(spark):
    rows = [(k, "word " * 3000, "abc"[k % 3]) for k in range(60)]
    got = packing.pack(documents(spark, rows), **tokenizer_files(), weights=(3.0, 1.0, 2.0)).collect()
    source = {k: s for k, _, s in rows}
    for window in range(5):
        held = Counter()
        for r in got:
            if r["window"] == window:
                held[source[r["doc_id"]]] += r["length"]
        total = sum(held.values())
        assert all(abs(held[s] / total - w / 6) < 0.01 for s, w in zip("abc", (3, 1, 2)))
    with pytest.raises(ValueError):
        packing.pack(documents(spark, rows), **tokenizer_files(), shares={"a": 1.0})


def test_more_sources_than_queues(spark, plain, monkeypatch):
    monkeypatch.setattr(packing, "MOST_SOURCES", 4)
    monkeypatch.setattr(packing, "FOLDED", 3)
    rows = corpus(5, [f"s{k}" for k in range(20)] + [None])
    for how in ({}, {"weights": (2.0, 1.0)}, {"follow": True}):
        assert_packed(packing.pack(documents(spark, rows), **tokenizer_files(), **how).collect(), rows, plain)


def test_files_are_packed_in_the_order_they_were_written(spark, tmp_path):
    """Files of unlike sizes, which Spark reads largest first: each source's documents follow each other as written."""
    rows = [(k, "w " * (3000 if k in (40, 41) else 5 + k % 30), "ab"[k % 2]) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df.repartitionByRange(7, "doc_id").sortWithinPartitions("doc_id").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    assert docs.rdd.getNumPartitions() > 1 or [r["doc_id"] for r in docs.collect()] != list(range(60))
    for how in ({}, {"follow": True}):
        got = packing.pack(docs, **tokenizer_files(), **how).collect()
        for source in (0, 1):
            mine = sorted((r["sequence_id"], r["offset"], r["doc_id"]) for r in got if r["doc_id"] % 2 == source)
            order = list(dict.fromkeys(d for _, _, d in mine))
            assert order == sorted(order)


@pytest.mark.parametrize("sources", [20, 1000])
def test_documents_are_not_cut_into_slivers(spark, sources):
    """Pieces stay long, and every window keeps its shares, however many sources there are."""
    rows = [(k, " ".join(f"tok{(k * 7 + i) % 999}" for i in range(500)), f"s{k % sources:04d}") for k in range(2000)]
    got = packing.pack(documents(spark, rows), **tokenizer_files(), weights=(3.0, 1.0, 2.0)).drop("ids").collect()
    tokens = sum(r["length"] for r in got)
    assert tokens / len(got) > 300 and len(got) < 4 * len(rows)
    share = {f"s{k:04d}": (3.0, 1.0, 2.0)[k % 3] for k in range(sources)}
    source = {k: s for k, _, s in rows}
    held = Counter()
    for r in got:
        if r["window"] == 0:
            held[source[r["doc_id"]]] += r["length"]
    whole, total = sum(held.values()), sum(share.values())
    assert all(abs(held[s] - whole * v / total) <= 1.5 for s, v in share.items())


def test_query_against_a_plain_packer(spark, plain, sf_dir):
    """The registered query's pieces hold every document, and windows hold the proportions 3, 1, 2 by source until a queue is dry."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = QUERIES["op7_packing"](spark, sf_dir).collect()
    by_doc, spans = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    held, totals, source = defaultdict(Counter), Counter(), {}
    for d in docs:
        ids, at = np.array(plain.encode(d["text"] or "", add_special_tokens=False).ids + [1], "<u4"), 0
        source[d["doc_id"]] = d["source"]
        totals[d["source"]] += len(ids)
        for r in sorted(by_doc[d["doc_id"]], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids[at : at + r["length"]].tobytes()))
            at += r["length"]
            held[r["window"]][d["source"]] += r["length"]
        assert at == len(ids)
    for s, found in spans.items():
        ends = np.cumsum([0, *(n for _, n in sorted(found))])
        assert [o for o, _ in sorted(found)] == ends[:-1].tolist() and (ends[-1] == 2048 or s == len(spans) - 1)
    # Deficit round-robin token by token: every round gives each source that is not dry its weight.
    names = sorted(totals, key=lambda s: (s is None, s))
    weight, left = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(names)}, dict(totals)
    for w in sorted(held)[:-1]:
        room, want = sum(held[w].values()), Counter()
        while room > 1e-9:
            live = [s for s in names if left[s] > 1e-9]
            step = min(room / sum(weight[s] for s in live), min(left[s] / weight[s] for s in live))
            for s in live:
                want[s] += step * weight[s]
                left[s] -= step * weight[s]
                room -= step * weight[s]
        assert all(abs(held[w][s] - want[s]) <= 2 for s in names)


def test_a_task_holds_little_at_a_time(words):
    """What a block of documents takes while it is tokenised is bounded, however long the column is."""
    rng = random.Random(3)
    column = pa.array([" ".join(f"w{rng.randrange(500)}" for _ in range(3000)) for _ in range(600)])
    for _ in words.documents(column.slice(0, 10)):
        pass
    tracemalloc.start()
    try:
        assert sum(end - row for row, end, _, _ in words.documents(column)) == 600
        assert tracemalloc.get_traced_memory()[1] < 30e6
    finally:
        tracemalloc.stop()
