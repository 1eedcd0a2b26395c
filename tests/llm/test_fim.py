"""Fill-in-the-middle against plain Python strings."""

import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandmill.llm import fim
from strandmill.llm.queries import QUERIES

TEXTS = [
    "", None, "a", "ab", "x" * 63, "x" * 64, "x" * 65, "y" * 128, "é日本😀\x00\r\n  é" * 40, "has <P> in it", "has <S>", "<M>", "<p> P> <P <S <<M", "\n\n\n", "wort " * 30_000, "<", "<P", "ends with <",
]


def plain(doc_id, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, z = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(t), "plain", None, None, t
    if h4 % 100 < 20:
        return len(t), "spm", a, z - a, f"<S>{t[z:]}<P>{t[:a]}<M>{t[a:z]}"
    return len(t), "psm", a, z - a, f"<P>{t[:a]}<S>{t[z:]}<M>{t[a:z]}"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(17 * k + i, t) for k in range(20) for i, t in enumerate(TEXTS)] + [(None, "no id " * 30), (None, None), (5, "abc"), (5, "abc")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("n", "form", "output", "h", "b", "a", "z", "batch")})


def test_every_row_against_strings(docs):
    got = fim.fill_in_middle(docs).collect()
    want = sorted(((r["doc_id"], *plain(r["doc_id"], r["text"]), r["text"] or "") for r in docs.collect()), key=str)
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"]) for r in got), key=str) == want
    for r in got:
        assert r["output_sha256"] == hashlib.sha256(r["output"].encode()).hexdigest() and r["restored_sha256"] == hashlib.sha256(r["restored"].encode()).hexdigest()
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_short_stretches_change_nothing(docs, monkeypatch):
    want = sorted(map(str, fim.fill_in_middle(docs).collect()))
    monkeypatch.setattr(fim, "STRETCH", 50)
    assert sorted(map(str, fim.fill_in_middle(docs).collect())) == want


def test_stretches_are_bounded():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["x" * 10, None, "y" * 500, "", "z" * 30, "é" * 20])], ["doc_id", "text"])
    parts = list(fim.stretches(batch, 70))
    assert [p.num_rows for p in parts] == [2, 1, 2, 1] and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert list(fim.stretches(batch.slice(0, 0), 70)) == []


def test_empty_table_and_other_ids(spark, docs):
    assert fim.fill_in_middle(docs.limit(0)).count() == 0
    named = fim.fill_in_middle(spark.createDataFrame([("a", "some text of its own")], "doc_id string, text string")).collect()
    assert [(r["doc_id"], *r[1:6]) for r in named] == [("a", *plain("a", "some text of its own"))]


def test_query_gives_digests_of_the_operators_texts(spark, sf_dir):
    got = {r["doc_id"]: r for r in QUERIES["op12_fim"](spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        n, form, prefix, middle, output = plain(r["doc_id"], r["text"])
        d = got[r["doc_id"]]
        assert (d["n"], d["form"], d["prefix_chars"], d["middle_chars"], d["output_sha256"]) == (n, form, prefix, middle, hashlib.sha256(output.encode()).hexdigest())
        assert d["restored_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
