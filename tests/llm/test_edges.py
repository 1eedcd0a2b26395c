"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from strandmill.llm import html_wrapper, langid, line_dedup, media, minhash, mixing, packing, quality, topk, url_filter
from strandmill.llm.queries import tokenizer_files

LONG = "ein sehr langer Text über vieles, und noch mehr. " * 60_000  # 3 MB
CLASH = ["size", "target", "score", "predicted", "lang_pred", "rejected", "n_lines", "n_removed", "key", "salt", "n", "queue", "part", "rep", "component", "component_id", "kept", "_id", "line", "h", "bucket", "rank", "position", "ids", "host", "order", "path", "verdict", "plan", "row", "held_out"]

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog.\nOne more line here.", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, "b"),
    (None, "a text without an id, long enough to count", "en", None),
    (5, " \t\n ", "de", None),
    (6, LONG, "de", "b"),
    (7, "Der schnelle braune Fuchs springt über den faulen Hund.", "de", "b"),
    (7, "Der schnelle braune Fuchs springt über den faulen Hund.", "de", "b"),
    (8, "12345 !!! ???", "en", "c"),
    (9, "word " * 5000, "en", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (1, 1), (7, 0), (9, 0), (9, 1), (None, 1), (6, None), (6, 1)], "doc_id long, quality int")


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, None, None), (2, "no scheme", ""), (3, "https://A.example.COM/en/7?x#y", "<p>hi"), (3, "https://A.example.COM/en/7?x#y", "<p>hi"), (None, "ftp:///en/1", "<article>" + "<p>x y</p>" * 50_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in CLASH})


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_quality(docs, labels):
    model = quality.fit(docs, labels)
    got = rows_of(quality.score_quality(docs, model, ["doc_id", "source"]))
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert quality.score_quality(docs, model).columns.count("score") == 1
    assert quality.score_quality(docs.limit(0), quality.fit(docs.limit(0), labels.limit(0))).count() == 0
    untaught = rows_of(quality.score_quality(docs, quality.fit(docs, labels.limit(0)), ["doc_id"]))
    assert {(r["score"], r["predicted"]) for r in untaught} == {(0.5, 1)}


def test_langid(docs):
    model = langid.fit(docs, F.lit(True))
    got = {(r["doc_id"], r["lang"]): r for r in rows_of(langid.identify(docs.drop("score"), model, ["doc_id", "lang"]))}
    assert got[7, "de"]["lang_pred"] == "de" and got[1, "en"]["lang_pred"] == "en"
    assert {k for k, r in got.items() if r["lang_pred"] == "und"} == {(2, "en"), (3, None), (5, "de"), (8, "en")}
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[2, "en"]["score"] == 0
    assert langid.identify(docs.limit(0), langid.fit(docs.limit(0), F.lit(True))).count() == 0
    assert {r["lang_pred"] for r in rows_of(langid.identify(docs, langid.fit(docs, F.lit(False))))} == {"und"}


def test_mixing(docs):
    got = rows_of(mixing.mix(docs))
    assert len(got) == len(ROWS) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert {r["doc_id"] for r in got if r["size"] == 0} == {2, 3, 5}
    assert mixing.mix(docs.limit(0)).count() == 0
    blank = mixing.mix(docs.where("doc_id in (2, 3, 5)"))
    assert {(r["target"], r["taken"], len(r["positions"])) for r in rows_of(blank)} == {(0, 0, 0)}
    copies = mixing.mix_documents(docs)
    assert copies.columns == docs.columns and copies.where("doc_id = 3").count() == 1
    assert mixing.mix_documents(docs.limit(0)).count() == 0


def test_line_dedup(docs, spark):
    got = rows_of(line_dedup.dedup_lines(docs, 2))
    assert len(got) == len(ROWS) and {r["n_removed"] for r in got} == {0}
    assert [r["text"] for r in got if r["doc_id"] == 2] == [None]
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
    rows = [(k, f"own {k}\n  menu line \n\nmenu line", f"s{k}") for k in range(20)] + [(3, "own 3\n  menu line \n\nmenu line", "s3"), (None, "menu line", None)]
    out = rows_of(line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), 16))
    assert [r["text"] for r in out if r["doc_id"] == 0] == ["own 0\n  menu line \n"]
    assert [(r["text"], r["n_lines"], r["n_removed"]) for r in out if r["doc_id"] == 3] == [("own 3\n", 4, 2)] * 2
    assert [r["text"] for r in out if r["doc_id"] is None] == [""]


def test_media(docs):
    got = rows_of(media.store_and_describe(docs))
    assert sorted((r["doc_id"] or -1, r["n_bytes"]) for r in got) == sorted((i or -1, len((t or "").encode())) for i, t, *_ in ROWS)
    same = [r for r in got if r["doc_id"] == 7]
    assert same[0] == same[1]
    assert media.store_and_describe(docs.limit(0)).count() == 0


def test_packing(docs):
    got = rows_of(packing.pack(docs, **tokenizer_files()))
    assert {r["doc_tokens"] for r in got if r["doc_id"] in (2, 3)} == {1}
    spans = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    at = {}
    for s, o, n in spans:
        assert at.get(s, 0) == o and o + n <= 2048
        at[s] = o + n
    assert sorted(at) == list(range(len(at))) and all(v == 2048 for k, v in at.items() if k < len(at) - 1)
    assert packing.pack(docs.limit(0), **tokenizer_files()).count() == 0


def test_minhash(docs):
    got = rows_of(minhash.near_duplicates(docs))
    assert len(got) == len(ROWS)
    assert {r["doc_id"] for r in got if r["n_shingles"] == 0} == {2, 3, 5}
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] == 7] == [(7, True)] * 2
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)]
    assert [r["n_shingles"] for r in got if r["doc_id"] in (8, 9)] == [1, 1]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    assert minhash.drop_near_duplicates(docs).columns == docs.columns and minhash.drop_near_duplicates(docs).count() == len(ROWS)


def test_url_filter(pages):
    got = sorted(((r["page_id"] or 9, r["host"], r["path"], r["rule"], r["verdict"], r["via"]) for r in rows_of(url_filter.filter_urls(pages))))
    hit = (3, "a.example.com", "/en/7", "example.com/en/7", "allow", "rule")
    assert got == [(1, "", "", None, "allow", "default"), (2, "", "", None, "allow", "default"), hit, hit, (9, "", "/en/1", None, "allow", "default")]
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_html(pages):
    got = rows_of(html_wrapper.extract_pages(pages))
    assert len(got) == 5 and sorted(r["n_chars"] for r in got) == [0, 0, 2, 2, 4 * 50_000 - 1]
    assert html_wrapper.extract_pages(pages.limit(0)).count() == 0


def test_topk(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (50, [0.5, 0.5]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (4, None), (5, [None, 1.0]), (100, [nan, 1.0]), (6, [inf, 1.0]), (None, [9.0, 9.0]), (150, [1.0]), (200, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in CLASH})
    got = sorted(tuple(r) for r in topk.top_k(df, k=3).collect())
    full = 256 * 256
    assert got == sorted([(0, 1, 0, full), (0, 2, 2, full), (0, 3, 3, full)] * 2 + [(50, 1, 0, full // 2), (50, 2, 0, full // 2), (50, 3, 2, full // 2)])
    assert topk.top_k(df.limit(0)).count() == 0
