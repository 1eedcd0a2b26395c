import time

"""The bar from which a line counts as boilerplate, in numbers of its own: the SQL and the pipeline's test take the module's constant."""

from strandmill.llm import common, line_dedup


def test_a_line_on_three_of_a_few_sites_goes(spark):
    long = "a licence text of many words " * 20
    rows = [(k, f"own {k}\nAll rights reserved.\n{long.strip()}", f"site {k % 4}") for k in range(8)]
    rows += [(k, f"own {k}\ntold twice", f"site {k % 2}") for k in range(8, 14)]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0]["text"] == rows[0][1]
    assert all(got[k]["text"] == f"own {k}" and got[k]["n_removed"] == 2 for k in range(1, 8))
    assert all(got[k]["text"] == rows[k][1] for k in range(8, 14))


def test_three_sites_of_many(spark):
    rows = [(k, f"own {k}\n" + ("on three" if k % 20 < 3 else "on two" if k % 20 < 5 else f"alone {k}") + ("\neverywhere" if k % 2 else ""), f"site {k % 20}") for k in range(100)]
    got = {r["doc_id"]: r["text"].split("\n")[1:] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    left = [x for lines in got.values() for x in lines]
    assert left.count("on three") == 1 and left.count("everywhere") == 1 and left.count("on two") == 10


def test_very_common_lines_are_told_to_their_rows(spark, monkeypatch):
    rows = [(k, f"own {k}\ncommon\n{'often' if k % 3 else 'rare ' + str(k)}", f"site {k % 7}") for k in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(str, line_dedup.dedup_lines(df).collect()))
    monkeypatch.setattr(common, "HUB", 70)
    assert sorted(map(str, line_dedup.dedup_lines(df).collect())) == want and sum("'own 0\\ncommon" in x for x in want) <= 1
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted(map(str, line_dedup.dedup_lines(df).collect())) == want


def test_texts_of_which_many_lines_go(spark):
    """Forty thousand lines, half of them shared: taking them out takes time by the number of lines."""
    n = 40_000
    rows = [(k, "\n".join(f"own {k} {i}" if i % 2 else f"shared {i}" for i in range(n)), f"s{k}") for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(1)
    cleaned = line_dedup.dedup_lines(docs)
    begun = time.monotonic()
    got = {r["doc_id"]: r for r in cleaned.collect()}
    assert time.monotonic() - begun < 10
    assert got[0]["text"] == rows[0][1] and [got[k]["n_removed"] for k in range(4)] == [0] + [n // 2] * 3
    assert got[2]["text"] == "\n".join(f"own 2 {i}" for i in range(1, n, 2))
