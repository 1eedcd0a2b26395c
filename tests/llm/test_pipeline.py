"""The pipeline's stages, each against a plain version on its own input."""

from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandmill.llm import line_dedup, mixing
from strandmill.llm.common import spool
from strandmill.session import table
from tests.llm.test_minhash import brute_force


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(spool(stage(spark, out[-1], sf_dir), name))
    return [df.collect() for df in out]


def ids(rows):
    return Counter(r["doc_id"] for r in rows)


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]
    for rows in stages[1:5]:
        assert list(rows[0].asDict()) == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_drops_rejected_and_keeps_good(spark, sf_dir, stages):
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf_dir, "labels").collect()}
    kept = ids(stages[1])
    good, bad = ([kept[k] for k, q in labels.items() if q == want] for want in (1, 0))
    assert sum(good) / len(good) > 0.97 and sum(bad) / max(1, len(bad)) < 0.2


def test_lines(stages):
    sites = defaultdict(set)
    for r in stages[1]:
        for line in r["text"].split("\n"):
            sites[line.strip(" \t\r\f\v")].add(r["source"])
    common = {x for x, s in sites.items() if x and len(s) >= line_dedup.MIN_SITES}
    first = {}
    for r in sorted(stages[1], key=lambda r: r["doc_id"]):
        for k, line in enumerate(r["text"].split("\n")):
            first.setdefault(line.strip(" \t\r\f\v"), (r["doc_id"], k))
    want = {}
    for r in stages[1]:
        lines = [(k, x, x.strip(" \t\r\f\v")) for k, x in enumerate(r["text"].split("\n"))]
        text = "\n".join(x for k, x, y in lines if y not in common or first[y] == (r["doc_id"], k))
        if text.strip() or text == r["text"]:
            want[r["doc_id"]] = text
    assert {r["doc_id"]: r["text"] for r in stages[2]} == want
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2])


def test_near_copies(stages):
    truth = brute_force([(r["doc_id"], r["text"]) for r in stages[2]])
    assert ids(stages[3]) == Counter(k for k, (_, component) in truth.items() if k == component)


def test_mixing_only_repeats_and_drops(stages):
    had, got = ids(stages[3]), ids(stages[4])
    assert set(got) <= set(had) and max(got.values()) <= 2
    words = lambda rows: sum(len(r["text"].split()) for r in rows)
    assert words(stages[4]) == pytest.approx(1.5 * words(stages[3]), rel=0.05)


def test_training_order_reaches_the_sequences(spark, sf_dir, tmp_path):
    """Each source's documents are packed as the mix laid them out, over several files of unlike sizes that Spark reads largest first."""
    docs = table(spark, sf_dir, "documents").repartition(5)
    mixed = mixing.mix_documents(docs.withColumn("text", F.when(F.col("doc_id") % 50 == 3, F.repeat("text", F.lit(30))).otherwise(F.col("text"))))
    mixed.write.option("maxRecordsPerFile", 40).parquet(str(tmp_path / "mixed"))
    files = sorted((tmp_path / "mixed").glob("*.parquet"))
    laid = [r for f in files for r in pq.read_table(f).select(["doc_id", "source"]).to_pylist()]
    packed = corpus_pipeline.pack_sequences(spark, spark.read.parquet(str(tmp_path / "mixed")), sf_dir).collect()
    source = {r["doc_id"]: r["source"] for r in laid}
    assert len(files) > 5 and len(source) > 100
    for s in set(source.values()):
        want = [r["doc_id"] for r in laid if r["source"] == s]
        ends = sorted((r["sequence_id"], r["offset"], r["doc_id"]) for r in packed if source[r["doc_id"]] == s and r["start"] + r["length"] == r["doc_tokens"])
        assert [d for _, _, d in ends] == want


CLASH = ["score", "predicted", "n_lines", "n_removed", "key", "rep", "component", "position", "size", "part", "queue", "host", "kept", "__sm", "nr", "mark", "bucket"]


def test_hostile_rows_pass_every_stage(spark, sf_dir):
    """Nulls, empty and very long texts, repeated rows and ids, clashing columns; and an empty table."""
    long = "a long text that goes on and on, " * 30_000
    rows = [(1, long, "en", "a", 1), (None, "no id here but words enough", None, None, None), (3, None, "en", "b", 0), (4, "", None, "b", 0), (4, "another text", "de", "b", 3)] + [(7, "same row", "en", "c", 8)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("x") for c in CLASH})
    for name, stage in corpus_pipeline.STAGES:
        out = spool(stage(spark, docs, sf_dir), name)
        if name != "packing":
            assert out.columns == docs.columns and {r["score"] for r in out.collect()} <= {"x"}
        if name in ("line_dedup", "near_dedup"):
            assert out.count() == len(rows)
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        docs = out if name != "quality" else docs
    ends = [r["doc_id"] for r in out.collect() if r["start"] + r["length"] == r["doc_tokens"]]
    assert {1, None, 3, 4} <= set(ends)


def test_packing_holds_everything(stages):
    assert {r["doc_id"] for r in stages[5]} == set(ids(stages[4]))
    ends = Counter(r["doc_id"] for r in stages[5] if r["start"] + r["length"] == r["doc_tokens"])
    assert ends == ids(stages[4])
    filled = Counter()
    for r in stages[5]:
        filled[r["sequence_id"]] += r["length"]
    assert sum(v < 2048 for v in filled.values()) <= 1


def test_run_is_the_stages(spark, sf_dir, stages):
    """Row by row: the same pieces of the same documents at the same places, also in another run."""
    row = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], r["sequence_id"], r["offset"])
    assert sorted(map(row, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(row, stages[5]))
