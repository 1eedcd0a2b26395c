import importlib
import subprocess
import sys
from pathlib import Path

import pytest

from strandmill.plans.registry import ORACLES, QUERIES

from .oracle import assert_same, connection

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), connection(sf_dir), ORACLES[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert importlib.import_module("__spark_entry__").entry(spark).count() == 6


def test_the_library_stands_without_the_corpus_operators(tmp_path):
    """Nothing outside the subpackage needs it."""
    for name in ("strandmill", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    subprocess.run(["find", str(tmp_path), "-path", "*/llm*", "-delete"], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert 'distances_set' in q and not [k for k in q if k.startswith('op') or k == 'pipeline'] and set(o) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True)


def test_operators_that_cannot_be_imported_do_not_take_the_rest_down(tmp_path):
    for name in ("strandmill", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    (tmp_path / "strandmill" / "llm").mkdir(exist_ok=True)
    (tmp_path / "strandmill" / "llm" / "__init__.py").write_text("import there_is_no_such_module\n")
    code = "import __spark_entry__ as e; assert 'distances_set' in e.queries() and 'op1_quality' not in e.queries() and 'signature' in e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True)


def test_streaming_signature(spark, tmp_path):
    from strandmill.functions.lcp import cores
    from strandmill.operators.signature import signature
    from strandmill.streaming.signatures import keep_signature, read_signature

    rows = [("a", "ACCTGACCATTGCA"), ("b", "TTGACCGATACCAGT"), ("a", "CCATTGACCTAAGCT")]
    data = spark.createDataFrame(rows, "genome_idx string, seq string")
    data.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = keep_signature(stream, str(tmp_path / "grown"), str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, read_signature(spark, str(tmp_path / "grown")).drop("batch").collect())) == sorted(map(tuple, signature(cores(data)).collect()))
