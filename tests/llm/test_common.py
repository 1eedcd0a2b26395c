import zlib

import pytest
from pyspark.sql import functions as F

from strandmill.llm import common


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_lookup_join_is_the_same_beyond_its_limits(spark, monkeypatch, how):
    big = spark.createDataFrame([(k % 7, f"t{k}") for k in range(60)] + [(None, "n"), (99, "x")], "key int, text string")
    small = common.spool(spark.createDataFrame([(k, k * 2) for k in range(5)], "key int, value int"), "small")
    if how in ("left_semi", "left_anti"):
        small = small.select("key")
    near = common.lookup_join(big, small, "key", how)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    far = common.lookup_join(big, small, "key", how)
    assert far.columns == near.columns
    assert sorted(map(str, far.collect())) == sorted(map(str, near.collect())) and near.count() > 0


def test_spooled_tables_can_be_dropped(spark):
    df = common.spool(spark.range(10), "numbers")
    assert df.count() == 10
    common.drop_spool(df)
    with pytest.raises(Exception, match="exist|FAILED_READ"):
        df.count()


def test_folds(spark):
    df = spark.createDataFrame([(k,) for k in (0, 7, -3, None)], "id long").select("id", common.fold(F.col("id"), 3).alias("f"))
    assert all(r["f"] == zlib.crc32(b"" if r["id"] is None else str(r["id"]).encode()) % 3 for r in df.collect())


def test_only_ascii_letters_are_lowered(spark):
    assert spark.range(1).select(common.ascii_lower(F.lit("AZÄİz"))).first()[0] == "azÄİz"


def test_copies_of_a_large_table_are_not_broadcast(spark, monkeypatch):
    """Beyond the limits every salt has a copy, which the files' size, that Spark goes by, does not tell."""
    big = spark.createDataFrame([(k % 7, f"t{k}") for k in range(60)], "key int, text string")
    small = common.spool(spark.createDataFrame([(k, k * 2) for k in range(5)], "key int, value int"), "small")
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert "Broadcast" not in common.lookup_join(big, small, "key")._jdf.queryExecution().executedPlan().toString()
