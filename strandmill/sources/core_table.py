"""Signatures kept bucketed and sorted by core, so that comparing stored genomes moves none of them: buckets of the same number hold the same cores.

A store is a folder of Parquet whose name tells its number of buckets; any session opens it as a table. Genomes are added by further writes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

BUCKETS, KEYS = 64, ("label", "len")
COLUMNS = ("genome_idx", "label", "len", "cnt")


def _opened(spark: SparkSession, path: str, buckets: int, like: DataFrame) -> str:
    """The name of a table over the store, for this session; ``like`` has its columns. Dropping the table leaves the files."""
    kinds = ", ".join(f"`{c}` {like.schema[c].dataType.simpleString()}" for c in COLUMNS)
    name, by = f"strandmill_{uuid.uuid4().hex}", ", ".join(KEYS)
    spark.sql(f"create table {name} ({kinds}) using parquet clustered by ({by}) sorted by ({by}) into {buckets} buckets location '{path.rstrip('/')}/buckets-{buckets}'")
    return name


def write_signatures(sig: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Add ``sig(genome_idx, label, len, cnt)`` to the store under ``path``. Rows are dealt by bucket first, so a write adds one file to a bucket."""
    spark = sig.sparkSession
    name = _opened(spark, path, buckets, sig)
    sig.select(*COLUMNS).repartition(buckets, *KEYS).write.insertInto(name)
    spark.sql(f"drop table {name}")


def read_signatures(spark: SparkSession, path: str) -> DataFrame:
    """The store under ``path`` as a bucketed table; joins and sums by core need no exchange."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted(str(s.getPath().getName()) for s in files.listStatus(root) if str(s.getPath().getName()).startswith("buckets-"))
    if len(found) != 1:
        raise ValueError(f"{path} holds {len(found)} stores, not one")
    return spark.table(_opened(spark, path, int(found[0].removeprefix("buckets-")), spark.read.parquet(f"{path.rstrip('/')}/{found[0]}")))
