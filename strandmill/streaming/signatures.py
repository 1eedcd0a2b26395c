"""Signatures that grow with a stream of sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.lcp import cores


def growing_signature(sequences: DataFrame, level: int = 1) -> DataFrame:
    """Counts of each genome's cores over a streaming (genome_idx, seq); state is one row for each core seen."""
    return cores(sequences.select("genome_idx", "seq"), level).groupBy("genome_idx", "label", "len").agg(F.count("*").alias("cnt"))


def keep_signature(sequences: DataFrame, path: str, checkpoint: str, level: int = 1) -> StreamingQuery:
    """Run the stream into Parquet files under ``path``, resumable from ``checkpoint``.

    Each batch writes the counts that it changed into a folder of its own, which a repeated batch replaces; nothing
    passes through the driver. See read_signature.
    """

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")

    return growing_signature(sequences, level).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).start()


def read_signature(spark: SparkSession, path: str) -> DataFrame:
    """The signature as of the last batch: each core's latest count."""
    changes = spark.read.parquet(path)
    return changes.groupBy("genome_idx", "label", "len").agg(F.max_by("cnt", "batch").alias("cnt"))
