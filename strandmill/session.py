"""Session settings and table access shared by the whole library."""

from __future__ import annotations

import logging
import os
import sys
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

LOG_FORMAT = "[%(asctime)s] [%(levelname)s] %(message)s"
LOG_DATES = "%d-%m-%Y %H:%M:%S"


def logger(verbose: bool = False) -> logging.Logger:
    """The library's logger: day-first timestamps and the level, on standard output."""
    log = logging.getLogger("strandmill")
    if not log.handlers:
        handler = logging.StreamHandler(sys.stdout)
        handler.setFormatter(logging.Formatter(LOG_FORMAT, LOG_DATES))
        log.addHandler(handler)
    log.setLevel(logging.INFO if verbose else logging.WARNING)
    return log


def local_session(cores: int | str = 8, app: str = "strandmill") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own configuration."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("STRANDMILL_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables as a lazy Parquet scan; projections and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession, tag: str) -> str:
    """A path that nothing has used yet, in the folder that driver and executors share (``spark.checkpoint.dir``); a temporary one
    on a single machine, where it is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="strandmill-")
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back: several readers cost one computation, and lineage ends there."""
    path = work_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
