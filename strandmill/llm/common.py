"""Pieces that several corpus operators share: the shared folder, written tables, folds, ASCII case."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local master, where everything is one machine, gets a temporary folder if it is unset.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="strandmill-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/") if "://" in found or not found.startswith("file:") else "file://" + found[5:].rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def spool(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, so a lost
    executor costs a reread rather than a recomputation, and rows keep their identity. Their order is that of the files' numbers and of the rows in each
    file; Spark reads large files first, so whoever needs the order takes it from there (see packing.in_file_order)."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_spool(df: DataFrame) -> None:
    """Delete the files of a spooled table that nothing will read again."""
    spark = df.sparkSession
    for f in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(c, UPPER, LOWER)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds`` (null id: that of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


#: A side of a join is broadcast only up to these measured limits.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def lookup_join(big: DataFrame, small: DataFrame, key: str, how: str = "left", salt: int = 16, most: int | None = None) -> DataFrame:
    """Join ``big`` with ``small``, a spooled table of one row for each ``key``.

    ``small`` is counted first. Within BROADCAST_ROWS (or ``most`` rows, if that is less) and BROADCAST_BYTES it is broadcast and ``big`` stays
    where it is; beyond, both sides are shuffled by key and a salt, so a key with many rows of ``big``
    is dealt over ``salt`` tasks. Rows without a key match nothing and are dealt over all tasks.
    """
    wide = sum((F.coalesce(F.octet_length(F.col(f.name).cast("string")), F.lit(1)) for f in small.schema), F.lit(8))
    rows, size = small.agg(F.count("*"), F.coalesce(F.sum(wide), F.lit(0))).first()
    if rows <= min(BROADCAST_ROWS, BROADCAST_ROWS if most is None else most) and size <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), key, how)
    # Its files may look small enough for a broadcast, of every copy.
    dealt = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))).hint("merge")
    mix = F.xxhash64(*[c for c in big.columns if c != key], F.lit(0))
    salted = big.withColumn("__salt", F.when(F.col(key).isNull(), F.pmod(mix, F.lit(1 << 30)).cast("int")).otherwise(F.pmod(mix, F.lit(salt)).cast("int")))
    return salted.join(dealt, [key, "__salt"], how).drop("__salt")


Batches = Iterator[pa.RecordBatch]


def of_ids(texts: DataFrame, ids: DataFrame, then: Callable[[Batches], Batches] | None = None, schema: str = "doc_id long, text string") -> DataFrame:
    """The rows of ``texts(doc_id long, text string)`` whose id is in ``ids(doc_id long)``, a spooled table of distinct ids; or what
    ``then``, a function for mapInArrow, makes of them under ``schema``, in the same Python worker.

    Up to BROADCAST_ROWS ids go to the tasks as a sorted array of 8 bytes each and texts stay where they lie; a broadcast join would build a table
    of ids that takes the driver many times that. Beyond, see lookup_join.
    """
    if ids.count() > BROADCAST_ROWS:
        rows = lookup_join(texts, ids, "doc_id", "left_semi").select("doc_id", "text")
        return rows.mapInArrow(then, schema) if then else rows
    known = texts.sparkSession.sparkContext.broadcast(np.sort(ids.where("doc_id is not null").toArrow().column(0).to_numpy()))

    def among(batches: Batches) -> Batches:
        found = known.value
        for b in batches:
            at = b.column(0).fill_null(0).to_numpy()
            place = np.minimum(np.searchsorted(found, at), max(len(found) - 1, 0))
            hit = (found[place] == at) & b.column(0).is_valid().to_numpy(zero_copy_only=False) if len(found) else np.zeros(len(at), bool)
            if hit.any():
                yield b.filter(pa.array(hit))

    def run(batches: Batches) -> Batches:
        return then(among(batches)) if then else among(batches)

    return texts.mapInArrow(run, schema)


#: Rows of a key beyond which they do not meet in a join by key.
HUB = 20_000


def told_join(big: DataFrame, small: DataFrame, key: str, n: str, hub: int | None = None) -> DataFrame:
    """Inner join of ``big`` with ``small``, a spooled table of one row for each ``key`` whose column ``n`` counts the rows of ``big`` that
    have it. Keys of more than ``hub`` rows are few; they are told to their rows where these lie (see lookup_join), the others shuffle."""
    hub = HUB if hub is None else hub
    told = [c for c in small.columns if c not in (key, n)]
    hubs = small.where(F.col(n) > hub).select(key, *told, F.lit(True).alias("__hub"))
    if hubs.isEmpty():
        return big.join(small.drop(n), key)
    tagged = lookup_join(big, spool(hubs, "hubs"), key)
    rest = tagged.where("__hub is null").select(*big.columns).join(small.where(F.col(n) <= hub).drop(n), key)
    return tagged.where("__hub").drop("__hub").unionByName(rest)
