"""Sequence files as DataFrames (genome_idx, record_idx, seq), and the store of cores.

FASTA and plain FASTQ are split between records or lines wherever Spark splits a file, so a large genome is read by
many tasks; blocked gzip is split between its blocks (see bgzf), other gzip files are decompressed by one task each. FASTA inside records: see fasta_ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored, work_folder

ON_MISSING = ("fail", "empty")


def _present(spark: SparkSession, manifest: DataFrame, on_missing: str) -> list[str]:
    """The manifest's paths; those of missing files are left out or refused."""
    if on_missing not in ON_MISSING:
        raise ValueError(f"on_missing is one of {ON_MISSING}")
    paths = [r["in_path"] for r in manifest.select("in_path").distinct().orderBy("in_path").collect()]
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    there = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            there.append(p)
        elif on_missing == "fail":
            raise FileNotFoundError(p)
    return there


def _bare(path: Column) -> Column:
    return F.regexp_replace(F.url_decode(path), r"^[a-z0-9+.-]+:(//[^/]*)?", "")


def _with_genome(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Give rows of a file their genome; the manifest is as small as the list of files it was read from, which the driver has, so rows stay where they are."""
    files = manifest.select("genome_idx", _bare(F.col("in_path")).alias("_file"))
    return rows.withColumn("_file", _bare(F.col("path"))).join(F.broadcast(files), "_file")


def read_fasta(spark: SparkSession, manifest: DataFrame, on_missing: str = "fail") -> DataFrame:
    """Records of the manifest's FASTA files: (genome_idx, record_idx, seq).

    A line that starts with ``>`` starts a record; its other lines are joined, without white space. Text before the
    first header is a record. Records without sequence are left out. record_idx ascends within a file.
    """
    paths = _present(spark, manifest, on_missing)
    if not paths:
        return spark.createDataFrame([], "genome_idx int, record_idx long, seq string")
    raw = spark.read.text(paths, lineSep="\n>").select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"))
    raw = raw.withColumn("id", F.monotonically_increasing_id())
    # All but a file's first record have lost their >; that one has a header only if it starts with it.
    first = raw.where("at = 0").groupBy("path").agg(F.min("id").alias("id"), F.lit(True).alias("first"))
    raw = raw.join(first, ["path", "id"], "left")
    headless = F.col("first").isNotNull() & ~F.col("value").startswith(">")
    body = F.when(headless, F.col("value")).otherwise(F.regexp_replace("value", r"^[^\n]*(\n|$)", ""))
    rows = raw.withColumn("record_idx", F.col("id")).withColumn("seq", F.regexp_replace(body, r"\s+", "")).where("seq <> ''")
    return _with_genome(rows, manifest).select("genome_idx", "record_idx", "seq")


READ = "path string, record_idx long, name string, seq string, plus string, quality string"
#: Blocks of input files up to which their starts are broadcast.
FEW_BLOCKS = 200_000


def _runs(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[bool, tuple, pa.Array]]:
    """Lines of one block after the other, in batches: whether the block begins, what ``names`` say of it, its lines without carriage returns."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        path, at = b.column("path"), b.column("at").to_numpy()
        codes = path.dictionary_encode().indices.to_numpy()
        cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (codes[1:] != codes[:-1])) + 1).tolist(), b.num_rows]
        for start, end in zip(cuts[:-1], cuts[1:]):
            about = tuple(b.column(n)[start].as_py() for n in names)
            key = (path[start].as_py(), int(at[start]))
            yield key != last, about, pc.replace_substring_regex(b.column("value").slice(start, end - start), r"\r$", "")
            last = key


def _block_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, at, n, row, line) of the first and last three lines of each block of n lines."""
    block, n, head, tail = None, 0, [], []

    def told() -> pa.RecordBatch:
        rows = dict(enumerate(head)) | {n - len(tail) + k: x for k, x in enumerate(tail)}
        return pa.RecordBatch.from_pylist([{"path": block[0], "at": block[1], "n": n, "row": k, "line": x} for k, x in sorted(rows.items())], schema)

    schema = pa.schema([("path", pa.string()), ("at", pa.int64()), ("n", pa.int64()), ("row", pa.int64()), ("line", pa.string())])
    for new, about, lines in _runs(batches, "path", "at"):
        if new:
            if block:
                yield told()
            block, n, head, tail = about, 0, [], []
        if len(head) < 3:
            head += lines.slice(0, 3 - len(head)).to_pylist()
        tail = (tail + lines.slice(max(0, len(lines) - 3)).to_pylist())[-3:]
        n += len(lines)
    if block:
        yield told()


def _whole_reads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The reads whose four lines lie in one block, by the numbers of lines before it."""
    held, nr, skip = None, 0, 0
    for new, (path, before), lines in _runs(batches, "path", "before"):
        if new:  # lines of a read that the block before began are passed over
            skip, held = -before % 4, None
            nr = before + skip
        lines, skip = lines.slice(skip), max(0, skip - len(lines))
        lines = pa.concat_arrays([held, lines]) if held is not None and len(held) else lines
        n = len(lines) // 4
        parts = [lines.take(pa.array(np.arange(k, 4 * n, 4))) for k in range(4)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(np.arange(nr // 4, nr // 4 + n)), *parts], ["path", "record_idx", "name", "seq", "plus", "quality"])
        nr, held = nr + 4 * n, lines.slice(4 * n)


def read_fastq(spark: SparkSession, manifest: DataFrame, on_missing: str = "fail", split: int = 8 << 20) -> DataFrame:
    """Reads of the manifest's FASTQ files, plain, gzip, or blocked gzip in ranges of ``split`` bytes: (genome_idx, record_idx, seq). Lines stay in their tasks; only
    those of reads that lie across two blocks are shuffled.

    Four lines are a read: @name, sequence, +, qualities of the sequence's length. Anything else raises an error, a
    truncated last read too. record_idx counts a file's reads from 0.
    """
    paths = _present(spark, manifest, on_missing)
    if not paths:
        return spark.createDataFrame([], "genome_idx int, record_idx long, seq string")
    from .bgzf import is_blocked, read_blocked

    blocked = [p for p in paths if p.endswith((".gz", ".bgz")) and is_blocked(p)]
    others = [p for p in paths if p not in set(blocked)]
    raws = [spark.read.text(others).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"))] if others else []
    raws += [read_blocked(spark, blocked, split)] if blocked else []
    raw = raws[0] if len(raws) == 1 else raws[0].unionByName(raws[1])
    # A block tells how many lines it has and its outermost three on either side; block sizes summed up give every line its number.
    ends = stored(raw.mapInArrow(_block_ends, "path string, at long, n long, row long, line string"), "blocks")
    blocks = ends.where("row = 0").select("path", "at", "n")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = stored(blocks.select("path", "at", "n", before.alias("before")), "starts")
    if blocks.count() > FEW_BLOCKS and len(paths) > 1:  # in two parts, so that what is broadcast stays bounded
        first = F.col("in_path").isin(paths[: len(paths) // 2])
        return read_fastq(spark, manifest.where(first), on_missing, split).unionByName(read_fastq(spark, manifest.where(~first), on_missing, split))
    known = F.broadcast(blocks)
    whole = raw.join(known.select("path", "at", "before"), ["path", "at"]).select("path", "at", "before", "value").mapInArrow(_whole_reads, READ)
    # Reads that lie across blocks come from the blocks' ends alone.
    line = ends.join(known.select("path", "at", "before"), ["path", "at"]).select("path", "at", "n", "before", (F.col("before") + F.col("row")).alias("nr"), "line")
    start = F.col("nr") - F.col("nr") % 4
    across = line.where((start < F.col("before")) | (start + 4 > F.col("before") + F.col("n")))
    pick = lambda k: F.max(F.when(F.col("nr") % 4 == k, F.col("line")))
    cut = across.groupBy("path", F.floor(F.col("nr") / 4).alias("record_idx")).agg(pick(0).alias("name"), pick(1).alias("seq"), pick(2).alias("plus"), pick(3).alias("quality"))
    reads = whole.unionByName(cut)
    blank = F.coalesce(F.concat_ws("", "name", "seq", "plus", "quality"), F.lit("")) == ""
    sound = F.col("name").startswith("@") & F.col("plus").startswith("+") & (F.length("seq") == F.length("quality"))
    checked = F.when(F.coalesce(sound, F.lit(False)), F.col("seq")).otherwise(F.raise_error(F.concat(F.lit("malformed read "), F.col("record_idx").cast("string"), F.lit(" in "), F.col("path"))))
    return _with_genome(reads.where(~blank), manifest).select("genome_idx", F.col("record_idx").cast("long").alias("record_idx"), checked.alias("seq"))


def write_cores(cores: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store cores by genome and level; a reader of some genomes prunes the others."""
    cores.write.mode(mode).partitionBy("level", "genome_idx").parquet(path)


def read_cores(spark: SparkSession, path: str, level: int | None = None) -> DataFrame:
    """Cores of a store, of one level or all."""
    found = spark.read.parquet(path)
    return found.where(F.col("level") == level) if level is not None else found


def write_core_files(cores: DataFrame, genomes: DataFrame) -> None:
    """Store each genome's cores in a folder of its own, the manifest's ``out_path``: one partitioned write of all
    genomes, whose folders are then moved to their places."""
    spark = cores.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    stage = work_folder(spark, "stage")
    cores.join(F.broadcast(genomes.where("out_path is not null").select("genome_idx")), "genome_idx", "left_semi").write.partitionBy("genome_idx").parquet(stage)
    for r in genomes.select("genome_idx", "out_path").where("out_path is not null").orderBy("genome_idx").collect():
        here, there = (jvm.org.apache.hadoop.fs.Path(x) for x in (f"{stage}/genome_idx={r['genome_idx']}", r["out_path"]))
        files, target = here.getFileSystem(conf), there.getFileSystem(conf)
        if not files.exists(here):  # a genome without cores
            cores.drop("genome_idx").limit(0).write.mode("overwrite").parquet(r["out_path"])
            continue
        target.delete(there, True)
        if there.getParent() is not None:
            target.mkdirs(there.getParent())
        # A move within one file system is a change of name; to another one, tasks write the genome there.
        if files.getUri().equals(target.getUri()) and files.rename(here, there):
            continue
        spark.read.parquet(here.toString()).write.mode("overwrite").parquet(r["out_path"])


def read_core_files(spark: SparkSession, manifest: DataFrame, on_missing: str = "fail", level: int | None = None) -> DataFrame:
    """Cores of genomes whose manifest lists a folder of cores for each, as write_core_files makes them."""
    paths = _present(spark, manifest, on_missing)
    if not paths:
        return spark.createDataFrame([], "genome_idx int, record_idx long, start long, end long, label long, len int, level int")
    raw = spark.read.parquet(*paths).select("*", F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("path"))
    found = _with_genome(raw, manifest.withColumn("in_path", F.regexp_replace("in_path", "/$", ""))).drop("path", "_file")
    return found.where(F.col("level") == level) if level is not None else found
