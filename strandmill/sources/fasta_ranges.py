"""FASTA by ranges of bytes, also inside records, so that a chromosome on one line or many is read by as many tasks as it has ranges.

A range does not know what came before it: whether it starts inside a header, in which record, at which base. Each range first
tells what it can (headers, bases before the first and after the last, how its last line began), which is a row; sums and the last known
state over the rows of a file tell every range its place. Then the ranges are read as pieces with their coordinates. Two passes over the
bytes, no shuffle of bases.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..session import stored
from .sequences import _present, _with_genome

#: Bytes of a range; bases of a piece; ranges up to which their places are broadcast; tasks beyond which a task reads more than a range, up to SPLIT bytes.
SPLIT, PIECE, FEW_RANGES, TASKS = 16 << 20, 1 << 20, 200_000, 32
#: Rows of an Arrow batch; one ends earlier once it has PIECE bases.
ROWS = 4096
BLANK = re.compile(rb"\s+")

#: ``range`` is the place of the path in the list of files, above 32 bits for ``nr``: a number is a key that takes little memory.
TOLD = "range long, path string, nr long, headers long, lead long, head long, tail long, in_header boolean"
PIECES = "range long, path string, record long, at long, lead boolean, total long, last boolean, part string"
KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}


@dataclass
class _Bytes(InputPartition):
    """Ranges of a file from ``nr`` on, of ``split`` bytes each, that lie in ``start`` to ``end``."""

    path: str
    file: int
    nr: int
    start: int
    end: int


def _schema(columns: str) -> pa.Schema:
    return pa.schema([(n, KINDS[k]) for n, k in (c.split() for c in columns.split(", "))])


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+.-]+:", path) else (pafs.LocalFileSystem(), path)


def lines_of(data: bytes) -> Iterator[tuple[int, int]]:
    """Where the lines of ``data`` begin and end, without the line feeds."""
    at = 0
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        yield at, end
        at = end + 1


def stretches_of(data: bytes, fresh: bool) -> tuple[bytes, list[bytes], bool | None]:
    """What a range holds: the bases of its lead, the rest of a line that began before it (none if ``fresh``, at the start of a line); the bases of the record that goes
    on and of each record that starts; and whether its last line is a header, None if no line starts in it."""
    lead = b""
    if not fresh:
        end = data.find(b"\n")
        lead, data = (data, b"") if end < 0 else (data[:end], data[end + 1 :])
        if end < 0:
            return BLANK.sub(b"", lead), [b""], None
    records: list[list[bytes]] = [[]]
    header = False if data else None
    for a, b in lines_of(data):
        header = data[a : a + 1] == b">"
        if header:
            records.append([])
        else:
            records[-1].append(data[a:b])
    if data.endswith(b"\n") or header is None:  # the next range starts a line of its own
        header = False
    return BLANK.sub(b"", lead), [BLANK.sub(b"", b"".join(r)) for r in records], header


class _Ranges(DataSourceReader):
    def __init__(self, paths: list[str], split: int, told: bool):
        self.paths, self.split, self.told = paths, split, told

    def partitions(self) -> list[_Bytes]:
        """A task reads consecutive ranges of a file, one if there are few: the driver holds every task of a stage, and a task costs more than a short range."""
        sizes = [files.get_file_info(at).size for files, at in map(_opened, self.paths)]
        each = max(1, -(-sum(-(-size // self.split) for size in sizes) // max(TASKS, sum(sizes) // SPLIT)))
        step = each * self.split
        out = [_Bytes(path, f, start // self.split, start, min(start + step, size)) for f, (path, size) in enumerate(zip(self.paths, sizes)) for start in range(0, size, step)]
        return out or [_Bytes("", 0, 0, 0, 0)]

    def read(self, partition: _Bytes) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        schema = _schema(TOLD if self.told else PIECES)
        held, bases = [], 0
        for row in self._rows(partition):
            held.append(row)
            bases += 0 if self.told else len(row[-1])
            if bases >= PIECE or len(held) >= ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*held), schema)], schema=schema)
                held, bases = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*held), schema)], schema=schema)

    def _rows(self, partition: _Bytes) -> Iterator[tuple]:
        files, path = _opened(partition.path)
        with files.open_input_file(path) as f:
            for nr, start in enumerate(range(partition.start, partition.end, self.split), partition.nr):
                before = f.read_at(1, start - 1) if start else b"\n"
                lead, records, header = stretches_of(f.read_at(min(self.split, partition.end - start), start), before == b"\n")
                key = partition.file << 32 | nr
                if self.told:
                    yield key, partition.path, nr, len(records) - 1, len(lead), len(records[0]), len(records[-1]), header
                    continue
                for k, bases in enumerate(records):
                    texts = [(True, lead, 0)] if k == 0 and lead else []
                    shift = len(lead) if k == 0 else 0
                    texts += [(False, bases[a : a + PIECE], shift + a) for a in range(0, len(bases), PIECE)]
                    for is_lead, text, at in texts:
                        for a in range(0, len(text), PIECE):
                            yield key, partition.path, k, at + a, is_lead, len(bases), k == len(records) - 1, text[a : a + PIECE].decode("latin-1")


class FastaRanges(DataSource):
    """``format("fasta_ranges")``: options ``paths`` (a JSON list), ``split`` (bytes) and ``told`` (what ranges tell of themselves instead of their pieces)."""

    @classmethod
    def name(cls) -> str:
        return "fasta_ranges"

    def schema(self) -> str:
        return TOLD if self.options.get("told") == "true" else PIECES

    def reader(self, schema: StructType) -> _Ranges:
        return _Ranges(json.loads(self.options["paths"]), int(self.options.get("split", SPLIT)), self.options.get("told") == "true")


def places(told: DataFrame) -> DataFrame:
    """(range, cut, dropped, record, offset, head_length, tail_length) of every range: bases of its lead that belong to a header and how many those are, the
    file's record that it goes on with, that record's base at which it does, and the lengths of its first and last records."""
    before = Window.partitionBy("path").orderBy("nr").rowsBetween(Window.unboundedPreceding, -1)
    known = told.select("range", "path", "nr", "headers", "lead", "head", "tail", F.coalesce(F.last("in_header", True).over(before), F.lit(False)).alias("cut"), F.coalesce(F.sum("headers").over(before), F.lit(0)).alias("record"))
    known = known.withColumn("dropped", F.when(F.col("cut"), F.col("lead")).otherwise(0))
    first = F.struct(F.col("record").alias("r"), (F.col("lead") - F.col("dropped") + F.col("head")).alias("n"), F.lit(0).alias("k"))
    last = F.when(F.col("headers") > 0, F.struct((F.col("record") + F.col("headers")).alias("r"), F.col("tail").alias("n"), F.lit(1).alias("k")))
    shares = known.select("range", "path", "nr", F.explode(F.array_compact(F.array(first, last))).alias("s")).select("range", "path", "nr", "s.*")
    record = Window.partitionBy("path", "r")
    summed = shares.withColumn("offset", F.coalesce(F.sum("n").over(record.orderBy("nr").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("length", F.sum("n").over(record))
    pick = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    ends = summed.groupBy("range").agg(pick("offset", 0).alias("offset"), pick("length", 0).alias("head_length"), pick("length", 1).alias("tail_length"))
    return known.select("range", "cut", "dropped", "record").join(ends, "range")


def read_fasta_ranges(spark: SparkSession, manifest: DataFrame, on_missing: str = "fail", split: int = SPLIT) -> DataFrame:
    """Records of the manifest's FASTA files as pieces: (genome_idx, record_idx, at, part, length), as ``read_fasta`` understands records.

    record_idx counts a file's headers; text before the first is record 0. Records without bases have no piece. Headers and lines may be of any
    length and end anywhere in a range. Files that are given twice are read once for each genome.
    """
    paths = _present(spark, manifest, on_missing)
    if not paths:
        return spark.createDataFrame([], "genome_idx int, record_idx long, at long, part string, length long")
    spark.dataSource.register(FastaRanges)
    source = spark.read.format("fasta_ranges").option("paths", json.dumps(paths)).option("split", split)
    known = stored(places(source.option("told", "true").load()), "ranges")
    told = F.broadcast(known) if known.count() <= FEW_RANGES else known
    found = spark.read.format("fasta_ranges").option("paths", json.dumps(paths)).option("split", split).load().withColumnRenamed("record", "own")
    placed = found.join(told, "range").where(~(F.col("lead") & F.col("cut")))
    goes_on = F.col("own") == 0
    length = F.when(goes_on, F.col("head_length")).when(F.col("last"), F.col("tail_length")).otherwise(F.col("total"))
    at = F.col("at") + F.when(goes_on, F.col("offset") - F.col("dropped")).otherwise(0)
    rows = placed.select("path", (F.col("record") + F.col("own")).alias("record_idx"), at.alias("at"), "part", length.alias("length"))
    return _with_genome(rows, manifest).select("genome_idx", "record_idx", "at", "part", "length")
