"""Blocked gzip (BGZF): a gzip file of members of at most 64 KB, each of which tells its size, so that ranges of one file go to several tasks.

A range starts at the first block that begins in it: where the fixed bytes of a header stand and a chain of sizes leads from block to block. Lines
belong to the range in which they begin; a line that goes on is read to its end, and the first line end of a range that isn't the file's first
belongs to the range before. Gzip files without block sizes can't be cut and stay with Spark's reader, one task each.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .fasta_ranges import _opened

#: Bytes of a range, and of what is handed on at a time; blocks that a chain is followed for; bytes of text in a block that is written.
SPLIT, BATCH, CHAIN, BLOCK = 8 << 20, 4 << 20, 3, 0xFF00
# Fixed values of the format: the first bytes of a header, its extra field's name and length, and the empty block that ends a file.
MAGIC, FIELD, HEADER = b"\x1f\x8b\x08\x04", b"BC\x02\x00", 18
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
LINES = "value string, path string, at long"


def block_size(header: bytes) -> int:
    """The size of the block that begins with these bytes, or 0 if none does."""
    if len(header) < HEADER or header[:4] != MAGIC or header[12:16] != FIELD or header[10:12] != b"\x06\x00":
        return 0
    return struct.unpack("<H", header[16:18])[0] + 1


def is_blocked(path: str) -> bool:
    files, at = _opened(path)
    with files.open_input_file(at) as f:
        return block_size(f.read_at(HEADER, 0)) > 0


def block_of(text: bytes) -> bytes:
    """``text``, BLOCK bytes at most, as a block."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    data = packer.compress(text) + packer.flush()
    return MAGIC + struct.pack("<IBBH", 0, 0, 255, 6) + FIELD + struct.pack("<H", len(data) + HEADER + 7) + data + struct.pack("<II", zlib.crc32(text), len(text))


def first_block(read, start: int, size: int) -> int:
    """Where the first block at or after ``start`` begins, the file's size if there is none; ``read(n, at)`` reads bytes."""
    at, window = start, b""
    while at < size:
        window = read(1 << 17, at)
        k = window.find(MAGIC)
        while k >= 0:
            place, links = at + k, 0
            while links < CHAIN and place < size and (step := block_size(read(HEADER, place))):
                place, links = place + step, links + 1
            if links and (links == CHAIN or place == size):
                return at + k
            k = window.find(MAGIC, k + 1)
        if at + len(window) >= size:
            break
        at += len(window) - len(MAGIC) + 1
    return size


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], split: int):
        self.paths, self.split = paths, split

    def partitions(self) -> list[_Range]:
        out = []
        for path in self.paths:
            files, at = _opened(path)
            size = files.get_file_info(at).size
            out += [_Range(path, start, min(start + self.split, size)) for start in range(0, size, self.split)]
        return out or [_Range("", 0, 0)]

    def texts(self, f, size: int, start: int) -> Iterator[tuple[int, bytes]]:
        """(begin, text) of the blocks from ``start`` on."""
        while start < size:
            step = block_size(f.read_at(HEADER, start))
            if not step:
                raise ValueError(f"no gzip block at byte {start}")
            data = f.read_at(step, start)
            text = zlib.decompress(data[HEADER:-8], -15)
            if len(data) < step or struct.unpack("<II", data[-8:]) != (zlib.crc32(text), len(text)):
                raise ValueError(f"damaged gzip block at byte {start}")
            yield start, text
            start += step

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        files, path = _opened(partition.path)
        with files.open_input_file(path) as f:
            size = f.size()
            begin = first_block(f.read_at, partition.start, size) if partition.start else 0
            held, size_held, skip = [], 0, partition.start > 0
            rest = b""
            for at, text in self.texts(f, size, begin) if begin < partition.end else ():
                if at >= partition.end:  # only the line that goes on, which is an earlier range's if none began here
                    if skip:
                        break
                    end = text.find(b"\n")
                    rest += text if end < 0 else text[: end + 1]
                    if end >= 0:
                        break
                    continue
                if skip:
                    end = text.find(b"\n")
                    if end < 0:
                        continue
                    text, skip = text[end + 1 :], False
                rest += text
                if len(rest) >= BATCH:
                    cut = rest.rfind(b"\n") + 1
                    if cut:
                        yield self._batch(partition, rest[:cut])
                        rest = rest[cut:]
            if rest:
                yield self._batch(partition, rest)

    def _batch(self, partition: _Range, text: bytes) -> pa.RecordBatch:
        lines = text.decode("utf-8", "replace").split("\n")
        lines = lines[:-1] if not lines[-1] else lines
        n = len(lines)
        return pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), pa.array([partition.path] * n, pa.string()), pa.array([partition.start] * n, pa.int64())], ["value", "path", "at"])


class BlockedLines(DataSource):
    """``format("bgzf_lines")``: options ``paths`` (a JSON list) and ``split`` (compressed bytes of a range)."""

    @classmethod
    def name(cls) -> str:
        return "bgzf_lines"

    def schema(self) -> str:
        return LINES

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(json.loads(self.options["paths"]), int(self.options.get("split", SPLIT)))


def read_blocked(spark: SparkSession, paths: list[str], split: int = SPLIT) -> DataFrame:
    """(value, path, at): the lines of blocked gzip files, in order within a range, which ``at`` names."""
    spark.dataSource.register(BlockedLines)
    return spark.read.format("bgzf_lines").option("paths", json.dumps(paths)).option("split", split).load()


def write_blocked(lines: DataFrame, folder: str, key: str) -> DataFrame:
    """Write ``lines(key, value)`` as blocked gzip under ``folder``, which executors share, a file for each key, lines in any order; (key, path) of the files, to be stored
    by the caller, who reads no others. A key's lines go through one task, a block at a time."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        files, root = _opened(folder)
        files.create_dir(root, recursive=True)
        now, sink, held, name = None, None, b"", ""
        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if sink is None or k != now:
                    if sink is not None:
                        sink.write((block_of(held) if held else b"") + END)
                        sink.close()
                        yield pa.RecordBatch.from_pylist([{"key": now, "path": name}])
                    now, held, name = k, b"", f"{folder.rstrip('/')}/{uuid.uuid4().hex}.gz"
                    sink = files.open_output_stream(f"{root.rstrip('/')}/{name.rsplit('/', 1)[1]}", compression=None)
                held += value.encode() + b"\n"
                while len(held) >= BLOCK:
                    sink.write(block_of(held[:BLOCK]))
                    held = held[BLOCK:]
        if sink is not None:
            sink.write((block_of(held) if held else b"") + END)
            sink.close()
            yield pa.RecordBatch.from_pylist([{"key": now, "path": name}])

    kind = lines.schema[key].dataType.simpleString()
    return lines.repartition(key).sortWithinPartitions(key).select(F.col(key).alias("key"), "value").mapInArrow(write, f"key {kind}, path string")
