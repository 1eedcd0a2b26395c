"""Media columns: payloads stored as 8-bit images in archives, read back through a Spark data source.

A payload is a row of 64-sample lines and is stored losslessly as a greyscale PNG of that width. Writers
pack PNGs into uncompressed zip archives in a shared folder, one set of archives for each task, and the
commit lists the archives of the attempts that succeeded. The reader plans byte ranges over the listed
archives from their sizes alone, in a large archive or over several small ones; a task reads the archives' directories (archives, and so directories, are bounded in
size), takes the members whose offsets fall into its ranges, and streams them as Arrow batches. A member, or a directory,
that fails to read is read anew by its offset, from a freshly opened file, independently of the others.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import fresh_path

LINE = 64
LEVEL = 1
#: An archive is closed beyond this size; a reading task gets about SPLIT bytes; a batch holds about BATCH.
ARCHIVE, SPLIT, BATCH = 32 << 20, 8 << 20, 4 << 20
RETRIES, WAIT = 3, 0.2
#: Tasks that are planned at most, about; beyond, their ranges are larger and go over more archives.
MOST_RANGES = 50_000
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SCHEMA = "doc_id long, n_bytes long, media binary"


def padded(data: bytes) -> bytes:
    """``data`` and zero bytes up to a positive multiple of LINE."""
    return data + bytes(-len(data) % LINE or (LINE if not data else 0))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes) -> bytes:
    """A greyscale PNG of 8-bit samples, LINE wide, every line unfiltered. Equal payloads give equal bytes."""
    lines = np.zeros((len(payload) // LINE, LINE + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, LINE)
    header = struct.pack(">IIBBBBB", LINE, len(lines), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """The samples of a PNG as this module writes it; ValueError for anything else or damaged."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, width, height, data = 8, 0, 0, []
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        body, crc = media[at + 8 : at + 8 + size], media[at + 8 + size : at + 12 + size]
        if len(crc) < 4 or struct.unpack(">I", crc)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            width, height, depth, colour, *rest = struct.unpack(">IIBBBBB", body)
            if (depth, colour, *rest) != (8, 0, 0, 0, 0):
                raise ValueError("only plain 8-bit greyscale is stored here")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered line")
    return lines[:, 1:].tobytes()


@dataclass
class _Written(WriterCommitMessage):
    archives: list[tuple[str, int]]


@dataclass
class _Ranges(InputPartition):
    parts: list[tuple[str, int, int]]  # archive, first byte, byte after the last


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        files, root = pafs.FileSystem.from_uri(self.folder)
        files.create_dir(root, recursive=True)
        done, sink, archive, name, count = [], None, None, "", 0

        def close() -> None:
            archive.close()
            size = sink.tell()
            sink.close()
            done.append((name, size))

        for batch in iterator:
            for doc_id, n_bytes, media in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if archive is None:
                    name = f"{uuid.uuid4().hex}.zip"
                    sink = files.open_output_stream(f"{root}/{name}")
                    archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED)
                # The name carries what the image does not: a number in the task, the id, the unpadded length.
                archive.writestr(zipfile.ZipInfo(f"{count}/{'' if doc_id is None else doc_id}/{n_bytes}.png"), media)
                count += 1
                if sink.tell() >= ARCHIVE:
                    close()
                    archive = None
        if archive is not None:
            close()
        return _Written(done)

    def commit(self, messages: list[_Written | None]) -> None:
        """List the archives of the attempts that count; what lost attempts left is not listed, so not read."""
        files, root = pafs.FileSystem.from_uri(self.folder)
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/_archives-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([a for m in messages if m is not None for a in m.archives]).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        files, root = pafs.FileSystem.from_uri(self.folder)
        for m in messages:
            for name, _ in m.archives if m is not None else []:
                files.delete_file(f"{root}/{name}")


class _Reader(DataSourceReader):
    def __init__(self, folder: str, split: int, retries: int):
        self.folder, self.split, self.retries = folder, split, retries

    def partitions(self) -> list[_Ranges]:
        files, root = pafs.FileSystem.from_uri(self.folder)
        lists = [x.path for x in files.get_file_info(pafs.FileSelector(root)) if x.base_name.startswith("_archives-")]
        archives = []
        for path in lists:
            with files.open_input_stream(path) as f:
                archives += json.loads(f.read())
        split = max(self.split, -(-sum(size for _, size in archives) // MOST_RANGES))
        planned, held = [], 0
        for name, size in archives:
            for start in range(0, size, split):
                part = (name, start, min(start + split, size))
                if not planned or held + part[2] - part[1] > split:
                    planned.append([])
                    held = 0
                planned[-1].append(part)
                held += part[2] - part[1]
        return [_Ranges(p) for p in planned] or [_Ranges([])]

    def _again(self, attempt: int) -> None:
        """After a failed attempt: wait for the next one, or raise."""
        if attempt == self.retries:
            raise
        time.sleep(WAIT * 2**attempt)

    def _members(self, files: pafs.FileSystem, path: str, start: int, end: int) -> Iterator[tuple[str, bytes]]:
        """Names and contents of the members of an archive that begin in a range."""
        for attempt in range(self.retries + 1):
            try:
                archive = zipfile.ZipFile(files.open_input_file(path))
                break
            except (OSError, zipfile.BadZipFile):
                self._again(attempt)
        for member in archive.infolist():
            if not start <= member.header_offset < end:
                continue
            for attempt in range(self.retries + 1):
                try:
                    if attempt:
                        archive = zipfile.ZipFile(files.open_input_file(path))
                    media = archive.read(member)  # seeks to the member's offset; checks its length and crc32
                    break
                except (OSError, zipfile.BadZipFile):
                    self._again(attempt)
            yield member.filename, media

    def read(self, partition: _Ranges) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
        files, root = pafs.FileSystem.from_uri(self.folder)
        rows, size = [], 0
        for name, start, end in partition.parts:
            for filename, media in self._members(files, f"{root}/{name}", start, end):
                _, doc_id, n_bytes = filename.removesuffix(".png").split("/")
                rows.append((int(doc_id) if doc_id else None, int(n_bytes), media))
                size += len(media)
                if size >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)


class MediaArchives(DataSource):
    """``format("media_archives")``: option ``path``, and for reading ``split`` (bytes) and ``retries``."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("split", SPLIT)), int(self.options.get("retries", RETRIES)))

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])


def write_media(docs: DataFrame, folder: str) -> None:
    """Store the text of every row of ``docs(doc_id, text)`` in archives under ``folder``."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):  # images of a few rows at a time
                ids, texts = (x.to_pylist() for x in b.slice(at, 256).columns)
                raw = [(t or "").encode() for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t) for t in raw], pa.int64()), pa.array([encode_png(padded(t)) for t in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    docs.sparkSession.dataSource.register(MediaArchives)
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(store, SCHEMA).write.format("media_archives").mode("append").save(folder)


def read_media(spark: SparkSession, folder: str, **options) -> DataFrame:
    """doc_id, n_bytes and the stored image of every member of the committed archives under ``folder``."""
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").options(**options).load(folder)


def feature(payload: bytes) -> str:
    """Lines, mean and spread of the samples, share of samples that differ from the one before, distinct values."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    n, total, square = len(x), int(x.sum()), int((x * x).sum())
    spread = (square / n - (total / n) ** 2) ** 0.5 if square * n > total * total else 0.0
    return f"lines={n // LINE};mean={total / n:.4f};spread={spread:.4f};turns={int((x[1:] != x[:-1]).sum()) / n:.4f};values={len(np.unique(x))}"


def media_features(stored: DataFrame) -> DataFrame:
    """Decode every image of ``stored(doc_id, n_bytes, media)`` and describe its payload: the contract's columns."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, n_bytes, media in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media"))):
                payload = decode_png(media)
                out.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-LINE:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)

    text, long = pa.string(), pa.int64()
    schema = pa.schema([("doc_id", long), ("n_bytes", long), ("payload_bytes", long), ("payload_sha256", text), ("tail_crc32", long), ("media_bytes", long), ("media_sha256", text), ("feature", text)])
    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.mapInArrow(describe, ddl)


def store_and_describe(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Store every text of ``docs(doc_id, text)`` in archives, read them back and describe them.

    One result for each row: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature. Null text counts as empty, whose payload is LINE zero bytes; a null id stays
    null; repeated rows are stored and described each; equal texts have equal values. Other columns are
    ignored. An empty table gives an empty result. ``folder`` must be shared by driver and executors;
    by default it is new, under ``spark.checkpoint.dir``.
    """
    folder = folder or fresh_path(docs.sparkSession, "media")
    write_media(docs, folder)
    return media_features(read_media(docs.sparkSession, folder))
