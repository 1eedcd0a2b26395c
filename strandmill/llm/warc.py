"""Web archives: WARC records of pages, an index of captures merged from sorted runs, and the way back.

1. Payloads are compared by SHA-256, counted natively; of equal ones that with the least page_id is a response, the others
   are revisits of it (WARC 1.1, identical-payload-digest) and store no payload.
2. A task sorts its pages by url key, time and id and writes them as gzipped records, a member each, to archives of its
   own, and their places to a run: an index in the same order, cut into compressed blocks. What a task hands on is one row
   for each block (place, first and last entry). Lost attempts leave files that no row names, so nothing reads them.
3. Runs are merged outside memory: the key space is cut into ranges at entries of a bounded sample of blocks; the task
   of a range opens those blocks of each run that reach into it, one block of each run at a time, and merges them by a loser
   tree. More than FAN runs are first merged in groups, each into a longer run, in as many passes as that takes. A range ends
   between any two captures, so the captures of one url, however many, are dealt over as many tasks.
4. The merged index is the globally ordered history of captures. Records are read back in its order, by offset: archives are in
   key order themselves, so what a range needs of one lies together and is read in one piece.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import time
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, fresh_path, lookup_join, spool
from .loser_tree import merge_sorted
from .url_filter import part

#: Archives are closed beyond this size; compression of records; entries of an index block.
ARCHIVE, LEVEL, BLOCK = 256 << 20, 4, 256
#: Runs that one task merges at most on average; index blocks of a range, about; ranges at most, and blocks sampled for each.
FAN, BLOCKS_PER_RANGE, MOST_RANGES, SAMPLE = 128, 8, 20_000, 5
#: Bytes of records that are read back at once, and gaps that are read over rather than sought over.
READ, GAP = 4 << 20, 64 << 10
RETRIES, WAIT = 3, 0.2
#: Fixed values of the WARC format.
VERSION, REVISIT = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = "urn:page:"

ENTRY = ["url_key", "stamp", "page_id", "archive", "offset", "length"]
BLOCKS = "run string, nr long, file string, offset long, length long, rows long, first string, last string"
INDEX = "part int, place long, url_key string, stamp string, page_id long, archive string, offset long, length long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, stamp string, part int, place long"


def url_key(url: Column) -> Column:
    """The sort-friendly form of a url: host labels in reverse order, then path and query, without scheme, user, port and fragment.
    A url without ``://`` stands for itself, null for the empty key."""
    host = F.regexp_extract(part(url, r"([^/?#]*)"), r"(?s)^(?:.*@)?([^:]*)", 1)
    turned = F.array_join(F.reverse(F.split(ascii_lower(host), r"\.")), ",")
    return F.coalesce(F.when(url.contains("://"), F.concat(turned, F.lit(")"), part(url, r"[^/?#]*([^#]*)"))).otherwise(url), F.lit(""))


def judged(pages: DataFrame, at_least: int = 0) -> DataFrame:
    """page_id, url, html (null: empty), stamp, url_key and ``first``: the least page_id of equal payloads that are there more than once and have ``at_least``
    bytes, else null."""
    stamp = F.col("stamp") if "stamp" in pages.columns else F.lit(None)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), F.coalesce(stamp.cast("string"), F.lit("19700101000000")).alias("stamp"))
    rows = rows.withColumn("print", F.when(F.octet_length("html") >= at_least, F.sha2("html", 256)))
    shared = rows.where("print is not null").groupBy("print").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    return lookup_join(rows, spool(shared, "payloads"), "print").select("page_id", "url", "html", "stamp", "first", url_key(F.col("url")).alias("url_key"))


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, html: str, stamp: str, first: int | None) -> bytes:
    """One WARC record, uncompressed. The block is an HTTP response; a revisit's ends with its head, which tells the length of the payload."""
    payload = html.encode("utf-8", "surrogatepass")
    revisit = first is not None and page_id != first
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    lines = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{f'urn:uuid:{uuid.uuid4()}' if page_id is None else f'{PAGE}{page_id}'}>"]
    lines.append(f"WARC-Date: {stamp[:4]}-{stamp[4:6]}-{stamp[6:8]}T{stamp[8:10]}:{stamp[10:12]}:{stamp[12:]}Z")
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{PAGE}{first}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest_of(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers (lower-case names), HTTP head and payload of an uncompressed record; ValueError if it is damaged."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(headers.get("content-length", -1))
    if version != VERSION or not blank or size < 0 or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, blank, payload = rest[:size].partition(b"\r\n\r\n")
    if headers["warc-type"] == "response" and headers["warc-payload-digest"] != f"sha1:{digest_of(payload)}":
        raise ValueError("payload does not match its digest")
    return headers, http, payload


def _gzipped(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Run:
    """Writes an index in order, in blocks, and describes each as a row of BLOCKS."""

    def __init__(self, files: pafs.FileSystem, path: str, run: str, nr: int = 0):
        self.sink, self.path, self.run, self.nr = files.open_output_stream(path), path, run, nr
        self.held: list[list] = []

    def add(self, entry: list) -> tuple | None:
        self.held.append(entry)
        return self.flush() if len(self.held) >= BLOCK else None

    def flush(self) -> tuple | None:
        if not self.held:
            return None
        lines = [json.dumps(e, separators=(",", ":")) for e in self.held]
        data, offset = zlib.compress("\n".join(lines).encode(), LEVEL), self.sink.tell()
        self.sink.write(data)
        self.held, self.nr = [], self.nr + 1
        return self.run, self.nr - 1, self.path, offset, len(data), len(lines), lines[0], lines[-1]

    def close(self) -> tuple | None:
        last = self.flush()
        self.sink.close()
        return last


def _described(found: list[tuple | None]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found if x], kind) for k, kind in enumerate(kinds)], [c.split()[0] for c in BLOCKS.split(", ")])


def write_archives(pages: DataFrame, folder: str, at_least: int = 0) -> DataFrame:
    """Write a record for every row of ``pages(page_id, url, html[, stamp])`` under ``folder``, which executors share; the blocks of the
    sorted runs that index them, as a written table."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        name, n = uuid.uuid4().hex, 0
        run = sink = None
        for batch in batches:
            found = []
            for page_id, url, html, stamp, first, key in zip(*(c.to_pylist() for c in batch.columns)):
                if run is None:
                    run = _Run(files, f"{root}/{name}.index", name)
                if sink is None:
                    archive = f"{name}-{n:05d}.warc.gz"
                    sink = files.open_output_stream(f"{root}/{archive}", compression=None)
                    info = f"{VERSION}\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {time.strftime('%Y-%m-%dT%H:%M:%SZ', time.gmtime())}\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
                    sink.write(_gzipped(info.encode()))
                data, offset = _gzipped(record(page_id, url, html, stamp, first)), sink.tell()
                sink.write(data)
                found.append(run.add([key, stamp, int(page_id is not None), page_id or 0, archive, offset, len(data)]))
                if sink.tell() >= ARCHIVE:
                    sink.close()
                    sink, n = None, n + 1
            yield _described(found)
        if sink is not None:
            sink.close()
        if run is not None:
            yield _described([run.close()])

    rows = judged(pages, at_least).sortWithinPartitions("url_key", "stamp", F.col("page_id").asc_nulls_first())
    return spool(rows.mapInArrow(write, BLOCKS), "runs")


def _cursor(files: pafs.FileSystem, blocks: list[tuple[str, int, int]], low: list | None, high: list | None) -> Iterator[list]:
    """The entries of a run's blocks from ``low`` on and before ``high``; one block is held at a time."""
    for path, offset, length in blocks:
        for attempt in range(RETRIES + 1):
            try:
                with files.open_input_file(path) as f:
                    lines = zlib.decompress(f.read_at(length, offset)).decode().split("\n")
                break
            except (OSError, zlib.error):
                if attempt == RETRIES:
                    raise
                time.sleep(WAIT * 2**attempt)
        for line in lines:
            entry = json.loads(line)
            if high is not None and entry >= high:
                return
            if low is None or entry >= low:
                yield entry


def _splitters(blocks: DataFrame, ranges: int) -> list[list]:
    """Entries that cut the key space into about ``ranges`` parts of as many blocks, from a bounded sample of blocks."""
    if ranges < 2:
        return []
    sample = sorted(json.loads(r[0]) for r in blocks.select("first").orderBy(F.xxhash64("first")).limit(SAMPLE * ranges).collect())
    cuts = [sample[k * len(sample) // ranges] for k in range(1, ranges)]
    return [c for k, c in enumerate(cuts) if not k or c != cuts[k - 1]]


def _pass(blocks: DataFrame, folder: str, groups: int, last: bool) -> DataFrame:
    """Merge the runs of each of ``groups`` groups: into the index itself if it is the ``last`` pass, else into a run for each group."""
    n_blocks = blocks.count()
    splitters = _splitters(blocks, min(MOST_RANGES, -(-n_blocks // (groups * BLOCKS_PER_RANGE))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for group, run, nr, file, offset, length, first, end in zip(*(c.to_pylist() for c in b.columns)):
                for r in range(bisect_right(splitters, json.loads(first)), bisect_right(splitters, json.loads(end)) + 1):
                    rows.append({"group": group, "part": r, "run": run, "nr": nr, "file": file, "offset": offset, "length": length})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("group", pa.int32()), ("part", pa.int32()), ("run", pa.string()), ("nr", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

    def merged(files: pafs.FileSystem, part: int, runs: dict[str, list]) -> Iterator[list]:
        low, high = splitters[part - 1] if part else None, splitters[part] if part < len(splitters) else None
        return merge_sorted([_cursor(files, found, low, high) for found in runs.values()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        here, runs = None, {}

        def finish() -> Iterator[pa.RecordBatch]:
            group, part = here
            if last:
                held = []
                for place, entry in enumerate(merged(files, part, runs)):
                    held.append((part, place, entry[0], entry[1], entry[3] if entry[2] else None, *entry[4:]))
                    if len(held) == 4096:
                        yield _indexed(held)
                        held = []
                if held:
                    yield _indexed(held)
                return
            out = _Run(files, f"{root}/{uuid.uuid4().hex}.index", f"{group}", part << 32)
            yield _described([*(out.add(e) for e in merged(files, part, runs)), out.close()])

        for b in batches:
            for group, part, name, file, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                if here not in (None, (group, part)):
                    yield from finish()
                    runs = {}
                here = (group, part)
                runs.setdefault(name, []).append((file, offset, length))
        if here is not None:
            yield from finish()

    grouped = blocks.select(F.pmod(F.xxhash64("run"), F.lit(groups)).cast("int").alias("group"), "run", "nr", "file", "offset", "length", "first", "last")
    placed = grouped.mapInArrow(place, "group int, part int, run string, nr long, file string, offset long, length long")
    dealt = placed.repartition(groups * (len(splitters) + 1), "group", "part").sortWithinPartitions("group", "part", "run", "nr").select("group", "part", "run", "file", "offset", "length")
    return dealt.mapInArrow(run, INDEX if last else BLOCKS)


def _indexed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kind) for k, kind in enumerate(kinds)], [c.split()[0] for c in INDEX.split(", ")])


def capture_index(blocks: DataFrame, folder: str) -> DataFrame:
    """The globally ordered history of captures: INDEX, in the order of (part, place), a part in one task."""
    while (runs := blocks.select("run").distinct().count()) > FAN:
        blocks = spool(_pass(blocks, folder, -(-runs // FAN), False), "runs")
    return _pass(blocks, folder, 1, True)


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that ``index`` names, read from their archives in its order, parsed and verified: RECORD."""
    columns = ["archive", "offset", "length", "url_key", "stamp", "part", "place"]
    schema = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[k]) for n, k in (c.split() for c in RECORD.split(", "))])

    def fetch(files: pafs.FileSystem, root: str, wanted: list[tuple[str, int, int]]) -> dict[tuple[str, int], bytes]:
        """Members by archive and offset. What lies close together in an archive is read in one piece, and anew if that fails."""
        out: dict[tuple[str, int], bytes] = {}
        pieces: list[tuple[str, list[tuple[int, int]]]] = []
        for archive, offset, length in sorted(wanted):
            if pieces and pieces[-1][0] == archive and offset - sum(pieces[-1][1][-1]) <= GAP:
                pieces[-1][1].append((offset, length))
            else:
                pieces.append((archive, [(offset, length)]))
        for archive, members in pieces:
            start, end = members[0][0], sum(members[-1])
            for attempt in range(RETRIES + 1):
                try:
                    with files.open_input_file(f"{root}/{archive}") as f:
                        data = f.read_at(end - start, start)
                    for offset, length in members:
                        out[archive, offset] = zlib.decompress(data[offset - start : offset - start + length], 31)
                    break
                except (OSError, zlib.error):
                    if attempt == RETRIES:
                        raise
                    time.sleep(WAIT * 2**attempt)
        return out

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns)))
            start = size = 0
            for k, row in enumerate(rows):
                size += row[2]
                if size < READ and k < len(rows) - 1:
                    continue
                found, out = fetch(files, root, [r[:3] for r in rows[start : k + 1]]), []
                for archive, offset, _, key, stamp, part, place in rows[start : k + 1]:
                    headers, http, payload = parse_record(found[archive, offset])
                    page, target = headers["warc-record-id"].strip("<>"), headers.get("warc-refers-to")
                    whole = len(payload) if headers["warc-type"] == "response" else int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
                    out.append((int(page.removeprefix(PAGE)) if page.startswith(PAGE) else None, whole, headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"], int(target.strip("<>").removeprefix(PAGE)) if target else None, key, stamp, part, place))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                start, size = k + 1, 0

    return index.select(*columns).mapInArrow(read, RECORD)


def archive_pages(pages: DataFrame, folder: str | None = None, at_least: int = 0) -> DataFrame:
    """Archive every row of ``pages(page_id, url, html)`` and read the archives back in the order of the merged index: page_id,
    payload_bytes, payload_digest (base32 SHA-1), record_type, refers_to, url_key, stamp, part and place (order of captures).

    Null html is an empty payload; null urls have the empty key. Of rows whose payloads are equal and have ``at_least`` bytes, those with the least page_id
    are responses and the others revisit it; repeated rows with that id are all responses. A null id stays null, is never the
    least, and revisits an equal payload that has an id; payloads that only rows without ids have are responses.
    ``stamp`` is the time of capture as 14 digits, 1970 if the column is missing or null. Other columns are ignored; an empty table
    gives an empty result. ``folder`` must be shared by driver and executors; by default it is new, under ``spark.checkpoint.dir``.
    """
    folder = folder or fresh_path(pages.sparkSession, "archives")
    return read_records(capture_index(write_archives(pages, folder, at_least), folder), folder)


#: Pages of the test tables have no time of capture; the order of their ids stands for it, a second each from 2024 on.
BEGIN = 1_704_067_200


def stamped(pages: DataFrame) -> DataFrame:
    seconds = F.lit(BEGIN) + F.pmod(F.coalesce(F.col("page_id").cast("long"), F.lit(0)), F.lit(10**9))
    return pages.select("page_id", "url", "html", F.date_format(F.timestamp_seconds(seconds), "yyyyMMddHHmmss").alias("stamp"))


def oracle() -> str:
    letters = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha, {5 * g + 1}, 5))::bigint >> {s}) & 31)::int + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))
    return f"""
    with p as (select page_id, url, coalesce(html, '') as h, sha1(coalesce(html, '')) as sha from pages),
    f as (select *, min(page_id) over (partition by h) as first, count(*) over (partition by h) as copies from p),
    r as (select *, coalesce(copies > 1 and first is not null and page_id is distinct from first, false) as again, regexp_extract(url, '^.*?://([^/?#]*)', 1) as authority from f)
    select page_id, strlen(h)::bigint as payload_bytes, {letters} as payload_digest, case when again then 'revisit' else 'response' end as record_type, case when again then first end as refers_to,
      case when url is null then '' when not contains(url, '://') then url else array_to_string(list_reverse(string_split(lower(regexp_extract(authority, '^(?:.*@)?([^:]*)', 1)), '.')), ',') || ')' || regexp_extract(url, '^.*?://[^/?#]*([^#]*)', 1) end as url_key,
      strftime(make_timestamp(({BEGIN} + coalesce(page_id, 0) % 1000000000) * 1000000), '%Y%m%d%H%M%S') as stamp from r
    """
