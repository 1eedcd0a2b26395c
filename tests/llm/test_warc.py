"""Web archives: records, sorted runs, their merge, and pages that come back from archives."""

import base64
import gzip
import hashlib
import json
import random
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandmill.llm import common, warc
from strandmill.llm.loser_tree import merge_sorted


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20)), max_size=9))
def test_loser_tree_merges(streams):
    tagged = [[(v, k) for v in sorted(s)] for k, s in enumerate(streams)]
    assert list(merge_sorted(tagged)) == sorted(x for s in tagged for x in s)


def test_equal_items_come_from_the_earlier_stream_first():
    class Item:
        def __init__(self, v, k):
            self.v, self.k = v, k

        def __lt__(self, other):
            return self.v < other.v

    got = list(merge_sorted([[Item(v, k) for v in (1, 1, 2)] for k in range(5)]))
    assert [(x.v, x.k) for x in got] == [(1, k) for k in range(5) for _ in range(2)] + [(2, k) for k in range(5)]


@pytest.mark.parametrize("first", [None, 7, 3])
@pytest.mark.parametrize("html", ["", "x", "<p>é\r\n\r\nWARC/1.1\r\n\r\n</p>", "\x00" * 10])
def test_records_come_back(html, first):
    data = warc.record(7, "https://a.example/ü b\nc", html, "20240102030405", first)
    headers, http, payload = warc.parse_record(data)
    assert headers["warc-type"] == ("revisit" if first == 3 else "response") and headers["warc-date"] == "2024-01-02T03:04:05Z"
    assert headers["warc-target-uri"] == "https://a.example/ü%20b%0Ac"
    assert payload == (b"" if first == 3 else html.encode()) and f"Content-Length: {len(html.encode())}".encode() in http
    assert headers["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()


def test_damage_is_noticed():
    data = warc.record(7, "u", "some payload", "20240102030405", None)
    for broken in (data[:-1], data.replace(b"some", b"sOme"), data.replace(b"WARC/1.1", b"WARC/9.9"), b""):
        with pytest.raises(ValueError):
            warc.parse_record(broken)


def test_url_keys(spark):
    cases = {
        "https://User@WWW.Example.COM:8080/A/b?q=1#f": "com,example,www)/A/b?q=1", "http://x.org": "org,x)", "no scheme": "no scheme", "": "", None: "", "ftp:///p": ")/p", "a://h?x://y": "h)?x://y",
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string").select("url", warc.url_key(F.col("url")).alias("k"))
    assert {r["url"]: r["k"] for r in df.collect()} == cases


def plain(rows, at_least=0):
    """(page_id, payload_bytes, digest, type, refers_to) by counting in a dictionary."""
    first = {}
    for i, _, h, *_ in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h, *_ in rows:
        data = (h or "").encode()
        f = first.get(h or "") if len(data) >= at_least else None
        again = f is not None and i != f
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    made = [(k, f"https://h{rng.randrange(9)}.example/p{rng.randrange(40)}", rng.choice(["", None, "same", f"<p>own {k}</p>", "é" * 50, "x" * rng.randrange(5000)]), f"202401{rng.randrange(10, 30)}000000") for k in range(200)]
    hot = [(1000 + k, "https://hot.example/", f"version {k % 3}", "20240101000000") for k in range(120)]
    return made + hot + [(None, None, "same", None), (None, "u", None, None), (None, "u", "only without an id", None), (None, "u", "only without an id", None), (5, "twice", "twice", None), (5, "twice", "twice", None)]


@pytest.fixture(scope="module")
def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, stamp string").withColumns({c: F.lit("x") for c in ("first", "n", "print", "key", "part", "place", "run", "offset", "url_key", "archive", "group")})


def order_of(df):
    got = df.orderBy("part", "place").collect()
    keys = [(r["url_key"], r["stamp"], r["page_id"] is not None, r["page_id"] or 0) for r in got]
    return got, keys


@pytest.mark.parametrize("fan, block, per_range, archive", [(128, 256, 8, 1 << 28), (2, 16, 1, 3000), (3, 5, 2, 1), (128, 1, 1, 1 << 28)])
def test_pages_come_back_in_global_order(spark, pages, rows, monkeypatch, fan, block, per_range, archive):
    """One pass and several, blocks of any size, ranges that cut the captures of one url, one record an archive."""
    for name, value in (("FAN", fan), ("BLOCK", block), ("BLOCKS_PER_RANGE", per_range), ("ARCHIVE", archive)):
        monkeypatch.setattr(warc, name, value)
    got, keys = order_of(warc.archive_pages(pages.repartition(7)))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == plain(rows)
    assert keys == sorted(keys)
    if per_range == 1 and block == 16:
        assert len({r["part"] for r in got if r["url_key"] == "example,hot)/"}) > 3


def test_small_payloads_are_all_responses(pages, rows):
    got, _ = order_of(warc.archive_pages(pages, at_least=20))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == plain(rows, 20)
    assert plain(rows, 20) != plain(rows)


def test_shared_payloads_beyond_a_broadcast(pages, rows, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    got, _ = order_of(warc.archive_pages(pages))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == plain(rows)


def test_archives_are_readable_by_anyone(spark, tmp_path, pages, rows):
    """Archives are sequences of gzip members that hold WARC records; a revisit stores no payload."""
    folder = f"file://{tmp_path}/w"
    warc.write_archives(pages.repartition(3), folder)
    text = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(Path(tmp_path, "w").glob("*.warc.gz")))
    assert text.count(b"WARC-Type: response") + text.count(b"WARC-Type: revisit") == len(rows) and text.count(b"version 1") == 1


def test_files_of_lost_attempts_are_not_read(spark, tmp_path, pages, rows):
    folder = f"file://{tmp_path}/w"
    blocks = warc.write_archives(pages.repartition(2), folder)
    (tmp_path / "w" / "stray.index").write_bytes(b"no index")
    (tmp_path / "w" / "stray-00000.warc.gz").write_bytes(b"no archive")
    assert warc.read_records(warc.capture_index(blocks, folder), folder).count() == len(rows)


def test_damaged_archives_are_not_passed_on(spark, tmp_path, pages, monkeypatch):
    folder = f"file://{tmp_path}/w"
    blocks = warc.write_archives(pages.coalesce(1), folder)
    path = next(Path(tmp_path, "w").glob("*.warc.gz"))
    data = bytearray(path.read_bytes())
    data[len(data) // 2] ^= 0xFF
    path.write_bytes(data)
    monkeypatch.setattr(warc, "WAIT", 0)
    with pytest.raises(Exception, match="zlib|Error"):
        warc.read_records(warc.capture_index(blocks, folder), folder).collect()


def test_runs_are_sorted_and_blocks_described(spark, tmp_path, pages, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 50)
    blocks = warc.write_archives(pages.repartition(3), f"file://{tmp_path}/w").orderBy("run", "nr").collect()
    assert sum(b["rows"] for b in blocks) == pages.count() and {b["nr"] for b in blocks if b["run"] == blocks[0]["run"]} == set(range(sum(b["run"] == blocks[0]["run"] for b in blocks)))
    for a, b in zip(blocks, blocks[1:]):
        assert json.loads(a["first"]) <= json.loads(a["last"]) and (a["run"] != b["run"] or json.loads(a["last"]) < json.loads(b["first"]))


def test_empty_tables_and_plain_columns(spark, pages):
    assert warc.archive_pages(pages.limit(0)).count() == 0
    got = warc.archive_pages(spark.createDataFrame([(1, "https://a.b/c", "x")], "page_id int, url string, html string")).collect()
    assert [(r["page_id"], r["stamp"], r["url_key"]) for r in got] == [(1, "19700101000000", "b,a)/c")]
