import hashlib
import os
import zipfile
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandmill.llm import media
from strandmill.llm.queries import QUERIES
from strandmill.session import table


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=500))
def test_png_round_trip(data):
    payload = media.padded(data)
    assert len(payload) % 64 == 0 and payload and payload[: len(data)] == data and not any(payload[len(data) :])
    assert media.decode_png(media.encode_png(payload)) == payload


def test_damage_is_noticed():
    png = bytearray(media.encode_png(media.padded(b"x" * 1000)))
    png[60] ^= 1
    with pytest.raises(ValueError):
        media.decode_png(bytes(png))
    with pytest.raises(ValueError):
        media.decode_png(b"GIF89a")


def archives(spark, tmp_path, monkeypatch, n=400):
    docs = spark.createDataFrame([(k, f"text {k} " * (k % 50)) for k in range(n)], "doc_id long, text string").repartition(3)
    folder = f"file://{tmp_path}/media"
    media.write_media(docs, folder)
    return docs, folder


def test_ranges_cover_each_member_once(spark, tmp_path, monkeypatch):
    _, folder = archives(spark, tmp_path, monkeypatch)
    for split in (1000, 10**9):
        got = media.read_media(spark, folder, split=split)
        assert sorted(r["doc_id"] for r in got.collect()) == list(range(400))
    assert got.rdd.getNumPartitions() < media.read_media(spark, folder, split=1000).rdd.getNumPartitions()


def test_archives_of_lost_attempts_are_not_read(spark, tmp_path, monkeypatch):
    _, folder = archives(spark, tmp_path, monkeypatch, 10)
    with zipfile.ZipFile(tmp_path / "media" / "stray.zip", "w") as z:
        z.writestr("0/99/1.png", media.encode_png(media.padded(b"x")))
    assert media.read_media(spark, folder).count() == 10


def test_members_are_retried_by_offset(spark, tmp_path, monkeypatch):
    _, folder = archives(spark, tmp_path, monkeypatch, 30)
    monkeypatch.setattr(media, "WAIT", 0)
    real, failed = zipfile.ZipFile.read, set()

    def flaky(self, member, *more):
        if member.header_offset not in failed:
            failed.add(member.header_offset)
            raise OSError("connection reset")
        return real(self, member, *more)

    monkeypatch.setattr(zipfile.ZipFile, "read", flaky)
    reader = media._Reader(folder, media.SPLIT, 1)
    rows = sum(batch.num_rows for part in reader.partitions() for batch in reader.read(part))
    assert rows == 30 and failed
    failed.clear()
    with pytest.raises(OSError):
        list(media._Reader(folder, media.SPLIT, 0).read(reader.partitions()[0]))


def test_damaged_members_are_not_passed_on(spark, tmp_path, monkeypatch):
    _, folder = archives(spark, tmp_path, monkeypatch, 5)
    path = next(p for p in (tmp_path / "media").iterdir() if p.suffix == ".zip" and os.path.getsize(p) > 60)
    data = bytearray(path.read_bytes())
    data[60] ^= 0xFF
    path.write_bytes(data)
    monkeypatch.setattr(media, "WAIT", 0)
    reader = media._Reader(folder, media.SPLIT, 1)
    with pytest.raises(zipfile.BadZipFile):
        [list(reader.read(p)) for p in reader.partitions()]


def test_query_against_plain_python(spark, sf_dir):
    """Every row of the query, from the text alone."""
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    got = QUERIES["op6_media"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b"\0" * (max(1, -(-len(raw) // 64)) * 64 - len(raw))
        image = media.encode_png(payload)
        mean = sum(payload) / len(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest())
        assert r["feature"].startswith(f"lines={len(payload) // 64};mean={mean:.4f};") and r["feature"].endswith(f"values={len(set(payload))}")


def test_many_archives_are_planned_in_larger_ranges(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(k, "text " * 200 * k) for k in range(60)], "doc_id long, text string")
    media.write_media(docs.repartition(3), str(tmp_path))
    monkeypatch.setattr(media, "MOST_RANGES", 4)
    reader = media._Reader(str(tmp_path), 100, 0)
    ranges = reader.partitions()
    assert len(ranges) <= 2 * 4 + 1 and sum(b.num_rows for r in ranges for b in reader.read(r)) == 60


def test_small_archives_share_a_task_and_openings_are_retried(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(90)], "doc_id long, text string")
    media.write_media(docs.repartition(30), str(tmp_path))
    reader = media._Reader(str(tmp_path), 1 << 20, 1)
    assert len(list(tmp_path.glob("*.zip"))) >= 20 and len(reader.partitions()) == 1
    monkeypatch.setattr(media, "WAIT", 0)
    real, seen = zipfile.ZipFile.__init__, []

    def flaky(self, file, *more, **how):
        seen.append(file)
        if len(seen) % 2:
            raise OSError("connection reset")
        real(self, file, *more, **how)

    monkeypatch.setattr(zipfile.ZipFile, "__init__", flaky)
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 90 and len(seen) > 30
    with pytest.raises(OSError):
        list(media._Reader(str(tmp_path), 1 << 20, 0).read(reader.partitions()[0]))
