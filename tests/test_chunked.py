"""Records parsed by windows and files read by ranges, against whole records and whole files."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandmill.functions import chunked, lcp
from strandmill.plans import compare
from strandmill.sources import fasta_ranges as fr


def whole(seq, level):
    return sorted(zip(*(v.tolist() for v in lcp.parse(seq, level))))


LONG = st.lists(st.sampled_from(["A", "C", "G", "T", "N", "ACGT" * 3, "A" * 40, "AT" * 30, "ACCTG" * 12, "GATTACA"]), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(LONG, st.integers(1, 4), st.integers(0, 200), st.integers(1, 400))
def test_what_a_stretch_settles_is_right(seq, level, a, n):
    """Cores of a stretch are consecutive cores of the whole, whatever lies around it."""
    part = seq.replace("N", "")
    start, end, label = chunked.parse_open(lcp.coded(part[a : a + n].encode()), level, a == 0, a + n >= len(part))
    got, want = list(zip((start + a).tolist(), (end + a).tolist(), label.tolist())), whole(part, level)
    assert not got or got == want[want.index(got[0]) : want.index(got[0]) + len(got)]
    if a == 0 and a + n >= len(part):
        assert got == want


@settings(max_examples=200, deadline=None)
@given(LONG, st.integers(1, 4), st.integers(1, 90), st.integers(1, 60))
def test_windows_add_up_to_the_record(seq, level, size, halo):
    got = []
    for low in range(0, len(seq), size):
        reach = halo
        while True:
            a, b = max(0, low - reach), min(len(seq), low + size + reach)
            found = chunked.parse_window(seq[a:b], level, low - a, min(low + size, len(seq)) - a, a == 0, b == len(seq))
            if found is not None:
                got += [(s + a, e + a, x) for s, e, x in zip(*(v.tolist() for v in found))]
                break
            assert a or b < len(seq)
            reach *= 2
    assert got == whole(seq, level)


def sequences():
    rng = random.Random(7)
    free = "".join(rng.choice("ACGT") for _ in range(3000))
    return [(1, "free", free), (1, "runs", "A" * 2500 + free[:400] + "C" * 900), (2, "repeats", "ACGTTGCA" * 300 + free[:50] + "AT" * 700), (2, "gaps", free[:500] + "N" * 700 + free[500:530] + "nn" + free[530:900].lower()), (2, None, free[:77]), (None, "x", "ACCT"), (3, "short", "AC"), (3, "none", None), (3, "empty", "")]


@pytest.mark.parametrize("level, size, halo, pieces", [(1, 64, 1, 64), (4, 256, 16, 100), (3, 1000, 4096, 7000), (2, 37, 300, 37)])
def test_cores_of_pieces_are_those_of_records(spark, level, size, halo, pieces):
    df = spark.createDataFrame(sequences(), "genome_idx int, record string, seq string")
    got = chunked.cores_of_pieces(chunked.pieces_of(df, pieces), level, size, halo)
    want = lcp.cores(df, level)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_no_window_holds_a_record_and_few_need_more_rounds(spark):
    df = spark.createDataFrame(sequences()[:1], "genome_idx int, record string, seq string")
    windows = chunked.windows_of(chunked.pieces_of(df, 100), 100, 150).collect()
    assert len(windows) == 30 and max(len(w["bases"]) for w in windows) == 400
    assert all(sequences()[0][2][w["begins"] : w["begins"] + len(w["bases"])] == w["bases"] for w in windows)
    assert chunked.cores_of_pieces(chunked.pieces_of(df.limit(0)), 2).count() == 0
    with pytest.raises(ValueError):
        chunked.cores_of_pieces(chunked.pieces_of(df), 0)


def plain_records(data):
    """(record, bases) of a FASTA file's text, line by line."""
    records = [[]]
    for line in data.split(b"\n"):
        if line.startswith(b">"):
            records.append([])
        else:
            records[-1].append(line)
    return {k: s for k, r in enumerate(records) if (s := re.sub(rb"\s", b"", b"".join(r)).decode())}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([b"ACGT", b"\n", b">", b">head ACGT\n", b"\r\n", b" ", b"A" * 9, b">x"]), max_size=30).map(b"".join), st.integers(1, 12))
def test_ranges_hold_all_that_a_file_has(data, split):
    """What the ranges tell, put together in order by hand."""
    record, state, got = 0, False, {}
    for start in range(0, len(data), split):
        part = data[start : start + split]
        lead, records, header = fr.stretches_of(part, start == 0 or data[start - 1 : start] == b"\n")
        got[record] = got.get(record, b"") + (b"" if state else lead) + records[0]
        for bases in records[1:]:
            record += 1
            got[record] = got.get(record, b"") + bases
        state = state if header is None else header
    assert {k: v.decode() for k, v in got.items() if v} == plain_records(data)


def files(spark, tmp_path):
    rng = random.Random(4)
    made = {}
    for k in range(6):
        out = b"" if k % 2 else b"TTT\nGG\n"
        for r in range(rng.randrange(1, 6)):
            out += b">" + b"h" * rng.randrange(60) + b"\n"
            bases = "".join(rng.choice("ACGT") for _ in range(rng.randrange(300))).encode()
            width = rng.choice([7, 60, 10_000])
            out += b"\n".join(bases[a : a + width] for a in range(0, len(bases), width)) + rng.choice([b"\n", b"\r\n", b"\n\n"])
        (tmp_path / f"g{k}.fa").write_bytes(out if k else b"")
        made[k] = plain_records(out if k else b"")
    manifest = spark.createDataFrame([(k, str(tmp_path / f"g{k}.fa")) for k in made], "genome_idx int, in_path string")
    return manifest, {(k, r): s for k, x in made.items() for r, s in x.items()}


@pytest.mark.parametrize("split, few", [(31, 200_000), (100, 0), (1 << 20, 200_000)])
def test_files_by_ranges(spark, tmp_path, monkeypatch, split, few):
    manifest, want = files(spark, tmp_path)
    monkeypatch.setattr(fr, "FEW_RANGES", few)
    rows = fr.read_fasta_ranges(spark, manifest, split=split).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["genome_idx"], r["record_idx"], r["at"])):
        key = r["genome_idx"], r["record_idx"]
        assert r["at"] == len(got.get(key, "")) and r["length"] == len(want[key])
        got[key] = got.get(key, "") + r["part"]
    assert got == want


def test_one_record_is_read_by_several_tasks(spark, tmp_path):
    rng = np.random.default_rng(1)
    seq = "".join("ACGT"[k] for k in rng.integers(0, 4, 50_000))
    (tmp_path / "one.fa").write_text(">one\n" + seq)
    manifest = spark.createDataFrame([(0, str(tmp_path / "one.fa"))], "genome_idx int, in_path string")
    found = fr.read_fasta_ranges(spark, manifest, split=10_000)
    assert found.rdd.getNumPartitions() >= 5 and found.count() >= 5 and {(r["record_idx"], r["length"]) for r in found.collect()} == {(1, 50_000)}
    got = chunked.cores_of_pieces(found, 3, 4000, 500).drop("genome_idx", "record_idx")
    assert sorted(map(tuple, got.drop("len").collect())) == whole(seq, 3)


def test_missing_files_and_a_run_by_windows(spark, tmp_path):
    gone = spark.createDataFrame([(0, str(tmp_path / "gone.fa"))], "genome_idx int, in_path string")
    with pytest.raises(FileNotFoundError):
        fr.read_fasta_ranges(spark, gone)
    assert fr.read_fasta_ranges(spark, gone, "empty").count() == 0
    manifest, _ = files(spark, tmp_path)
    (tmp_path / "list").write_text("\n".join(str(tmp_path / f"g{k}.fa") for k in range(1, 6)))
    runs = [compare.from_fasta(spark, compare.Run(str(tmp_path / "list"), level=2, window=w)) for w in (None, 64)]
    assert sorted(map(str, runs[0].distances.collect())) == sorted(map(str, runs[1].distances.collect()))


def test_tasks_are_bounded_and_their_ranges_are_the_same(tmp_path):
    """Short ranges of a long file were a task each, thousands of which the driver held."""
    data = b"".join(b">r%d\n%s\n" % (k, b"ACGT" * (k % 90)) for k in range(2000))
    (tmp_path / "long.fa").write_bytes(data)
    reader = fr._Ranges([str(tmp_path / "long.fa")], 31, False)
    tasks = reader.partitions()
    assert len(tasks) <= fr.TASKS < len(data) // 31
    rows = [r for t in tasks for b in reader.read(t) for r in b.to_pylist()]
    apart = [fr._Bytes(t.path, t.file, a // 31, a, min(a + 31, t.end)) for t in tasks for a in range(t.start, t.end, 31)]
    assert rows == [r for t in apart for b in reader.read(t) for r in b.to_pylist()]


def test_windows_are_parsed_together(monkeypatch):
    rng = random.Random(12)
    seq = "".join(rng.choice("ACGT" if k // 50 % 7 else "AN") for k in range(4000))
    spans = [(max(0, low - 40), low, min(low + 100, 4000), min(4000, low + 140)) for low in range(0, 4000, 100)]
    calls, plain = [], chunked.parse_many
    monkeypatch.setattr(chunked, "parse_many", lambda *a, **k: calls.append(1) or plain(*a, **k))
    at = np.array([a for a, *_ in spans])
    low, high = np.array([x[1] for x in spans]) - at, np.array([x[2] for x in spans]) - at
    window, start, end, label, is_open = chunked.parse_windows([seq[a:b] for a, _, _, b in spans], 3, low, high, at == 0, np.array([b == 4000 for *_, b in spans]))
    assert len(calls) == 1
    for k, (a, lo, hi, b) in enumerate(spans):
        one = chunked.parse_window(seq[a:b], 3, lo - a, hi - a, a == 0, b == 4000)
        mine = window == k
        assert (one is None) == is_open[k] and (one is None or all(np.array_equal(x, y[mine]) for x, y in zip(one, (start, end, label))))
