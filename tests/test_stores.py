"""Blocked gzip, bucketed stores of signatures, sketches, and matrices read by lines."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from strandmill.operators import distance, sketch
from strandmill.operators.signature import signature
from strandmill.sources import bgzf, core_table, phylip, sequences


def blocked(text, size):
    return b"".join(bgzf.block_of(text[a : a + size]) for a in range(0, len(text), size)) + bgzf.END


@pytest.mark.parametrize("size", [1, 7, 100, bgzf.BLOCK])
def test_blocks_are_gzip(size):
    text = (b"some text \x1f\x8b\x08\x04\n" * 300)[:3000]
    data = blocked(text, size)
    assert gzip.decompress(data) == text
    at, seen = 0, 0
    while at < len(data):
        at, seen = at + bgzf.block_size(data[at : at + bgzf.HEADER]), seen + 1
    assert at == len(data) and seen == -(-len(text) // size) + 1


def test_blocks_are_found_from_anywhere():
    rng = random.Random(1)
    noise = bytes(rng.randrange(256) for _ in range(5000)) + bgzf.MAGIC * 40 + bgzf.MAGIC + b"\0" * 6 + b"\x06\0" + bgzf.FIELD + b"\x10\0"
    data = blocked(noise, 900)
    starts, at = [], 0
    while at < len(data):
        starts.append(at)
        at += bgzf.block_size(data[at : at + bgzf.HEADER])
    read = lambda n, a: data[a : a + n]
    for a in range(0, len(data), 13):
        assert bgzf.first_block(read, a, len(data)) == next((s for s in starts if s >= a), len(data))


@pytest.mark.parametrize("split, size", [(40, 11), (300, 64), (97, 500), (1 << 20, 100)])
def test_lines_by_ranges(spark, tmp_path, split, size):
    rng = random.Random(split)
    texts = {"a": "".join("x" * rng.randrange(90) + "\n" for _ in range(60)), "b": "one line without an end", "c": "", "d": "\n\n\n" + "long " * 300 + "\nend\n"}
    for name, text in texts.items():
        (tmp_path / f"{name}.gz").write_bytes(blocked(text.encode(), size))
    found = bgzf.read_blocked(spark, [str(tmp_path / f"{n}.gz") for n in texts], split)
    got = {}
    for r in sorted(found.withColumn("id", F.monotonically_increasing_id()).collect(), key=lambda r: (r["path"], r["at"], r["id"])):
        got.setdefault(r["path"].rsplit("/", 1)[1][0], []).append(r["value"])
    assert got == {n: t.split("\n")[: -1 if t.endswith("\n") else None] for n, t in texts.items() if t}
    if split == 40:
        assert found.where(F.col("path").endswith("a.gz")).select("at").distinct().count() > 3


def test_damaged_blocks_raise(spark, tmp_path):
    data = bytearray(blocked(b"text\n" * 100, 100))
    data[30] ^= 0xFF
    (tmp_path / "x.gz").write_bytes(bytes(data))
    with pytest.raises(Exception, match="damaged gzip block|zlib|error"):
        bgzf.read_blocked(spark, [str(tmp_path / "x.gz")]).collect()


def test_reads_of_all_kinds_of_files(spark, tmp_path):
    rng, want = random.Random(3), []
    for g, name in enumerate(("p.fq", "g.fq.gz", "b.fq.gz")):
        reads = ["".join(rng.choices("ACGT", k=rng.randrange(1, 60))) for _ in range(80)]
        text = "".join(f"@r\n{x}\n+\n{'I' * len(x)}\n" for x in reads).encode()
        (tmp_path / name).write_bytes(text if g == 0 else gzip.compress(text) if g == 1 else blocked(text, 333))
        want += [(g, k, x) for k, x in enumerate(reads)]
    assert [bgzf.is_blocked(str(tmp_path / n)) for n in ("g.fq.gz", "b.fq.gz")] == [False, True]
    man = spark.createDataFrame([(g, str(tmp_path / n)) for g, n in enumerate(("p.fq", "g.fq.gz", "b.fq.gz"))], "genome_idx int, in_path string")
    for split in (200, 1 << 20):
        assert sorted(map(tuple, sequences.read_fastq(spark, man, split=split).collect())) == want


def random_signature(spark, genomes=6, n=400):
    rng = random.Random(8)
    return signature(spark.createDataFrame([(g, rng.randrange(600) * 10**15, rng.randrange(3, 5)) for g in range(genomes) for _ in range(n)], "genome_idx int, label long, len int"))


def test_stored_genomes_are_compared_without_an_exchange(spark, tmp_path):
    sig, path = random_signature(spark), str(tmp_path / "store")
    core_table.write_signatures(sig.where("genome_idx < 3"), path, 5)
    core_table.write_signatures(sig.where("genome_idx >= 3"), path, 5)
    found = core_table.read_signatures(spark, path)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, sig.collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = distance.intersections(found, n_genomes=6)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    join = plan[plan.index("SortMergeJoin") :]
    assert "Exchange" not in join and plan.count("Exchange hashpartitioning(i") == 1
    assert sorted(map(tuple, distance.distances(found).collect())) == sorted(map(tuple, distance.distances(sig).collect()))
    with pytest.raises(ValueError):
        core_table.read_signatures(spark, str(tmp_path))


def test_a_sketch_that_holds_all_is_exact(spark):
    sig = random_signature(spark)
    want = {(r["i"], r["j"]): r["jaccard"] for r in distance.distances(sig).collect()}
    got = {(r["i"], r["j"]): r for r in sketch.estimates(sketch.sketches(sig, 5000), 5000).collect()}
    assert {k: r["jaccard"] for k, r in got.items()} == pytest.approx(want)


def test_sketches_of_parts_merge_and_estimate(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(g, rng.randrange(3000) if g < 4 else 10_000 + g, 1) for g in range(6) for _ in range(2500)]
    sig = spark.createDataFrame(rows, "genome_idx int, item int, cnt int").distinct()
    whole = sketch.sketches(sig, 300, ("item",))
    parts = [sketch.sketches(sig.where(f"item % 3 = {k} or item % 7 = 0"), 300, ("item",)) for k in range(3)]
    together = sketch.merged(parts[0].unionByName(parts[1]).unionByName(parts[2]), 300)
    assert sorted(map(str, together.collect())) == sorted(map(str, whole.collect()))
    exact = {(r["i"], r["j"]): r["jaccard"] for r in distance.distances(sig, ("item",), length=None).collect()}
    one = {(r["i"], r["j"]): r for r in sketch.estimates(whole, 300).collect()}
    assert one.keys() == exact.keys() and all(abs(r["jaccard"] - exact[k]) < 0.12 for k, r in one.items()) and one[0, 5]["jaccard"] == 1
    monkeypatch.setattr(sketch, "BLOCK", 2)
    assert {(r["i"], r["j"]): r for r in sketch.estimates(whole, 300).collect()} == one
    with pytest.raises(ValueError):
        sketch.sketches(sig, 0)


def test_a_matrix_in_many_blocks(spark, tmp_path):
    n = 40
    rng = random.Random(6)
    d = {(i, j): rng.random() for i in range(n) for j in range(i)}
    cell = lambda i, j: 0.0 if i == j else d[max(i, j), min(i, j)]
    text = f"{n}\r\n" + "".join(f"{f'g{i}':>10}" + "".join(f" {cell(i, j):.15f}" for j in range(n)) + "\r\n" for i in range(n)) + "\n"
    (tmp_path / "m.phy").write_text(text, newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2000)
    try:
        got = phylip.read_matrix(spark, str(tmp_path / "m.phy")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {(r["i"], r["j"]): r["d"] for r in got} == pytest.approx({(i, j): cell(i, j) for i in range(n) for j in range(i + 1)}, abs=1e-14)
    assert all(r["name_i"] == f"g{r['i']}" and r["name_j"] == f"g{r['j']}" for r in got)


def test_large_sketches_are_joined_as_rows(spark):
    """Of two genomes of 60,000 elements the exact numbers, whether or not the union is within k; in arrays each element met each other."""
    sig = spark.range(60_000).selectExpr("explode(array(named_struct('g', 0, 'item', id), named_struct('g', 1, 'item', id + 20000))) as e").selectExpr("e.g as genome_idx", "e.item as item", "1 as cnt")
    whole = sketch.estimates(sketch.least(sig, 1 << 30, ("item",)), 1 << 30).first()
    assert (whole["shared"], whole["drawn"]) == (40_000, 80_000)
    k = 30_000
    rows = sketch.least(sig, k, ("item",))
    assert [r["count"] for r in rows.groupBy("genome_idx").count().collect()] == [k, k]
    mine = {g: {r["item"] for r in sig.where(f"genome_idx = {g}").collect()} for g in (0, 1)}
    hashed = {r["item"]: r["h"] for r in sig.select("item", F.xxhash64("item").alias("h")).distinct().collect()}
    union = sorted(hashed, key=hashed.get)[:k]
    found = sketch.estimates(rows, k).first()
    assert (found["shared"], found["drawn"]) == (sum(x in mine[0] and x in mine[1] for x in union), k)
