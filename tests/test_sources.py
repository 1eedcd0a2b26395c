import gzip
import random

import pytest

from strandmill.plans import compare
from strandmill.sources import manifest as m
from strandmill.sources import phylip, sequences


def write(path, text, compress=False):
    (gzip.open(path, "wt") if compress else open(path, "w", newline="")).write(text)
    return str(path)


def test_manifest_and_side_files(spark, tmp_path):
    paths = write(tmp_path / "g.txt", "/a/first.fa\r\n/a/second.fa")
    low = write(tmp_path / "lo.txt", "5\n4294967295\n")
    rows = m.manifest(spark, paths, min_cc=low, max_cc=4294967295).orderBy("genome_idx").collect()
    assert [(r["genome_idx"], r["in_path"], r["short_name"], r["min_cc"]) for r in rows] == [(0, "/a/first.fa", "/a/first.f", 5), (1, "/a/second.fa", "/a/second.", 4294967295)]
    names = write(tmp_path / "n.txt", "one\na name of more than ten\n")
    assert [r["short_name"] for r in m.manifest(spark, paths, names).orderBy("genome_idx").collect()] == ["one", "a name of "]
    with pytest.raises(ValueError):
        m.manifest(spark, paths, min_cc=write(tmp_path / "short.txt", "5\n"))
    with pytest.raises(ValueError):
        m.manifest(spark, paths, min_cc=write(tmp_path / "bad.txt", "5\n-1\n"))
    assert {(r["min_cc"], r["max_cc"]) for r in m.manifest(spark, paths, reads=True).collect()} == {m.READ_BAND}


def test_distinct_names(spark):
    df = spark.createDataFrame([(0, "/path/to/g"), (1, "/path/to/g"), (2, "x")], "genome_idx int, short_name string")
    got = [r["short_name"] for r in m.distinct_names(df).orderBy("genome_idx").collect()]
    assert len(set(got)) == 3 and all(len(x) <= 10 for x in got) and got[2] == "x"


def test_fasta(spark, tmp_path):
    a = write(tmp_path / "a.fa", "ACGT\nAC\n>one\r\nGG\r\nTT\r\n>" + "h" * 3000 + "\nCCC\n>empty\n>two > three\nAAA")
    b = write(tmp_path / "b.fa", ">only\nTTTT\n")
    man = m.manifest(spark, write(tmp_path / "g.txt", f"{a}\n{b}\n"))
    rows = sequences.read_fasta(spark, man).orderBy("genome_idx", "record_idx").collect()
    assert [(r["genome_idx"], r["seq"]) for r in rows] == [(0, "ACGTAC"), (0, "GGTT"), (0, "CCC"), (0, "AAA"), (1, "TTTT")]


def test_missing_files(spark, tmp_path):
    man = m.manifest(spark, write(tmp_path / "g.txt", str(tmp_path / "none.fa")))
    with pytest.raises(FileNotFoundError):
        sequences.read_fasta(spark, man)
    assert sequences.read_fasta(spark, man, "empty").count() == 0


@pytest.mark.parametrize("size, rows, few", [(97, 3, 1000), (400, 1, 1000), (1 << 20, 10_000, 1000), (150, 5, 2)])
def test_fastq_reads_across_blocks(spark, tmp_path, monkeypatch, size, rows, few):
    """Files cut anywhere, and lines that come in batches of any size, give the reads in order."""
    monkeypatch.setattr(sequences, "FEW_BLOCKS", few)
    rng, want = random.Random(size), []
    for g in range(3):
        reads = ["".join(rng.choices("ACGT", k=rng.randrange(1, 40))) for _ in range(50)]
        want += [(g, k, x) for k, x in enumerate(reads)]
        (tmp_path / f"{g}.fq").write_text("".join(f"@r{k}\n{x}\n+\n{'@' * len(x)}\n" for k, x in enumerate(reads)).replace("\n", "\r\n" if g == 1 else "\n"))
    man = spark.createDataFrame([(g, str(tmp_path / f"{g}.fq")) for g in range(3)], "genome_idx int, in_path string")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        assert sorted(map(tuple, sequences.read_fastq(spark, man).collect())) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_fastq(spark, tmp_path):
    text = "@r1\nACGT\n+\nIIII\n@r2\nGG\n+r2\n@+\n"
    a, b = write(tmp_path / "a.fq", text), write(tmp_path / "b.fq.gz", text.replace("GG", "TT"), True)
    man = m.manifest(spark, write(tmp_path / "g.txt", f"{a}\n{b}\n"))
    rows = sequences.read_fastq(spark, man).orderBy("genome_idx", "record_idx").collect()
    assert [tuple(r) for r in rows] == [(0, 0, "ACGT"), (0, 1, "GG"), (1, 0, "ACGT"), (1, 1, "TT")]
    bad = m.manifest(spark, write(tmp_path / "h.txt", write(tmp_path / "c.fq", "@r1\nACGT\n+\n")))
    with pytest.raises(Exception, match="malformed read 0"):
        sequences.read_fastq(spark, bad).collect()


def test_matrix_text(spark, tmp_path):
    matrix = spark.createDataFrame([(0, 0, 0.0), (0, 1, 0.5), (1, 0, 0.5), (1, 1, 0.0), (0, 2, None), (2, 0, None), (1, 2, 0.25), (2, 1, 0.25), (2, 2, 0.0)], "i int, j int, dice double")
    names = spark.createDataFrame([(0, "a"), (1, "long names"), (2, "c")], "genome_idx int, short_name string")
    lines = [r["line"] for r in phylip.matrix_lines(matrix, names, "dice").orderBy("nr").collect()]
    assert lines[0] == "3" and lines[1] == "         a 0.000000000000000 0.500000000000000 nan"
    path = write(tmp_path / "x.phy", "\n".join(lines) + "\n")
    low = {(r["i"], r["j"]): r["d"] for r in phylip.read_matrix(spark, path, normalize=True).collect()}
    assert low == {(0, 0): 0, (1, 0): 1, (1, 1): 0, (2, 0): None, (2, 1): 0.5, (2, 2): 0}
    with pytest.raises(ValueError):
        phylip.read_matrix(spark, write(tmp_path / "y.phy", "1\n         a 0.0\n"), normalize=True)
    assert phylip.file_name("gc", "set", "jaccard", 4) == "gc.set.jaccard.lvl4.phy"


def test_command_line(spark, tmp_path, capsys):
    from strandmill.__main__ import main

    text = ["ACCTGACCATTGCAGGTCCATTACG" * 4, "ACCTGACCATTGCAGGTCCATTACG" * 3 + "TTGGA", "TTGACCGATACCAGTGGGCATTCCA" * 4]
    files = [write(tmp_path / f"{k}.fq", f"@r\n{x}\n+\n{'I' * len(x)}\n") for k, x in enumerate(text)]
    paths, names, prefix = write(tmp_path / "g.txt", "\n".join(files)), write(tmp_path / "n.txt", "a\nb\nc"), str(tmp_path / "x")
    main(["fq", "-i", paths, "-s", names, "-p", prefix, "-l", "1", "--vec", "--min-cc", "1"])
    assert f"{prefix}.vec.jc.lvl1.phy" in capsys.readouterr().out
    main(["tree", f"{prefix}.vec.dice.lvl1.phy", "--upgma", "--normalize"])
    tree = capsys.readouterr().out
    assert tree.startswith("((a:") and (tmp_path / "x.vec.dice.lvl1.upgma.newick").read_text() == tree
    for bad in (["fq"], ["tree", "x.txt"], ["fa", "-i", paths, "-l", "0"], ["fa", "-i", paths, "--min-cc", "-3"]):
        with pytest.raises((SystemExit, ValueError)):
            main(bad)


def test_end_to_end(spark, tmp_path):
    import random

    rng = random.Random(1)
    base = "".join(rng.choice("ACGT") for _ in range(2000))
    edit = lambda s, k: "".join(rng.choice("ACGT") if rng.random() < k else c for c in s)
    files = [write(tmp_path / f"{k}.fa", f">x\n{s}\n") for k, s in enumerate([base, edit(base, 0.02), edit(base, 0.3), edit(base, 0.3)])]
    run = compare.Run(write(tmp_path / "g.txt", "\n".join(files)), names=write(tmp_path / "n.txt", "a\nb\nc\nd"), level=2, prefix=str(tmp_path / "gc"), core_store=str(tmp_path / "store"))
    done = compare.from_fasta(spark, run)
    first = {(r["i"], r["j"]): r["jaccard"] for r in done.distances.collect()}
    assert first[0, 1] < min(v for k, v in first.items() if k != (0, 1))
    again = compare.from_cores(spark, run)
    assert {(r["i"], r["j"]): r["jaccard"] for r in again.distances.collect()} == first
    outputs = write(tmp_path / "o.txt", "\n".join(str(tmp_path / f"cores{k}") for k in range(4)))
    compare.from_fasta(spark, compare.Run(run.paths, level=2, outputs=outputs))
    listed = compare.from_cores(spark, compare.Run(outputs, level=2))
    assert {(r["i"], r["j"]): r["jaccard"] for r in listed.distances.collect()} == first
    out = done.write()
    assert out[1].endswith("gc.set.jaccard.lvl2.phy")
    for method in ("nj", "upgma"):
        assert "a:" in compare.tree_of(spark, out[1], method)
    with pytest.raises(ValueError):
        compare.Run("x", level=0)
