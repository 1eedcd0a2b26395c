"""The whole comparison as one plan: sequences to cores to signatures to distances to matrices and trees."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chunked import cores_of_pieces
from ..functions.lcp import both_strands, cores
from ..operators import distance, tree
from ..operators.signature import SET, checked_mode, signature
from ..session import logger
from ..sources.fasta_ranges import read_fasta_ranges
from ..sources.manifest import distinct_names, manifest
from ..sources.phylip import read_matrix, write_matrices
from ..sources.sequences import read_core_files, read_cores, read_fasta, read_fastq, write_core_files, write_cores


@dataclass(frozen=True)
class Run:
    """What a comparison needs to know; parallelism is Spark's business.

    ``paths`` lists an input for each genome. ``core_store`` is a folder for all genomes' cores; ``outputs`` lists a
    folder for each genome instead. Thresholds are numbers or lists, too. With ``window`` bases, FASTA is read by ranges of bytes and
    parsed by windows of that size, so that records of any length are dealt over tasks.
    """

    paths: str
    names: str | None = None
    level: int = 4
    min_cc: int | str | None = None
    max_cc: int | str | None = None
    mode: str = SET
    prefix: str = "gc"
    core_store: str | None = None
    outputs: str | None = None
    on_missing: str = "fail"
    verbose: bool = False
    window: int | None = None

    def __post_init__(self) -> None:
        checked_mode(self.mode)
        if self.level < 1:
            raise ValueError("the level starts at 1")


@dataclass(frozen=True)
class Comparison:
    genomes: DataFrame
    signature: DataFrame
    distances: DataFrame
    run: Run

    def matrix(self) -> DataFrame:
        return distance.square(self.distances, self.genomes)

    def write(self) -> list[str]:
        """Write the three matrices; returns their folders."""
        out = write_matrices(self.matrix(), self.genomes, self.run.prefix, self.run.mode, self.run.level)
        logger(self.run.verbose).info("wrote %s", ", ".join(out))
        return out


def _compare(run: Run, genomes: DataFrame, found: DataFrame, banded: bool) -> Comparison:
    bands = genomes.select("genome_idx", "min_cc", "max_cc") if banded else None
    # The signature feeds sizes and both sides of the core join; it is kept while they run.
    sig = signature(found, bands=bands).persist()
    dist = distance.distances(sig, mode=run.mode, genomes=genomes)
    logger(run.verbose).info("comparing cores of level %d, mode %s, band %s", run.level, run.mode, "on" if banded else "off")
    return Comparison(distinct_names(genomes), sig, dist, run)


def _stored(spark: SparkSession, found: DataFrame, genomes: DataFrame, run: Run) -> DataFrame:
    """``found``, by way of the store or stores that the run asks for."""
    leveled = found.withColumn("level", F.lit(run.level))
    if run.core_store:
        write_cores(leveled, run.core_store, "overwrite")
        leveled = read_cores(spark, run.core_store, run.level)
    if run.outputs:
        leveled = leveled.persist()  # written, then compared
        write_core_files(leveled, genomes)
    return leveled if run.core_store or run.outputs else found


def _manifest(spark: SparkSession, run: Run, reads: bool = False) -> DataFrame:
    return manifest(spark, run.paths, run.names, run.min_cc, run.max_cc, run.outputs, reads)


def from_fasta(spark: SparkSession, run: Run) -> Comparison:
    """Assembled genomes: forward strand; the band applies only if one is given."""
    genomes = _manifest(spark, run)
    if run.window:
        parsed = cores_of_pieces(read_fasta_ranges(spark, genomes, run.on_missing), run.level, run.window)
    else:
        parsed = cores(read_fasta(spark, genomes, run.on_missing), run.level)
    found = _stored(spark, parsed, genomes, run)
    return _compare(run, genomes, found, run.min_cc is not None or run.max_cc is not None)


def from_fastq(spark: SparkSession, run: Run) -> Comparison:
    """Sequencing reads: both strands; a band always applies, that of reads by default."""
    genomes = _manifest(spark, run, reads=True)
    found = _stored(spark, cores(both_strands(read_fastq(spark, genomes, run.on_missing)), run.level), genomes, run)
    return _compare(run, genomes, found, True)


def from_cores(spark: SparkSession, run: Run) -> Comparison:
    """Cores of an earlier run: from its store, or from the folder of each genome that ``paths`` lists."""
    genomes = manifest(spark, run.paths, run.names, run.min_cc, run.max_cc)
    found = read_cores(spark, run.core_store, run.level) if run.core_store else read_core_files(spark, genomes, run.on_missing, run.level)
    return _compare(run, genomes, found, run.min_cc is not None or run.max_cc is not None)


def tree_of(spark: SparkSession, path: str, method: str = "nj", normalize: bool = False, outgroup: str | None = None) -> str:
    """The Newick text of a PHYLIP matrix's tree."""
    return tree.to_newick(tree.tree(read_matrix(spark, path, normalize), method, outgroup))
