"""Bottom-k sketches of signatures: an opt-in estimate of Jaccard similarity where exact joins of all cores cost too much.

A sketch is the k elements of least hash. It is a sample that does not depend on the genome, so sketches of parts merge into that of the whole, and the k least of
two sketches' union are those of the genomes' union. The share of them that both genomes have estimates Jaccard similarity, with a standard error of
sqrt(J (1 - J) / k) about; where k is no less than the union, it is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .distance import BLOCK, all_pairs, shared

K = 1024
#: Bits of a hash that are left out of the range it falls into; elements are counted by range.
LOW_BITS = 52


def _ranked(rows: DataFrame, genome: str, k: int) -> DataFrame:
    """``rows(genome, e)`` of distinct elements, those of the k least of each genome, with their ``rank`` from 1. Elements are counted by ranges of their hash; the counts of
    the ranges before give each range its first rank, so a genome's elements are sorted by ranges and over many tasks, and only as far as k."""
    top = F.shiftright(F.col("e")["h"], LOW_BITS)
    rows = rows.withColumn("_t", top)
    counts = rows.groupBy(F.col(genome).alias("_g"), F.col("_t").alias("_r")).agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("_g").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stored(counts.withColumn("_b", before).where(F.col("_b") < k), "ranges")
    placed = rows.join(starts, F.col(genome).eqNullSafe(F.col("_g")) & (F.col("_t") == F.col("_r")))
    return placed.select(genome, "e", (F.row_number().over(Window.partitionBy(genome, "_t").orderBy("e")) + F.col("_b")).alias("rank")).where(F.col("rank") <= k)


def _largest(rows: DataFrame, genome: str, of: int = 1) -> int:
    """The sum of the ``of`` greatest numbers of elements that a genome has."""
    return sum(r[0] for r in rows.groupBy(genome).count().select("count").orderBy(F.desc("count")).limit(of).collect())


def least(sig: DataFrame, k: int = K, element: tuple[str, ...] = ("label", "len"), genome: str = "genome_idx") -> DataFrame:
    """(genome, e): the k distinct elements of least hash of each genome, a row each; ``e`` is the hash ``h`` and the element's columns. A signature's first column is
    taken as its hash if it is one already (labels of cores are), else it is hashed. ``sig`` is read twice or more: it should be stored or persisted."""
    if k < 1:
        raise ValueError("a sketch holds one element at least")
    hashed: Column = F.col(element[0]) if element[0] == "label" else F.xxhash64(*element)
    rows = sig.select(genome, F.struct(hashed.alias("h"), *element).alias("e"))
    return rows if _largest(rows, genome) <= k else _ranked(rows, genome, k).drop("rank")


def _gathered(rows: DataFrame, genome: str) -> DataFrame:
    return rows.groupBy(genome).agg(F.array_sort(F.collect_list("e")).alias("least"))


def sketches(sig: DataFrame, k: int = K, element: tuple[str, ...] = ("label", "len"), genome: str = "genome_idx") -> DataFrame:
    """(genome, least): a row for each genome with the array of its ``least`` elements, ascending. For k of a few thousand at most; larger ones stay rows."""
    return _gathered(least(sig, k, element, genome), genome)


def merged(parts: DataFrame, k: int = K, genome: str = "genome_idx") -> DataFrame:
    """The sketch of each genome from those of its parts, ``parts(genome, least)``; parts may share elements."""
    rows = stored(parts.select(genome, F.explode("least").alias("e")).distinct(), "parts")
    return _gathered(_ranked(rows, genome, k), genome)


def estimates(found: DataFrame, k: int = K, genome: str = "genome_idx") -> DataFrame:
    """(i, j, shared, drawn, jaccard) for i < j: of the ``drawn`` least elements of both genomes' union, how many both have, and the estimated Jaccard
    distance. ``found`` has a row for each element, as ``least`` gives them, or for each genome, as ``sketches`` does.

    Elements that two genomes share come from an equi-join, not from arrays of whole sketches. If the union has no more than k, they all count. Else an element counts
    if its rank in the union is within k: that is the sum of its ranks in both, less those of the shared ones up to it, which both have counted.
    """
    rows = found.select(genome, F.explode("least").alias("e")) if "least" in found.columns else found.select(genome, "e")
    rows = stored(rows, "sketches")
    kind = rows.schema["e"].dataType
    flat = [F.col("e")[c].alias(f"e{x}") for x, c in enumerate(kind.names)]
    element = tuple(f"e{x}" for x in range(len(kind.names)))
    per = rows.groupBy(genome).agg(F.count("*").alias("n"), F.lit(None).cast("long").alias("t"))
    n = per.count()
    plain = rows.select(genome, *flat, F.lit(1).alias("cnt"))
    both = shared(plain, element, genome, "cnt", n, BLOCK).groupBy("i", "j").agg(F.count("*").alias("both"))
    pairs = all_pairs(per, n, BLOCK).join(both, ["i", "j"], "left").na.fill({"both": 0}).select("i", "j", "both", (F.col("na") + F.col("nb") - F.col("both")).alias("uni"))
    if _largest(rows, genome, 2) <= k:
        counted = pairs.select("i", "j", F.col("both").alias("shared"), F.col("uni").alias("drawn"))
    else:
        pairs = stored(pairs, "unions")
        ranked = _ranked(rows, genome, k).select(genome, *flat, "rank")
        met = shared(stored(ranked, "ranks"), element, genome, "rank", n, BLOCK).join(pairs.where(F.col("uni") > k).select("i", "j"), ["i", "j"])
        so_far = F.row_number().over(Window.partitionBy("i", "j").orderBy(*element))
        near = met.select("i", "j", (F.col("ca") + F.col("cb") - so_far).alias("at")).where(F.col("at") <= k).groupBy("i", "j").agg(F.count("*").alias("near"))
        of_k = F.when(F.col("uni") > k, F.coalesce("near", F.lit(0))).otherwise(F.col("both"))
        counted = pairs.join(near, ["i", "j"], "left").select("i", "j", of_k.alias("shared"), F.least(F.col("uni"), F.lit(k)).alias("drawn"))
    return counted.select("*", (1.0 - F.try_divide(F.col("shared").cast("double"), F.col("drawn").cast("double"))).alias("jaccard"))
