"""Signatures: the multiset or set of a genome's cores, kept within a frequency band."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SET, VECTOR = "set", "vec"
#: Fixed value: the largest unsigned 32-bit number, the open upper end of the band.
NO_MAX = 4294967295


def checked_mode(mode: str) -> str:
    if mode not in (SET, VECTOR):
        raise ValueError(f"mode is {SET!r} or {VECTOR!r}, not {mode!r}")
    return mode


def checked_band(low: int, high: int) -> tuple[int, int]:
    if not 0 <= low <= high <= NO_MAX:
        raise ValueError(f"need 0 <= min_cc <= max_cc <= {NO_MAX}, got {low} and {high}")
    return low, high


def signature(cores: DataFrame, element: tuple[str, ...] = ("label", "len"), genome: str = "genome_idx", band: tuple[int, int] | None = None, bands: DataFrame | None = None) -> DataFrame:
    """(genome, *element, cnt): how often each core occurs in each genome, within the band, both ends included.

    One aggregation, partial before the shuffle. Frequencies are those of all copies, so the band comes
    before any reduction to sets. ``band`` holds for all genomes; ``bands(genome, min_cc, max_cc)`` for each
    its own, and where it lacks a genome or a number, ``band`` or none at all.
    """
    counted = cores.groupBy(genome, *element).agg(F.count("*").alias("cnt"))
    low, high = checked_band(*band) if band else (0, NO_MAX)
    if bands is not None:
        own = bands.select(F.col(genome).alias("_g"), F.col("min_cc").alias("_lo"), F.col("max_cc").alias("_hi"))
        counted = counted.join(own, F.col(genome).eqNullSafe(F.col("_g")), "left")
        return counted.where(F.col("cnt").between(F.coalesce("_lo", F.lit(low)), F.coalesce("_hi", F.lit(high)))).drop("_g", "_lo", "_hi")
    return counted.where(F.col("cnt").between(low, high)) if band else counted


def sizes(sig: DataFrame, mode: str = SET, genome: str = "genome_idx", length: str | None = "len") -> DataFrame:
    """(genome, n, total_len): cores of each signature, and their total length; copies count in vector mode."""
    times = F.col("cnt") if checked_mode(mode) == VECTOR else F.lit(1)
    total = F.sum(F.col(length).cast("long") * times) if length else F.lit(None).cast("long")
    return sig.groupBy(genome).agg(F.sum(times).cast("long").alias("n"), total.alias("total_len"))
